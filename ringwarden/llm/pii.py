"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import small_batches, texts_of
from .text_arrays import chunks

# Base kinds as listed; iban is this method's own.
KINDS = ["email", "ip", "card", "phone", "iban"]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A start inside a run of digits fails as the run's start does, so only that is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The longest run that an IBAN may be part of; the lookahead lets the next start lie inside it.
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?=([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}))")
_IBAN_END = re.compile("(?<=[A-Z0-9])(?![A-Za-z0-9])")
# Characters of each country's IBAN (ISO 13616 registry).
IBAN_LENGTH = {
    c: int(w[:2]) for w in (
        "15NO", "16BE", "18DKFIFOFKGLNLSD", "19MKSI", "20ATBAEEKZLTLUMNXK", "21CHHRLILV", "22BGBHCRDEGBGEIEMERSVA", "23AEGIILIQOMSOTL",
        "24ADCZESMDPKROSASESKSTTNVG", "25LYPT", "26ISTR", "27BIDJFRGRITMCMRSM", "28ALAZBYCYDOGTHNHULBNIPLSV", "29BREGPSQAUA", "30JOKWMUYE",
        "31MTSC", "32LC", "33RU",
    ) for c in re.findall("..", w[2:])
}
_DIGIT = re.compile("[0-9]")

# Score of a confirmed span without context, and the words that raise or lower it.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9}
RAISING = {
    "email": "mail contact write correo courriel",
    "ip": "ip address host server login client adresse",
    "card": "card visa credit debit mastercard payment karte carte tarjeta",
    "phone": "phone tel telephone call mobile fax cell telefon teléfono",
    "iban": "iban account bank konto compte cuenta transfer",
}
LOWERING = {
    "email": "example noreply", "ip": "version release build section", "card": "order tracking serial isbn sku part invoice",
    "phone": "isbn serial version", "iban": "serial sku",
}
STEP = 0.2
REACH = 40
MIN_SCORE = 0.5
_WORD = re.compile(r"[^\W\d_]+")
_UP = {k: frozenset(v.split()) for k, v in RAISING.items()}
_DOWN = {k: frozenset(v.split()) for k, v in LOWERING.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ outwards: a match starts where the run of local characters does."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            # a long run of digits is over 255 unless its leading zeros hide a small number
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append(("phone", *m.span()))
    return out


def ibans(text: str) -> list[tuple[str, int, int]]:
    """A match ends where a word does, at its country's length; for a country without one at the longest that mod-97 confirms.

    Such a country's match stands only where none of a listed country is.
    """
    if not _DIGIT.search(text):
        return []
    listed: list[tuple[int, int]] = []
    other: list[tuple[int, int]] = []
    for m in _IBAN.finditer(text):
        length = IBAN_LENGTH.get(m[1][:2])
        spans = other if length is None else listed
        if spans and m.start() < spans[-1][1]:
            continue
        # one more character of the text shows whether the run goes on
        ends = [e.start() for e in _IBAN_END.finditer(text, m.start() + 15, min(len(text), m.end(1) + 1)) if e.start() <= m.end(1)]
        for end in reversed(ends):
            number = text[m.start() : end].replace(" ", "")
            if 15 <= len(number) <= 34 and length in (None, len(number)) and mod97(number):
                spans.append((m.start(), end))
                break
    alone = [(s, e) for s, e in other if all(e <= a or b <= s for a, b in listed)] if listed else other
    return [("iban", s, e) for s, e in sorted(listed + alone)]


def score(text: str, kind: str, start: int, end: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - REACH) : start] + " " + text[end : end + REACH])}
    value = SCORES[kind] + STEP * bool(near & _UP[kind]) - STEP * bool(near & _DOWN[kind])
    return round(min(1.0, max(0.0, value)), 2)


def find_spans(text: str) -> list[dict]:
    found = base_spans(text) + ibans(text)
    return [{"kind": k, "start": s, "end": e, "score": score(text, k, s, e)} for k, s, e in found]


SPANS = "array<struct<kind: string, start: long, end: long, score: double>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id, text and spans of every row; positions are code points, ends exclusive.

    Null text is empty and has no spans; repeated rows give a row each; text length is not limited: every
    pattern takes time in proportion to the text.
    """
    small_batches(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in chunks(batches, "text"):
            spans = [find_spans(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], names=["doc_id", "spans"])

    return texts_of(docs).mapInArrow(scan, f"doc_id long, spans {SPANS}")


def redacted(text: str, min_score: float = MIN_SCORE) -> str:
    """The text with every span that scores enough replaced by its kind; of overlapping spans the first, then longest, stands."""
    out, at = [], 0
    for s in sorted((s for s in find_spans(text) if s["score"] >= min_score), key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` with redacted texts and n_chars of what is left; all rows and columns stay, null text stays null."""
    small_batches(docs.sparkSession)
    schema, names = docs.schema, docs.columns

    def scrub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            texts = [None if t is None else redacted(t, min_score) for t in batch.column("text").to_pylist()]
            yield batch.set_column(names.index("text"), "text", pa.array(texts, pa.string()))

    out = docs.mapInArrow(scrub, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*names)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def pii_digest(docs: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return find_pii(docs).select(
        "doc_id", *(count(k) for k in KINDS[:4]), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.filter("spans", lambda s: (s["kind"] != "iban") | (s["score"] >= MIN_SCORE))).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
