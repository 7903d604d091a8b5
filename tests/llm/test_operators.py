"""Each operator against a plain version, and on nulls, empty texts, repeated rows, extra columns and empty tables."""

import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ringwarden.llm import huffman, line_rules, mixing, near_text, near_vectors, packing, pii, quotes, secret_scan, tokens, toxicity
from ringwarden.llm.catalog import QUERIES, TOKENIZER

DDL = "doc_id long, text string, lang string, source string, n_chars long, score double, deal string"


def documents(spark, rows):
    """rows: (doc_id, text); the last two columns clash with working names."""
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or ""), 0.5, "x") for i, t in rows], DDL)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one two three"), (4, "one two three"), (None, "one two three"), (5, "a\x1cb É é ﬁ <|endoftext|> it's 12"),
    (6, "word " * 9000), (7, "x" * 30000), (8, "AKIA" + "A" * 16 + " password = 'abcdefghijklmnop' 0123456789abcdef"),
    (9, "mail me a.b@c.example.org at 10.0.0.1 or 4111 1111 1111 1111 or +1 (555) 010-9999, bank GB82 WEST 1234 5698 7654 32"),
    (10, "same line of text here for all\nsame line of text here for all\nother words stand in this one"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, ODD)


@pytest.fixture(scope="module")
def small(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def whole_ids(text):
    t = Tokenizer.from_file(TOKENIZER)
    return np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_ids_come_back_in_order(spark, odd, small):
    for docs in (odd, small):
        rows = [(r.doc_id, whole_ids(r.text)) for r in docs.collect()]
        rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
        start, want = 0, []
        for i, ids in rows:
            want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
            start += len(ids)
        got = [tuple(r) for r in huffman.huffman_digest(docs, TOKENIZER).collect()]
        assert sorted(got, key=lambda x: x[1]) == want
    assert huffman.huffman_digest(odd.limit(0), TOKENIZER).count() == 0


@pytest.mark.parametrize("counts,limit", [([1, 1, 2, 3, 5, 8, 13, 21, 34, 0], 5), ([1000000, 1, 1, 1], 2), ([0, 7], 16), ([], 16)])
def test_code_lengths(counts, limit):
    bits = huffman.code_lengths(np.array(counts, np.int64), limit)
    used = bits[bits > 0]
    assert (used <= max(limit, 1)).all() and sum(2.0**-b for b in used.tolist()) <= 1
    codes = huffman.canonical_codes(bits)
    words = [format(int(codes[i]), f"0{bits[i]}b") for i in np.flatnonzero(bits)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)


def test_pieces_cover_documents(odd, small):
    for docs in (odd, small):
        rows = packing.packing_digest(docs, TOKENIZER).collect()
        sequences, total = {}, 0
        for r in rows:
            sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
            total += r.length
        for pieces in sequences.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= packing.CAPACITY
        want = [whole_ids(r.text) for r in docs.collect()]
        assert total == sum(map(len, want))
        assert len(sequences) * packing.CAPACITY - total < packing.CAPACITY * len({r.sequence_id >> 32 for r in rows})
    texts = {r.doc_id: r.text for r in small.collect()}
    for r in packing.packing_digest(small, TOKENIZER).where("doc_id < 20").collect():
        ids = whole_ids(texts[r.doc_id])
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.packing_digest(odd.limit(0), TOKENIZER).count() == 0


def test_copies_of_a_row_spread_over_groups(spark):
    copies = documents(spark, [(7, "the same words in every copy " * 20)] * 300 + [(None, None)] * 300).repartition(3)
    pieces = packing.pack(copies, TOKENIZER, group_bytes=4000).groupBy((F.col("sequence_id") / 2**32).cast("int").alias("deal"))
    sizes = [r["count"] for r in pieces.count().collect()]
    assert sum(sizes) >= 600 and len(sizes) > 20 and max(sizes) < 60


def test_cost_is_balanced():
    pieces = packing.assign(np.array([1000, 900, 500, 500, 400, 300, 300, 196]), 2048)
    cost = {}
    for _, _, n, k, _ in pieces.tolist():
        cost[k] = cost.get(k, 0) + n + n * n / 4096
    assert max(cost.values()) < 1.1 * min(cost.values())


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    words, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = {}
    for w in windows:
        times[w] = times.get(w, 0) + 1
    marked = {k for i, w in enumerate(windows) if times[w] > 1 for k in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(marked)


def test_measures(odd, small):
    for docs in (odd, small):
        want = sorted((str(r.doc_id), *plain_measures(r.text or "")) for r in docs.collect())
        rows = line_rules.rules_digest(docs).collect()
        assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == want
        for r in rows:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert not (r.kept and r.base_failed)


def test_common_lines_go_and_depleted_documents_with_them(spark):
    own = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(8)]
    rows = [(2 * i, f"Shared  NOTICE line of the host\n{own[i]}") for i in range(6)]
    rows += [(100, "shared notice line of the host\n" * 30), (101, own[7])]  # 101 lies in the other host
    got = {r.doc_id: r for r in line_rules.judge_lines(documents(spark, rows), max_documents=5, keep_text=True).collect()}
    assert got[0].text == own[0] and got[0].kept and got[0].words_left == 30
    assert got[100].words_left == 0 and not got[100].kept
    assert got[101].kept and got[101].text == own[7]
    copies = documents(spark, [(2 * i, own[0]) for i in range(9)])
    assert all(r.kept for r in line_rules.judge_lines(copies, max_documents=5).collect())
    assert line_rules.rules_digest(copies.limit(0)).count() == 0


def test_lines_are_counted_by_document(spark):
    """Line counts and verdicts against a plain loop, with copies, repeated rows and null ids and hosts."""
    rng = np.random.default_rng(8)
    shared = [f"Shared  line {k} " + " ".join(f"s{k}x{i}" for i in range(6)) for k in range(12)]
    rows = []
    for i in range(150):
        own = [" ".join(f"w{i}x{j}x{k}" for k in range(6)) for j in range(4)]
        some = [shared[int(k)] for k in rng.choice(12, int(rng.integers(0, 7)), p=np.arange(12, 0, -1) / 78)]
        rows.append((i, "\n".join(own + some), ("a", "b", None, "")[int(rng.choice(4, p=[0.5, 0.2, 0.15, 0.15]))]))
    rows += rows[:20] + [(1000 + i, rows[3][1], "a") for i in range(9)] + [(None, rows[5][1], "a")] * 3
    seen = {}
    for n, (i, text, host) in enumerate(rows):
        for line in text.split("\n"):
            seen.setdefault((host, tuple(line.lower().split())), set()).add(i if i is not None else ("row", n))
    want = []
    for i, text, host in rows:
        lines = [tuple(x.lower().split()) for x in text.split("\n")]
        words = sum(map(len, lines))
        left = sum(len(x) for x in lines if len(seen[host, x]) <= 8)
        failed = words < 20
        want.append((str(i), str(host), left, not failed and left >= 10 and left >= 0.5 * words and not plain_repeats(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = line_rules.judge_lines(table, max_documents=8, copies_count=True).collect()
    assert len({x[3] for x in want}) == 2 and sorted((str(r.doc_id), str(r.host), r.words_left, r.kept) for r in got) == sorted(want)


def plain_repeats(text):
    words = text.split()
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return 100 * len(inside) > 30 * len(words)


def plain_pii(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m.group() if c.isdigit()][::-1]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]


TRICKY = [(20, "a@b.c.d@e.f @x.y q@ r@s. 1.2.3.4.5.6.7.8 01.002.0003.4 256.1.1.1 é+49 30 123456 é 4111-1111-1111-1111 12"), (21, "1" * 5000 + "@" + "a" * 5000)]


def test_personal_data(spark, odd, small):
    for docs in (odd, small, documents(spark, TRICKY)):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, r.text or "")
        for r in pii.pii_digest(docs).collect():
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_pii(texts[r.doc_id]))
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
    row = pii.pii_digest(odd).where("doc_id = 9").first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 1, 1) and "iban" in row.spans
    text = pii.redact(odd).where("doc_id = 9").first()
    assert text.text == "mail me [EMAIL] at [IP] or [CARD] or [PHONE], bank [IBAN]" and text.n_chars == len(text.text)
    assert pii.redact(odd).columns == odd.columns and pii.pii_digest(odd.limit(0)).count() == 0


IBANS = ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]


def test_account_numbers_before_and_after_other_words(spark):
    """Capitals and digits beside an account number do not hide it."""
    for iban in IBANS:
        for after in ("", " BIC COBADEFF", " EUR 500", " 00 EUR 500", " A 1", " Please", ". X", " 1234 5678", f" {IBANS[0]}"):
            for before in ("", "REF ", "AB12 ", "AB12 3456 ", "Konto: "):
                spans = [(s, e) for _, s, e in pii.ibans(before + iban + after)]
                assert (len(before), len(before) + len(iban)) in spans, (before, iban, after)
                assert len(spans) == 1 + (after[1:] == IBANS[0])
    assert pii.ibans("DE89 3704 0044 0532 0130 01 EUR") == [] == pii.ibans("DE89370400440532013000X")
    # a country that the list of lengths lacks is confirmed by its checksum
    number = next(t for t in (f"QQ{k:02d} 3704 0044 0532 0130" for k in range(100)) if pii.mod97(t.replace(" ", "")))
    assert ("iban", 0, len(number)) in pii.ibans(number + " BIC COBADEFF")
    text = pii.redact(documents(spark, [(1, "Bank DE89 3704 0044 0532 0130 00 BIC COBADEFF")])).first().text
    assert text == "Bank [IBAN] BIC COBADEFF"


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def test_secrets(spark, odd, small):
    more = documents(spark, [(30, "token=token:abcdefghijklmnop"), (31, "é PASSWORD : x token='ABCDEFGHIJKLMNOP' api-key=q"), (32, "token = abc\nsecret=" + "z" * 40)])
    for docs in (odd, small, more):
        texts = {}
        for r in docs.collect():
            texts.setdefault(r.doc_id, r.text or "")
        for r in secret_scan.secrets_digest(docs).collect():
            assert r.base_sha256 == hashlib.sha256(plain_secrets(texts[r.doc_id]).encode()).hexdigest(), texts[r.doc_id][:80]
    bare = "Ab1/" * 10
    linked = {r.doc_id: r.spans for r in secret_scan.secrets_digest(documents(spark, [
        (1, f"user_name: bobby {bare} https://a.example.com"), (2, bare), (3, f"user_name: bobby {'x ' * 400}{bare}"), (4, "https://a.example.com"),
    ])).collect()}
    assert linked == {1: "ident:0:16,bare:17:57,endpoint:58:79", 2: "", 3: "", 4: ""}
    assert secret_scan.secrets_digest(odd.limit(0)).count() == 0


def test_parts_in_reach_meet_at_every_offset(spark):
    """Long and short secrets before and after weak parts, against a plain loop over the parts of each text."""
    texts = [f"{'.' * at} {a}{' ' * gap}{b} " for at in range(0, 800, 57) for gap in (1, 100, 380, 399, 400, 401, 500)
             for long in ("token=" + "q" * 74, "token=" + "q" * 900) for a, b in ((long, "client_id=abcd"), ("client_id=abcd", long))]
    _, found = secret_scan.parts(documents(spark, list(enumerate(texts))))
    of = {}
    for r in found.collect():
        of.setdefault(r.row_id, []).append((r.kind, r.start, r.end))
    role = secret_scan.ROLE
    want = {(i, *x, *y) for i, xs in of.items() for x in xs for y in xs
            if role[x[0]] != role[y[0]] and y[1] - x[2] <= secret_scan.REACH and x[1] - y[2] <= secret_scan.REACH}
    got = [(r.row_id, r.kind, r.start, r.end, r.o_kind, r.o_start, r.o_end) for r in secret_scan.linked(found).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(of) == len(texts)
    text = f"token={'q' * 900}{' ' * 94}client_id=abcd"
    assert secret_scan.secrets_digest(documents(spark, [(1, text)])).first().spans == "assign:0:906,ident:1000:1014"


def plain_classes(rows):
    sets = {}
    for i, t in rows:
        w = "".join(c.lower() if c.isascii() else c for c in t or "")
        w = WORD.findall(w)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_near_texts(spark, odd, small):
    base = [f"word{k}" for k in range(100)]
    chain = [(500 + i, " ".join(base[: 100 - 4 * i])) for i in range(6)] + [(520, "Tiny text"), (521, "tiny  TEXT"), (522, "tiny")]
    docs = small.select("doc_id", "text").unionByName(spark.createDataFrame(chain, "doc_id long, text string"))
    want = plain_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.class_id for r in near_text.near_digest(docs).collect()} == want
    got = near_text.near_digest(odd).collect()
    assert len(got) == len(ODD) and {r.class_id for r in got if r.doc_id in (4, None)} == {4}
    assert {r.class_id for r in got if r.doc_id in (1, 2, 3)} == {1, 2, 3}
    kept = near_text.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted([*map(str, range(1, 11)), "None"])
    assert near_text.near_digest(odd.limit(0)).count() == 0


def test_near_texts_of_one_id(spark):
    """An id that stands for two texts joins neither their classes nor hides one of them."""
    a, b = (" ".join(f"{x}{k}" for k in range(100)) for x in "ab")
    rows = [(5, a), (5, b), (7, a), (8, b), (9, b + " tail"), (5, b), (None, a), (20, a + " end")]
    docs = documents(spark, rows)
    got = near_text.near_duplicates(docs).collect()
    text_of = {r.key: "ab"[i] for i, t in enumerate((a, b)) for r in near_text.near_duplicates(documents(spark, [(1, t)])).collect()}
    classes = {(r.doc_id, text_of.get(r.key)): r.class_id for r in got}
    of_a = {classes[i] for i in ((5, "a"), (7, "a"), (None, "a"), (20, None))}
    of_b = {classes[i] for i in ((5, "b"), (8, "b"), (9, None))}
    assert len(of_a) == len(of_b) == 1 and of_a != of_b and 5 in of_a | of_b
    kept = [r.text for r in near_text.one_of_each(docs).collect() if r.doc_id is not None]
    assert sorted(kept) == [a, b]
    # no id is left to name the second text
    twice = documents(spark, [(5, a), (5, b)])
    got = near_text.near_digest(twice).collect()
    assert len({r.class_id for r in got}) == 2 and all(r.kept for r in got) and max(r.class_id for r in got) >= near_text.NAMED_BY_WORDS
    assert sorted(r.text for r in near_text.one_of_each(twice).collect()) == [a, b]


def test_near_texts_that_differ_in_repeats(spark):
    """Sets decide: repeats of shingles in one of two texts do not lose a pair."""
    rows = []
    for k in range(12):
        words = [f"p{k}w{i}" for i in range(100)]
        times = (20, 100, 400)[k % 3]
        rows.append((10 * k, " ".join(words)))
        rows.append((10 * k + 1, " ".join(words[:30] * times + words[30:])))
        # the unshared end stands several times
        rows.append((10 * k + 2, " ".join(words[:95] + [f"p{k}x{i}" for i in range(8)] * 5)))
    want = plain_classes(rows)
    assert len(set(want.values())) == 12
    got = near_text.near_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == want


def test_pairs_at_the_threshold_are_seldom_missed():
    """Sets of similarity 0.8 pass bands and sketch as README states."""
    n, t = near_text.REGISTERS, near_text.THRESHOLD
    most = int((1 - t + near_text.SKETCH_SLACK) * 0.75 * n) + 1
    unlike = 0.75 * (1 - t)
    below = sum(math.comb(n, k) * unlike**k * (1 - unlike) ** (n - k) for k in range(most + 1))
    assert (1 - t**near_text.ROWS) ** near_text.BANDS + 1 - below < 0.001


def test_signature_estimates_weighted_similarity():
    h = np.arange(1, 201, dtype=np.uint64)
    row = np.concatenate([np.zeros(150, np.int64), np.ones(150, np.int64)])
    s = near_text.signatures(row, np.concatenate([h[:150], h[50:]]), np.ones(300), 2, 4096)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.04


def test_near_vectors(spark, folder):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(16).tolist(), i % 2, "x") for i in range(120)]
    rows += [(200 + i, (np.array(rows[i][1]) + 0.05 * rng.standard_normal(16)).tolist(), i % 2, "x") for i in range(60)]
    rows += [(300, rows[0][1], 0, "x"), (301, rows[0][1], 1, "x"), (302, None, 0, "x"), (303, [0.0] * 16, 0, "x"), (304, [float("nan")] * 16, 0, "x"), (305, rows[0][1], None, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, parts string")
    good = [r for r in rows if r[1] and r[2] is not None and np.isfinite(r[1]).all() and any(r[1])]
    u = {r[0]: np.array(r[1]) / np.linalg.norm(r[1]) for r in good}
    label = {r[0]: r[2] for r in good}
    near = {a: {b for b in u if b != a and label[a] == label[b] and u[a] @ u[b] >= 0.93} for a in u}
    got = {r.vec_id: r for r in near_vectors.near_vectors(table).collect()}
    assert len(got) == len(rows) and {i: got[i].n_links for i in u} == {i: len(near[i]) for i in u}
    for i in u:
        assert all(got[b].component_id == got[i].component_id for b in near[i])
    assert all(got[i].n_links == 0 and got[i].kept for i in (302, 303, 304, 305))
    assert near_vectors.near_vectors(table.limit(0)).count() == 0


def test_toxicity(spark, odd):
    rng = np.random.default_rng(3)
    common = ["".join(rng.choice(list("aeinorst"), 5)) for _ in range(300)]
    bad = ["vilewretch", "blockhead", "scoundrel", "nitwitted"]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(common, 80))
        if i % 4 == 0:
            for k in rng.integers(0, 80, 6):
                words[k] = bad[int(rng.integers(0, 4))]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 4 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(documents(spark, rows), marks).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in set(held)) for i in got)
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.95
    odd_rows = toxicity.toxicity(odd, marks).collect()
    assert len(odd_rows) == len(ODD) and all(0 <= r.score <= 1 for r in odd_rows)
    assert toxicity.without_toxic(odd, marks.limit(0)).columns == odd.columns
    assert toxicity.without_toxic(odd, marks.limit(0)).count() == len(ODD) and toxicity.toxicity(odd.limit(0), marks).count() == 0


def test_mixing(spark, odd, small, folder):
    labels = mixing.quality_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    rows = mixing.rates(small, labels, {"good": 0.8, "poor": 0.2}).collect()
    total = sum(r.tokens for r in rows)
    assert abs(sum(r.rate * r.tokens * r.p_good for r in rows) / total - 0.8) < 0.01
    assert abs(sum(r.rate * r.tokens * r.p_poor for r in rows) / total - 0.2) < 0.01
    assert all(r.rate >= 0 and r.copies in (int(r.rate), int(r.rate) + 1) for r in rows)
    more = mixing.mix(odd, labels, {"good": 1.0}, 1.5, 1.0)
    assert more.columns == odd.columns and more.count() >= len(ODD)
    assert mixing.rates(odd.limit(0), labels, {}).count() == 0 and mixing.rates(odd, labels.limit(0), {"x": 1.0}).count() == len(ODD)


def test_mixing_meets_targets_by_repeats_alone(spark):
    """A domain above its weight is met with rates of at least 1, by a total that allows it."""
    rows = [(i, f"GOOD {i} " + "plain words of text " * 20) if i % 4 else (i, "# $ % & | # \n" * 12) for i in range(400)]
    marks = spark.createDataFrame([(i, "poor" if i % 4 == 0 else "good") for i in range(400)], "doc_id long, domain string")
    docs, target = documents(spark, rows), {"good": 0.95, "poor": 0.05}
    mixture, _ = mixing.fit(docs, marks, target, None, 1.0)
    assert mixture.distance < mixing.MAX_DISTANCE and abs(mixture.shares["poor"] - 0.05) < 0.005
    mixed = mixing.mix(docs, marks, target, None, 1.0).collect()
    assert {r.doc_id for r in mixed} == set(range(400))
    size = lambda keep: sum(len(r.text.split()) for r in mixed if keep(r))
    assert abs(size(lambda r: r.doc_id % 4 == 0) / size(lambda r: True) - 0.05) < 0.01
    with pytest.warns(UserWarning, match="misses its targets"):
        mixture, _ = mixing.fit(docs, marks, target, 1.1, 1.0)
    assert mixture.distance > mixing.MAX_DISTANCE and mixture.shares["poor"] > 0.06


def test_mixing_counts_words_between_any_white_space(spark):
    rows = documents(spark, [(1, "one\ntwo\tthree  four\n"), (2, ""), (3, None), (4, " \n"), (5, "word")])
    got = {r.doc_id: r.tokens for r in mixing.rates(rows, spark.createDataFrame([], "doc_id long, domain string"), {}).collect()}
    assert got == {1: 4, 2: 0, 3: 0, 4: 0, 5: 1}


def test_quotes(spark):
    first = "Hello there my old friend.\n\nSecond paragraph stands here."
    rows = [
        (1, 0, "u", first), (1, 1, "a", "> hello there   my old friend.\n\nFine answer number one."),
        (1, 2, "u", "On Monday X wrote:\n> Fine answer number one.\n>> Hello there my old friend.\nAnd I agree with that."),
        (1, 3, "a", "> Second paragraph stands here.\nBack to the start."), (2, 0, "u", "> Second paragraph stands here.\nForked reply elsewhere"),
        (3, 5, "u", "a"), (3, 5, "u", "a"), (3, 20000, "u", "b"), (None, None, None, None),
    ]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int")
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(table).collect()}
    assert [got[1, k].own for k in range(4)] == [first, "Fine answer number one.", "And I agree with that.", "Back to the start."]
    assert [(got[1, k].parent_turn, got[1, k].depth, got[1, k].quote_level) for k in range(4)] == [(None, 0, 0), (0, 1, 1), (1, 2, 2), (0, 1, 1)]
    assert (got[2, 0].parent_conv, got[2, 0].thread_conv, got[2, 0].linked) == (1, 1, True)
    assert got[3, 20000].parent_turn == 5 and got[None, None].own == "" and got[None, None].depth == 0
    assert quotes.conversations(table).count() == len(rows) and quotes.conversations(table.limit(0)).count() == 0


def test_trimmed_quotes_find_their_original(spark):
    """Some lines or sentences of a paragraph, or a paragraph broken by an answer, link as the whole does."""
    first = "The first line of it stands here\nand the second line goes on. A sentence of its own follows!\nThen the third line ends it."
    replies = [
        "> and the second line goes on. A sentence of its own follows!\nYes to that.", "> A sentence of its own follows!\nIndeed it does.",
        "> The first line of it stands here\nMy answer in between.\n> Then the third line ends it.\nAnd one more.", "> A sentence of\n> its own follows!\nWrapped anew.",
    ]
    rows = [(1, 0, "u", first), (1, 1, "a", "Something else is said here."), *((2 + i, 0, "a", r) for i, r in enumerate(replies))]
    got = {(r.conv_id, r.turn): r for r in quotes.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[2 + i, 0].parent_conv, got[2 + i, 0].parent_turn, got[2 + i, 0].n_quoted, got[2 + i, 0].n_found) for i in range(4)] == [(1, 0, n, n) for n in (1, 1, 2, 1)]


def test_quotes_round_trip(spark, folder):
    """Conversations written as mail, each message quoting the one before it, come apart into what they were."""
    talks = {}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").where("conv_id < 20").collect():
        talks.setdefault(r.conv_id, {})[r.turn] = r.text.strip()
    rows, mails = [], 0
    for turns in talks.values():
        before = None
        for k in sorted(turns):
            mail = turns[k] if before is None else "\n".join("> " + line for line in before.split("\n")) + "\n" + turns[k]
            rows.append((mails, 0, "u", mail, turns[k], k))
            mails, before = mails + 1, mail
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, own_text string, place long")
    got = {r.conv_id: r for r in quotes.conversations(table).collect()}
    same = [got[r[0]].own == r[4] for r in rows]
    assert all(same)
    linked = [got[r[0]].parent_conv == r[0] - 1 for r in rows if r[5] > 0]
    assert np.mean(linked) > 0.95


def test_every_query_is_there():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert public_tokenizers.path("word_bpe_49k.json") == TOKENIZER


def test_words_asked_for_again_stay_known():
    """op4_huffman_ids: frequent words are not learned anew when the memory of words is full; ids are those of the whole tokenizer."""
    enc, whole = tokens.Encoder(TOKENIZER, 40), Tokenizer.from_file(TOKENIZER)
    texts = [f"common words* stay(s) Common, w{chr(97 + k)}x v{chr(97 + k)}y,;*** Z{chr(97 + k)}\u00e9$$$ it's a-b <|endoftext|> <| x=1" for k in range(26)]
    for text in texts:
        assert np.frombuffer(enc.encode([text])[0], enc.dtype).tolist() == whole.encode(text, add_special_tokens=False).ids
        assert len(enc.known) <= 40
    assert {"common", "words*", "stay(s)", "Common,"} <= set(enc.known)


def test_toxicity_sends_a_text_once(spark, odd, monkeypatch):
    """pipeline: the other columns travel in a struct, which has no second copy of the text."""
    sent, scored = [], toxicity.scored
    monkeypatch.setattr(toxicity, "scored", lambda docs, *more: sent.append(docs.schema) or scored(docs, *more))
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(odd, labels)
    assert kept.columns == odd.columns and kept.schema["text"].dataType == odd.schema["text"].dataType
    assert "text" not in sent[0]["row"].dataType.names and sent[0].names.count("text") == 1
    assert sorted(map(str, kept.collect())) == sorted(map(str, odd.collect()))


def test_toxicity_sample_takes_no_python_workers(spark, monkeypatch):
    """pipeline: the ids of the sample reach the executors without Python rows, whose workers would stay beside the others."""
    docs = documents(spark, [(i, f"text {i}") for i in range(40)] + [(3, "a text"), (None, "no id")])
    labels = spark.createDataFrame([(i, int(i < 10)) for i in range(40)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda texts, toxic, share: seen.append((texts, toxic, share)))
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **b: pytest.fail("Python rows"))
    monkeypatch.setattr(spark, "createDataFrame", lambda *a, **b: pytest.fail("rows of the driver"))
    toxicity.fit_on(docs, labels)
    learned = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5]
    text = {i: "a text" if i == 3 else f"text {i}" for i in learned}
    bad = sum(i < 10 for i in learned)
    (texts, toxic, share), = seen
    assert toxic == [1] * bad + [0] * (len(learned) - bad) and share == bad / len(learned)
    assert sorted(texts[:bad]) == sorted(text[i] for i in learned if i < 10) and sorted(texts[bad:]) == sorted(text[i] for i in learned if i >= 10)


def test_words_are_learned_in_parts(monkeypatch):
    """pipeline: the tokenizer never gets more than LEARNED_AT_ONCE new words, whatever the text; ids are those of the whole tokenizer."""
    monkeypatch.setattr(tokens, "LEARNED_AT_ONCE", 5, raising=False)
    enc, whole, given = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER), []

    class Spy:
        def __init__(self, inner):
            self.inner = inner

        def encode(self, *a, **b):
            return self.inner.encode(*a, **b)

        def encode_batch_fast(self, batch, **b):
            given.append(max(len(batch), *(len(x.split()) for x in batch)))
            return self.inner.encode_batch_fast(batch, **b)

    enc.letters, enc.whole = Spy(enc.letters), Spy(enc.whole)
    text = " ".join(f"w{a}{b}o {a}{b}, x{a}1{b} \u4e2d{a}{b}" for a in "abcdef" for b in "ghijk")
    for t in (text, f"{text} more {text}", "", "\u4e2d a,"):
        assert np.frombuffer(enc.encode([t])[0], enc.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids
    assert given and max(given) <= 5


def test_distinct_words_are_looked_up_at_once(monkeypatch):
    """op4, op6: a chunk looks each of its distinct words up once, however often it stands there; ids are those of the whole tokenizer."""
    sizes, find = [], tokens.Words.find
    monkeypatch.setattr(tokens.Words, "find", lambda self, words: sizes.append(len(words)) or find(self, words))
    enc, whole = tokens.Encoder(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    odd = ["", " ", "\x1c a\x1db \x00 a\x00 a", "\u00a0caf\u00e9\u3000\u00c0\u00cd\u00df\u00d1! e\u0301t", "\x85x\u2028y\x0bz", "\u4e2d\u6587" * 9, "\uffff \U0010ffff"]
    odd += [" ".join("abcdefghijklmnopqr"[:n] + mark for n in range(1, 19) for mark in ("", "*", "\u00ff"))]
    texts = odd + ["many Words, again\nand again "] * 500
    for _ in range(2):
        got = enc.encode(tokens.pa.array(texts))
        assert [np.frombuffer(x, enc.dtype).tolist() for x in got] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(sizes) < 100 and sizes[-1] == sizes[0]


def test_words_of_one_place_stay_apart(monkeypatch):
    """op4, op6: words whose hashes are equal, or which begin alike, have numbers of their own, also after some are forgotten."""
    monkeypatch.setattr(tokens, "mix", lambda x: x * np.uint64(0))
    words = ["", "a", "a\x00", "sixteen bytes ab", "sixteen bytes abc", "sixteen bytes abcd", *(f"w{k}" for k in range(40))]
    known = tokens.Words()
    for part in (words[:5], words[5:]):
        known.add(tokens.pa.array(part))
    assert [*known] == words and len(known) == len(words)
    assert known.find(tokens.pa.array([*words, "w", "sixteen bytes a"])).tolist() == [*range(len(words)), -1, -1]
    some = known.only(np.array([0, 2, 4, 9]))
    assert [*some] == [words[k] for k in (0, 2, 4, 9)]
    assert some.find(tokens.pa.array(words))[[0, 1, 2, 3, 4, 5, 9]].tolist() == [0, -1, 1, -1, 2, -1, 3]
    monkeypatch.undo()
    grown = tokens.Words()
    for k in range(0, 30_000, 1000):
        grown.add(tokens.pa.array([f"{k + i}" for i in range(1000)]))
    assert (grown.find(tokens.pa.array([f"{k}" for k in range(30_000)])) == np.arange(30_000)).all() and 2 * len(grown) <= len(grown.table)


def test_pieces_come_back_in_small_batches(small, monkeypatch):
    """pipeline: pieces are the same with few words remembered, and leave Python a few at a time."""
    monkeypatch.setattr(packing, "PIECE_ROWS", 7, raising=False)
    sent = []
    monkeypatch.setattr("pyspark.sql.pandas.group_ops.PandasGroupedOpsMixin.applyInArrow", lambda self, f, schema: sent.append(f))
    packing.pack(small, TOKENIZER, remembered=30)
    whole = sent[0]
    ids = [tokens.Encoder(TOKENIZER, 30).encode([t or ""])[0] + np.array([1], "<u2").tobytes() for t in ("one two", None, "three four five " * 900)] * 10
    out = whole(packing.pa.table({"deal": [2] * 30, "doc_id": [*range(30)], "ids": packing.pa.array(ids, packing.pa.binary())}))
    assert max(b.num_rows for b in out.to_batches()) <= 7 and out.num_rows >= 30
    assert sum(out["length"].to_pylist()) == sum(len(x) // 2 for x in ids)


def test_toxicity_fit_measures_texts_in_chunks(monkeypatch):
    """pipeline: the driver works on a chunk of the sample at once, and each text is measured as it is alone."""
    got, savings = [], toxicity.savings
    monkeypatch.setattr(toxicity, "savings", lambda column, *c: got.append((column, c, savings(column, *c))) or got[-1][2])
    texts = [f"some ordinary words {i} " * 800 for i in range(80)] + ["bad slur words here"] * 20
    toxicity.fit(texts, [0] * 80 + [1] * 20)
    assert len(got) > 1 and max(sum(len(t) for t in column.to_pylist()) for column, *_ in got) <= 1 << 20
    assert [t for column, *_ in got for t in column.to_pylist()] == texts
    whole = savings(toxicity.pa.array(texts), *got[0][1])
    assert (np.concatenate([x for *_, x in got]) == whole).all()
