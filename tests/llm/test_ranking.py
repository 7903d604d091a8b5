"""Importance resampling, ranked search and phrase fingerprints against plain versions."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from ringwarden.llm import catalog, importance, lexical, phrase_prints
from ringwarden.llm.sql import SQL
from ringwarden.llm.words import Words, WordTable, crc32, crc32_space

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DDL = "doc_id long, text string, lang string, score double, rank string, part string, n long"


def documents(spark, rows):
    """rows: (doc_id, text); the other columns clash with working names."""
    return spark.createDataFrame([(i, t, "en", 0.5, "r", "p", 7) for i, t in rows], DDL)


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1.5, "x") for i, t in rows], "item_id long, text string, score double, block string")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words_of(text):
    return WORD.findall(lower(text))


ODD = [
    (1, None), (2, ""), (3, " \n\t..."), (4, "One TWO three"), (4, "One TWO three"), (None, "one two three"), (5, "É ÉÉ é 12ab ﬁ \U0001f600x antidisestablishmentarianism"),
    (6, "word " * 9000), (7, "x" * 30000), (8, "one two three " * 10), (9, "one two three " * 10), (None, "one two three " * 10),
    (-5, " ".join(f"w{i % 37}" for i in range(500))),
]


def test_words_tables_and_crc():
    texts = [None, "", "Ab-cd É, 9x", "q" * 200 + " " + "é" * 40, "a b a b a_b"]
    words = Words(pa.array(texts, pa.string()))
    want = [w.encode() for t in texts for w in words_of(t)]
    assert [words.bytes_of(k) for k in range(len(words))] == want
    listed = sorted(set(want))[::2]
    assert WordTable(listed).find(words).tolist() == [listed.index(w) if w in listed else -1 for w in want]
    plain = crc32(words, np.arange(len(words)))
    assert plain.tolist() == [zlib.crc32(w) for w in want]
    after = crc32(words, np.arange(1, len(words)), crc32_space(plain[:-1]))
    assert after.tolist() == [zlib.crc32(a + b" " + b) for a, b in zip(want, want[1:])]


def plain_resample(rows, target, longest, buckets, min_words, percent):
    def features(text):
        w = words_of(text)
        return [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, longest + 1) for i in range(len(w) - m + 1)]

    found = [features(t) for _, t in rows]
    s, t = np.zeros(buckets), np.zeros(buckets)
    for f in found:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, features(text), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + buckets) / ((a + 1) * (t.sum() + buckets)))) for a, b in zip(s, t)]
    out, able = [], []
    for k, ((i, text), f) in enumerate(zip(rows, found)):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
        if len(words_of(text)) >= min_words:
            able.append(k)
    able.sort(key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0))
    for place, k in enumerate(able[: len(able) * percent // 100]):
        out[k][4] = place + 1
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("longest,head,pairs", [(1, 16384, 0), (1, 3, 0), (2, 40, 25), (2, 0, 0), (3, 40, 25)])
def test_resampling(spark, longest, head, pairs):
    rng = random.Random(longest)
    rows = ODD + [(100 + i, " ".join(rng.choice(["alpha", "Beta", "gamma", f"w{rng.randrange(50)}", "ünïcode", "thequickbrownfoxjumps"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    target = ["alpha beta alpha beta gamma", None, "w1 w2 w3"]
    got = importance.resample(
        documents(spark, rows).repartition(5), benchmark(spark, enumerate(target)), longest=longest, buckets=997, percent=50, head_words=head, head_pairs=pairs
    )
    got = [(r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()]
    assert sorted(got, key=str) == plain_resample(rows, target, longest, 997, 20, 50)


def test_resampling_of_nothing(spark):
    empty = documents(spark, []), benchmark(spark, [])
    assert importance.importance_digest(*empty).count() == 0
    assert importance.importance_digest(documents(spark, ODD), empty[1]).count() == len(ODD)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    want = con.execute(SQL[name])
    order = [got.columns.index(d[0]) for d in want.description]
    assert sorted((tuple(r[k] for k in order) for r in got.collect()), key=str) == sorted(want.fetchall(), key=str)


def plain_search(items, rows, top):
    docs = [(i, words_of(t)) for i, t in rows]
    docs = [(i, w) for i, w in docs if w]
    n, total = len(docs), sum(len(w) for _, w in docs)
    df = {}
    for _, w in docs:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        found = []
        for i, w in docs:
            m = 10 + 90 * len(w) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * w.count(x) // (1000 * w.count(x) + 8 * m))
                for x in set(words_of(text)) if x in w
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        found.sort()
        out += [(item, k + 1, f[3], -f[0]) for k, f in enumerate(found[:top])]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [128 << 10, 300])
def test_search(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical, "TREE_DOCUMENTS", 150)
    monkeypatch.setattr(lexical, "LEAF", 4)
    rng = random.Random(5)
    vocabulary = [f"t{i}" for i in range(300)]
    draw = lambda n: " ".join(vocabulary[int(300 * rng.random() ** 3)] for _ in range(n))
    rows = ODD + [(100 + i, draw(rng.randrange(40))) for i in range(400)] + [(1000 + i, "t250 t251 shared") for i in range(40)]
    items = [(i, draw(8)) for i in range(25)] + [(30, None), (31, "nowhere"), (32, "T250 t251 t250"), (32, "word"), (None, "one two"), (33, "é x12 antidisestablishmentarianism")]
    got = lexical.search(benchmark(spark, items), documents(spark, rows).repartition(3), top=5, block_bytes=block_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_search(items, rows, 5)


def test_search_of_nothing(spark):
    items, docs = benchmark(spark, [(1, "one")]), documents(spark, ODD)
    assert lexical.search(items.limit(0), docs).count() == 0
    assert lexical.search(items, docs.limit(0)).count() == 0


def test_search_prunes():
    """Batches of documents that share no rare word with an item are not scored."""
    rng = np.random.default_rng(1)
    n, words = 2048, 64
    topic = np.repeat(np.arange(words), n // words)
    rng.shuffle(topic)
    row, word = np.repeat(np.arange(n), 2), np.stack([topic, np.full(n, words)], 1).ravel()  # one rare word, one in all
    weight = np.append(np.full(words, 4000), 1)
    tree = lexical.DocumentTree(np.arange(n), row, word, np.full(2 * n, 500_000), weight)
    vectors = np.zeros((1, words + 1))
    vectors[0, [3, words]] = weight[[3, words]]
    best = lexical.Best(np.zeros(1, np.int64), 10)
    assert lexical.search_tree(lexical.ItemTree(vectors), tree, best) <= 2
    assert best.doc[0].tolist() == np.flatnonzero(topic == 3)[:10].tolist()


def plain_phrases(data):
    held, start = set(), 0
    for end in range(1, len(data) + 1):
        if data[start:end] not in held:
            held.add(data[start:end])
            start = end
    return held | ({data[start:]} if start < len(data) else set())


def plain_likeness(a, b):
    a, b = plain_phrases(a.encode()), plain_phrases(b.encode())
    return len(a & b) / len(a | b) if a | b else 1.0


def test_parse_of_both_texts():
    rng = random.Random(2)
    for _ in range(200):
        data, other = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(80))) for _ in range(2))
        cut = rng.randrange(len(data) + 1)
        first, second = phrase_prints.parsed_both(data, cut, other)
        assert first.tolist() == phrase_prints.parsed(data).tolist() and second.tolist() == phrase_prints.parsed(data[:cut] + other).tolist()
        ends = np.cumsum(phrase_prints.phrase_lengths(first, np.zeros(len(first), np.int64))).tolist()
        assert {data[s:e] for s, e in zip([0, *ends], ends)} == plain_phrases(data)


@pytest.mark.parametrize("partitions", [1, 7])
def test_fingerprints(spark, monkeypatch, partitions):
    monkeypatch.setattr(phrase_prints, "CHUNK_BYTES", 300)
    rng = random.Random(3)
    rows = ODD + [(200 + i, "".join(rng.choice("abcdé ") for _ in range(rng.randrange(90)))) for i in range(80)]
    rows += [(500 + i, "the same text in many rows of the table") for i in range(30)] + [(700, f"{i} other text") for i in range(5)]
    docs = documents(spark, rows)
    mark = {(r.doc_id, r.text): r.h for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), mark[r], r[1] or ""))
    got = sorted(phrase_prints.fingerprints(docs.repartition(partitions)).collect(), key=str)
    want = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        want.append((i, text, after, edited))
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted((str(i), len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, _, e in want)
    exact = {(str(i), hashlib.sha256(e.encode()).hexdigest()): (plain_likeness(t, e), plain_likeness(t, a), t) for i, t, a, e in want if max(map(len, (t, a))) < 100}
    prints = {}
    for r in got:
        key = (str(r.doc_id), r.edited_sha256)
        if key in exact:
            edited, following, text = exact[key]
            assert r.near_edited == pytest.approx(edited) and prints.setdefault(text, r.fingerprint) == r.fingerprint
    assert len(set(prints.values())) == len({tuple(sorted(plain_phrases(t.encode()))) for t in prints})
    assert phrase_prints.fingerprints(docs.limit(0)).count() == 0
    assert [r.near_next for r in phrase_prints.fingerprints(documents(spark, [(1, "alone")])).collect()] == [1.0]


def test_signature_estimates(spark, folder):
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("n_chars > 1500").limit(30).collect()]
    for a, b in zip(texts, texts[1:]):
        b = a[: len(a) // 2] + b
        x, y = phrase_prints.signatures([a.encode(), b.encode()], [phrase_prints.parsed(t.encode()) for t in (a, b)])
        assert abs(phrase_prints.likeness(x, y) - plain_likeness(a, b)) < 0.2
