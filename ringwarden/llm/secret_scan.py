"""Secret scans with multipart credential linking, in DataFrame functions only.

Patterns propose spans. Access identifiers, secrets and endpoints that stand close together within a
document are linked by an interval join; what is too weak to report alone is reported only when its
complement is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store
from .support import texts_of

# Base kinds as listed, their patterns and what a match must have to stand.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]+", "hex": "[0-9a-f]{16,}"}
MIN_ASSIGN_VALUE = 12
MIN_ACCESS = 18
# Weak parts of this method: named identifiers, bare 40-character strings, addresses of services.
WEAK = {
    "ident": r"""(?i:access_?key_?id|client_?id|account_?id|user_?name)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{4,}""",
    "bare": r"(?<![A-Za-z0-9+/=])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])",
    "endpoint": r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?",
}
KINDS = [*BASE, *WEAK]
ROLE = {"access": "id", "ident": "id", "assign": "secret", "hex": "secret", "bare": "secret", "endpoint": "place"}
# What a weak part needs close by to be reported.
NEEDS = {"ident": ["secret"], "bare": ["id"], "endpoint": ["id", "secret"]}
# Code points between two parts of one credential.
REACH = 400
CUTS = "array<struct<gap: int, len: int, ok: boolean>>"


def _cuts(kind: str) -> Column:
    """For each match of a kind: code points since the match before, its length, and whether it stands."""
    pattern = F.lit({**BASE, **WEAK}[kind])
    found = F.regexp_extract_all("text", pattern, F.lit(0))
    between = F.split("text", {**BASE, **WEAK}[kind], -1)
    if kind == "assign":
        value = F.regexp_extract_all("text", pattern, F.lit(1))
        stands = F.transform(value, lambda v: F.length(v) >= MIN_ASSIGN_VALUE)
    else:
        least = MIN_ACCESS if kind == "access" else 0
        stands = F.transform(found, lambda v: F.length(v) >= least)
    lengths = F.arrays_zip(
        F.transform(F.slice(between, 1, F.greatest(F.size(found), F.lit(1))), lambda x: F.length(x)).alias("gap"),
        F.transform(found, lambda x: F.length(x)).alias("len"), stands.alias("ok"),
    )
    return F.when(F.size(found) > 0, lengths)


def parts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (row_id, doc_id) and all their parts (row_id, kind, start, end).

    Each text is matched once and only lengths are stored; positions are running sums over the matches.
    """
    text = texts_of(docs)
    cuts = {k: _cuts(k) for k in BASE}
    # a weak part needs an identifier; most texts have none and skip these patterns
    could = F.col("text").contains("AKIA") | F.col("text").rlike(WEAK["ident"])
    cuts |= {k: F.when(could, _cuts(k)) for k in WEAK}
    table = store(
        text.select("doc_id", F.monotonically_increasing_id().alias("row_id"), *(c.cast(CUTS).alias(k) for k, c in cuts.items())),
        "secret-cuts",
    )
    shaped = None
    for rank, kind in enumerate(KINDS):
        one = table.where(F.col(kind).isNotNull()).select("row_id", F.lit(rank).alias("rank"), F.posexplode(kind).alias("pos", "cut"))
        shaped = one if shaped is None else shaped.unionByName(one)
    upto = Window.partitionBy("row_id", "rank").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    spans = shaped.withColumn("end", F.sum(F.col("cut.gap") + F.col("cut.len")).over(upto).cast("long")).where("cut.ok")
    names = F.array(*map(F.lit, KINDS))
    spans = spans.select("row_id", "rank", F.element_at(names, F.col("rank") + 1).alias("kind"), (F.col("end") - F.col("cut.len")).alias("start"), "end")
    return table.select("row_id", "doc_id"), store(spans, "secret-parts")


def linked(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Pairs of parts of different roles at most ``reach`` apart: each part with the role, start and end of the other.

    An interval join: a part lies in every stretch of ``reach`` code points from its start to its end, and meets those in
    the stretches from ``reach`` before its start to ``reach`` after its end. Parts have a least length, so a stretch holds
    a bounded number.
    """
    role = F.create_map(*[F.lit(x) for kv in ROLE.items() for x in kv])
    roles = found.withColumn("role", role[F.col("kind")])
    stretch = lambda c: F.floor(F.col(c) / reach)
    left = roles.withColumn("stretch", F.explode(F.sequence(stretch("start") - 1, stretch("end") + 1)))
    right = roles.select(
        "row_id", F.col("role").alias("o_role"), F.col("kind").alias("o_kind"), F.col("start").alias("o_start"), F.col("end").alias("o_end"),
        F.explode(F.sequence(stretch("start"), stretch("end"))).alias("stretch"),
    )
    near = (F.col("o_start") - F.col("end") <= reach) & (F.col("start") - F.col("o_end") <= reach) & (F.col("role") != F.col("o_role"))
    return left.join(right, ["row_id", "stretch"]).where(near).drop("stretch").distinct()


def credentials(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per access identifier or named identifier and the nearest secret and endpoint in reach, if any."""
    rows, found = parts(docs)
    pairs = linked(found, reach).where("role = 'id'")
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    nearest = lambda r: F.min(F.when(F.col("o_role") == r, F.struct(gap.alias("gap"), F.col("o_start").alias("start"), F.col("o_end").alias("end"), F.col("o_kind").alias("kind"))))
    grouped = pairs.groupBy("row_id", "kind", "start", "end").agg(nearest("secret").alias("secret"), nearest("place").alias("endpoint"))
    return grouped.where("secret is not null").join(rows, "row_id").drop("row_id")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id and spans (array of rank, kind, start, end by start, then kind) of every row.

    Base spans always stand; a weak part only with its complement within ``reach`` code points. Null text is
    empty, repeated rows give a row each, and texts of any length are read whole.
    """
    rows, found = parts(docs)
    needs = None
    for kind, wanted in NEEDS.items():
        test = F.lit(True)
        for role in wanted:
            test = test & F.array_contains("roles", role)
        test = (F.col("kind") == kind) & test
        needs = test if needs is None else needs | test
    met = linked(found, reach).where(F.col("kind").isin(list(WEAK))).groupBy("row_id", "rank", "kind", "start", "end")
    weak = met.agg(F.collect_set("o_role").alias("roles")).where(needs).drop("roles")  # three roles at most
    strong = found.where(F.col("kind").isin(list(BASE)))
    reported = strong.unionByName(weak.select(*strong.columns))
    spans = reported.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("spans"))
    return rows.join(spans, "row_id", "left").select("doc_id", F.coalesce("spans", F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")).alias("spans"))


def secrets_digest(docs: DataFrame) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return scan(docs).select("doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
