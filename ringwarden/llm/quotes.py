"""Quotation linking: quoted passages find the messages they come from; conversations without quotes.

DataFrame functions only. A line's quote level is the number of > marks it begins with. A passage is a
run of lines of one level without an empty line in between; its normal form has lower case and single spaces. Beside the
whole run its lines and its sentences are looked for, so that a trimmed quote finds its original too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import store

# Fixed patterns: the marks before a quoted line, and the line that introduces a quote.
MARKS = r"^[\x20\t]*(?:>[\x20\t]?)+"
QUOTED = r"(?m)^[\x20\t]*>"
INTRODUCTION = r"(?i)^(on .{0,200} wrote|.{0,100} (wrote|writes|schrieb|escribió|a écrit)) ?:\s*$"
# Turns of one conversation that a window sees at once.
TURNS_PER_SLICE = 10_000
# Code points of a passage that may link; shorter ones ("thanks") occur everywhere.
MIN_PASSAGE = 12
MAX_ROUNDS = 40


def _lines(text: Column) -> Column:
    """array of (level, body) of a text's lines."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        level = F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))
        return F.struct(level.alias("level"), F.regexp_replace(x, MARKS, "").alias("body"))

    return F.transform(F.split(text, "\n"), line)


def _normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _passages(lines: Column) -> Column:
    """Runs of lines of one level as (level, lines), by joining all lines with marks between the runs."""
    # \x01 parts runs and carries the level; \x02 ends it
    marked = F.array_join(
        F.transform(
            lines,
            lambda x, i: F.when(F.trim(x["body"]) == "", F.lit("\x01")).otherwise(
                F.concat(
                    F.when(
                        (i == 0) | (F.get(lines, i - 1)["level"] != x["level"]) | (F.trim(F.get(lines, i - 1)["body"]) == ""),
                        F.concat(F.lit("\x01"), x["level"].cast("string"), F.lit("\x02")),
                    ).otherwise(F.lit("\n")),
                    F.translate(x["body"], "\x01\x02", "  "),
                )
            ),
        ),
        "",
    )
    runs = F.filter(F.split(marked, "\x01"), lambda x: x.contains("\x02"))
    return F.transform(
        runs, lambda x: F.struct(F.split(x, "\x02")[0].cast("int").alias("level"), F.split(x, "\x02")[1].alias("passage"))
    )


def _pieces(runs: Column) -> Column:
    """level, run, kind, hashes and size of every run, and of the lines and sentences of those with several."""

    def of(run: Column, i: Column) -> Column:
        whole = F.array(_normal(run["passage"]))
        lines = F.transform(F.split(run["passage"], "\n"), _normal)
        sentences = F.split(_normal(run["passage"]), r"(?<=[.!?])\x20")
        several = lambda parts: F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))

        def named(parts: Column, kind: int) -> Column:
            return F.transform(
                F.filter(parts, lambda x: F.length(x) >= MIN_PASSAGE),
                lambda x: F.struct(
                    run["level"].alias("level"), i.alias("run"), F.lit(kind).alias("kind"), F.xxhash64(x).alias("h1"), F.hash(x).alias("h2"), F.length(x).alias("size")
                ),
            )

        return F.concat(*(named(parts, kind) for kind, parts in enumerate((whole, several(lines), several(sentences)))))

    return F.flatten(F.transform(runs, of))


def parsed(messages: DataFrame) -> DataFrame:
    """message_id, conv_id, turn, role, quote_level, own (the text without quotes), n_quoted and pieces of every row.

    Texts without a quote mark are not taken apart: their own text is the whole, as one paragraph per empty line.
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    has = F.col("text").rlike(QUOTED)
    rows = rows.withColumn("lines", F.when(has, _lines(F.col("text"))))
    own_lines = F.filter("lines", lambda x: (x["level"] == 0) & ~x["body"].rlike(INTRODUCTION))
    own = F.regexp_replace(F.array_join(F.transform(own_lines, lambda x: x["body"]), "\n"), r"^\s+|\s+$", "")
    level = F.array_max(F.transform("lines", lambda x: x["level"]))
    plain = F.transform(
        F.split(F.regexp_replace("text", r"\n[\x20\t]*(?=\n)", "\n"), "\n\n+"), lambda x: F.struct(F.lit(0).alias("level"), x.alias("passage"))
    )
    rows = rows.withColumn("pieces", _pieces(F.when(has, _passages(F.col("lines"))).otherwise(plain)))
    return rows.select(
        F.monotonically_increasing_id().alias("message_id"), "conv_id", "turn", "role",
        F.when(has, level).otherwise(0).alias("quote_level"), F.when(has, own).otherwise(F.col("text")).alias("own"),
        F.size(F.filter("pieces", lambda p: (p["level"] > 0) & (p["kind"] == 0))).cast("long").alias("n_quoted"), "pieces",
    )


def _previous(messages: DataFrame) -> DataFrame:
    """message_id and the message before it in its conversation; a conversation of any length is seen in slices."""
    m = messages.where("conv_id is not null and turn is not null").select("conv_id", "turn", "message_id")
    m = m.withColumn("slice", F.floor(F.col("turn") / TURNS_PER_SLICE))
    place = F.struct("turn", "message_id")
    # messages of one turn hang on the turn before, so one row per turn goes on
    turns = m.groupBy("conv_id", "slice", "turn").agg(F.min("message_id").alias("first_id"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn")
    turns = turns.withColumn("before", F.lag("first_id").over(inside))
    ends = m.groupBy("conv_id", "slice").agg(F.max_by(F.struct("turn"), place).alias("last"))
    ends = ends.join(turns.select("conv_id", "slice", "turn", "first_id").withColumnRenamed("turn", "last_turn"), ["conv_id", "slice"]).where(F.col("last_turn") == F.col("last.turn"))
    over = Window.partitionBy("conv_id").orderBy("slice")
    ends = ends.select("conv_id", "slice", F.lag("first_id").over(over).alias("earlier"))
    turns = turns.join(ends, ["conv_id", "slice"]).select("conv_id", "turn", F.coalesce("before", "earlier").alias("previous"))
    return m.join(turns, ["conv_id", "turn"]).select("message_id", "previous")


def quote_links(table: DataFrame) -> DataFrame:
    """message_id, the message its quotes come from, and how many quoted passages were found.

    For each passage, line or sentence only its first author counts, once within the conversation and once over all, so a passage
    that everybody writes is one row and not all pairs. Level 1 tells the parent: the author of most quoted code
    points, the later one of two equals. A message never answers a later one.
    """
    exploded = table.select("message_id", "conv_id", "turn", F.explode("pieces").alias("p")).select("message_id", "conv_id", "turn", "p.*")
    order = F.struct("conv_id", "turn", "message_id")
    quoted = store(exploded.where("level > 0"), "quoted")
    if quoted.isEmpty():
        return quoted.select("message_id", F.lit(None).cast("long").alias("quoted_id"), F.lit(0).cast("long").alias("n_found"))
    own = exploded.where("level = 0")
    wanted = own.join(quoted.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi")
    here = store(wanted.groupBy("conv_id", "h1", "h2").agg(F.min(order).alias("source")), "quoted-here")
    there = store(here.groupBy("h1", "h2").agg(F.min("source").alias("anywhere")), "quoted-anywhere")
    met = quoted.join(here, ["conv_id", "h1", "h2"], "left").join(there, ["h1", "h2"], "left")
    mine = F.struct("conv_id", "turn", "message_id")
    met = met.withColumn("source", F.when(F.col("source") < mine, F.col("source")).when(F.col("anywhere") < mine, F.col("anywhere")))
    met = met.where("source is not null")
    # the whole run, its lines and its sentences are the same code points: the most of the three counts
    votes = met.groupBy("message_id", "level", "run", "source", "kind").agg(F.sum("size").alias("size"))
    votes = votes.groupBy("message_id", "level", "run", "source").agg(F.max("size").alias("size"))
    runs = votes.select("message_id", "run").distinct().groupBy("message_id").agg(F.count(F.lit(1)).alias("n_found"))
    votes = votes.groupBy("message_id", "level", "source").agg(F.sum("size").alias("size"))
    best = votes.groupBy("message_id").agg(F.max(F.when(F.col("level") == 1, F.struct("size", "source"))).alias("best")).join(runs, "message_id")
    return best.select("message_id", F.col("best.source.message_id").alias("quoted_id"), "n_found")


def conversations(messages: DataFrame) -> DataFrame:
    """Every message without its quotes, with its parent, thread and depth; order by thread, depth, turn to read.

    The parent is the message that is quoted, else the turn before in the same conversation. thread_conv and
    thread_turn name the first message of the thread. Null text is empty; a message without conversation or turn
    stands alone unless it quotes; repeated rows each stay. Columns other than conv_id, turn, role and text are not read.
    """
    table = store(parsed(messages), "messages")
    links = quote_links(table)
    parents = table.select("message_id").join(_previous(table), "message_id", "left").join(links, "message_id", "left")
    state = store(
        parents.select(
            "message_id", F.coalesce("quoted_id", "previous").alias("parent_id"), "quoted_id", F.coalesce("n_found", F.lit(0)).alias("n_found")
        ),
        "parents",
    )
    # pointer doubling: each round every message looks twice as far up its thread
    up = state.select("message_id", F.coalesce("parent_id", "message_id").alias("root"), F.col("parent_id").isNotNull().cast("long").alias("depth"))
    for _ in range(MAX_ROUNDS):
        above = up.select(F.col("message_id").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        step = store(up.join(above, "root").select("message_id", F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("d2") > 0).alias("moved")), "threads")
        up = step.select("message_id", "root", "depth")
        if step.where("moved").isEmpty():
            break
    else:
        raise RuntimeError(f"threads longer than {math.ldexp(1, MAX_ROUNDS):.0f} messages")
    name = lambda k: table.select(F.col("message_id").alias(k), F.col("conv_id").alias(f"{k}_conv"), F.col("turn").alias(f"{k}_turn"))
    out = table.join(state, "message_id").join(up, "message_id")
    out = out.join(name("root"), "root").join(name("parent_id"), "parent_id", "left")
    return out.select(
        "conv_id", "turn", "role", F.col("parent_id_conv").alias("parent_conv"), F.col("parent_id_turn").alias("parent_turn"),
        F.col("root_conv").alias("thread_conv"), F.col("root_turn").alias("thread_turn"), "depth", F.col("quote_level").cast("int").alias("quote_level"),
        "n_quoted", "n_found", F.col("quoted_id").isNotNull().alias("linked"), "own",
    )
