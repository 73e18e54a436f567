"""Chat formatting: multi-party perspective rotation.

A conversation is rendered once for every participant: that speaker's turns are the
assistant's, all others are users of their own names, and the mask spans cover just the
assistant's words with their end marks, the part a model is trained on.

Turns are put in order (turn, role, text; nulls first) by one range partitioning over all
conversations; a turn's position comes from its partition's counts. A rendering is cut
into parts of ``PART_TURNS`` turns, so that a conversation of any length never meets in
one task; parts in order join up to the whole, and nearly all conversations have one.
``part_start`` is where a part's text begins in the whole rendering, and a mask span plus
``part_start`` is its place there: sums over parts, in blocks of ``BLOCK_PARTS`` of them.

Defined results: marks within a role or text stay as they are, as spans go by place and
not by marks; a null role is the name '' and a null text is empty; turns of a null
conv_id form one conversation; repeated rows are repeated turns; extra columns are
ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import base

PART_TURNS, BLOCK_PARTS = 64, 4096
OWN_HEAD, USER_HEAD, END = "<|assistant|>\n", ("<|user:", "|>\n"), "<|end|>"


def positions(turns: DataFrame) -> DataFrame:
    """conv_id, role, text and pos, the place of the turn in its conversation from 0."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The id numbers the rows of each partition in order; stored, so that it stays.
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    rows = base.stored(rows.withColumn("part", F.shiftright("id", 33)), "turns")
    # A conversation has one row here for each partition it reaches into.
    runs = rows.groupBy("conv_id", "part").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"), "first", "before"
    )
    placed = rows.join(runs, rows.conv_id.eqNullSafe(runs.c) & (rows.part == runs.p))
    return placed.select("conv_id", "role", "text", (F.col("id") - F.col("first") + F.col("before")).alias("pos"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, speaker, part, part_start, n_turns, text, mask (array of start, end in
    characters of ``text``)."""
    placed = positions(turns)
    grouped = placed.groupBy("conv_id", F.floor(F.col("pos") / part_turns).alias("part")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "role", "text"))).alias("turns")
    )
    speakers = turns.select(
        F.col("conv_id").cast("long").alias("c"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("speaker")
    ).distinct()
    both = grouped.join(speakers, grouped.conv_id.eqNullSafe(speakers.c))

    def head(t):
        return F.when(t["role"] == F.col("speaker"), F.lit(OWN_HEAD)).otherwise(F.concat(F.lit(USER_HEAD[0]), t["role"], F.lit(USER_HEAD[1])))

    def step(acc, t):
        begin = acc["at"] + F.length(head(t))
        end = begin + F.length(t["text"]) + len(END)
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(
            (end + 1).alias("at"), F.when(t["role"] == F.col("speaker"), F.concat(acc["mask"], F.array(span))).otherwise(acc["mask"]).alias("mask")
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("mask"))
    starts = part_starts(placed, part_turns)
    both = both.join(starts, both.conv_id.eqNullSafe(starts.sc) & (both.speaker == starts.ss) & (both.part == starts.sp), "left")
    return both.select(
        "conv_id", "speaker", F.col("part").cast("long").alias("part"), F.coalesce("start", F.lit(0)).cast("long").alias("part_start"),
        F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))), "").alias("text"),
        F.aggregate("turns", start, step, lambda a: a["mask"]).alias("mask"),
    )


def part_starts(placed: DataFrame, part_turns: int) -> DataFrame:
    """(sc, ss, sp, start) of conversations of several parts: numbers alone, no texts."""
    part = F.floor(F.col("pos") / part_turns)
    user = sum(map(len, USER_HEAD)) + F.length("role")
    long = placed.where(F.col("pos") >= part_turns).select(F.col("conv_id").alias("lc")).distinct()
    own = placed.join(long, placed.conv_id.eqNullSafe(long.lc), "left_semi")
    roles = own.groupBy("conv_id", part.alias("part"), "role").agg(F.count("*").alias("n"), F.sum(user + F.length("text") + len(END) + 1).alias("chars"))
    parts = roles.groupBy("conv_id", "part").agg(F.sum("chars").alias("chars"))
    speakers = roles.select(F.col("conv_id").alias("sc"), F.col("role").alias("ss")).distinct()
    # A speaker's own turns have the assistant's head in place of the user's.
    less = roles.select(F.col("conv_id").alias("oc"), F.col("part").alias("op"), F.col("role").alias("os"), (F.col("n") * (len(OWN_HEAD) - user)).alias("more"))
    each = parts.join(speakers, parts.conv_id.eqNullSafe(speakers.sc))
    each = each.join(less, each.sc.eqNullSafe(less.oc) & (each.part == less.op) & (each.ss == less.os), "left")
    each = each.select("sc", "ss", F.col("part").alias("sp"), (F.col("chars") + F.coalesce("more", F.lit(0))).alias("chars"), F.floor(F.col("part") / BLOCK_PARTS).alias("block"))
    blocks = each.groupBy("sc", "ss", "block").agg(F.sum("chars").alias("chars"))
    ahead = Window.partitionBy("sc", "ss").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("sc").alias("bc"), F.col("ss").alias("bs"), F.col("block").alias("bb"), F.coalesce(F.sum("chars").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("sc", "ss", "block").orderBy("sp").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("own", F.coalesce(F.sum("chars").over(within), F.lit(0)))
    each = each.join(blocks, each.sc.eqNullSafe(blocks.bc) & (each.ss == blocks.bs) & (each.block == blocks.bb))
    return each.select("sc", "ss", "sp", (F.col("own") + F.col("ahead")).alias("start"))


def op9_chat_rotation(spark, sf_dir: str) -> DataFrame:
    out = rotate(base.table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["end"].cast("string")))
    return out.withColumn("mask", F.array_join(spans, ","))


ORACLE = {
    "op9_chat_rotation": """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS pos
  FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t),
r AS (
  SELECT t.conv_id, s.speaker, t.pos, (t.pos // 64)::BIGINT AS part, t.role = s.speaker AS own,
         CASE WHEN t.role = s.speaker THEN '<|assistant|>' || chr(10) ELSE '<|user:' || t.role || '|>' || chr(10) END AS head,
         t.text || '<|end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part ORDER BY pos
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begin_at FROM r),
p AS (
  SELECT conv_id, speaker, part, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY pos) AS text,
       coalesce(string_agg(begin_at::BIGINT || ':' || (begin_at + length(body))::BIGINT, ',' ORDER BY pos) FILTER (own), '') AS mask
  FROM o GROUP BY conv_id, speaker, part)
SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS part_start
FROM p
"""
}
