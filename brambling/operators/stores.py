"""Stores as flat tables: insert, upsert, replace and delete as joins of two tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brambling.functions import urls as U


def insert_absent(store: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are there keep their old rows."""
    return store.unionByName(rows.join(store.select(*key), list(key), "left_anti"))


def upsert(store: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that are there get their new rows."""
    return store.join(rows.select(*key), list(key), "left_anti").unionByName(rows)


def delete(store: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    return store.join(rows.select(*key).distinct(), list(key), "left_anti")


def numbered(rows: DataFrame, order: str, name: str, store=DataFrame.persist) -> DataFrame:
    """With ``name`` from 0 in order. Rows are dealt out by ranges and numbered in each; the
    ranges' sizes shift them, so no task has all rows. ``store`` keeps the dealt rows."""
    dealt = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__id", F.monotonically_increasing_id())
    dealt = store(dealt)
    part = F.shiftright("__id", 33)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))  # a row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    placed = dealt.join(F.broadcast(sizes), part == F.col("__part"))
    return placed.withColumn(name, F.col("__before") + F.col("__id").bitwiseAND(F.lit(2**33 - 1))).drop("__id", "__part", "__before")


def with_ids(rows: DataFrame, last_id: int, order: str = "seq", store=DataFrame.persist) -> DataFrame:
    """doc_id = last id + place in order."""
    return numbered(rows, order, "doc_id", store).withColumn("doc_id", F.col("doc_id") + F.lit(last_id + 1))


def frontier_add(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """frontier: section, domain, url, priority, enqueue_seq; urls: url, priority, seq.
    A known IN domain takes its urls, others go OUT; a url that is there keeps its place and
    gets the last priority."""
    last = frontier.agg(F.coalesce(F.max("enqueue_seq"), F.lit(-1))).scalar()
    new = urls.groupBy("url").agg(F.max_by("priority", "seq").alias("priority"), F.min("seq").alias("seq"))
    new = new.withColumn("domain", U.netloc(F.col("url")))
    inside = frontier.where("section = 'IN'").select("domain", F.lit(True).alias("inside")).distinct()
    new = new.join(inside, "domain", "left").select(
        F.when(F.col("inside"), "IN").otherwise("OUT").alias("section"), "domain", "url", "priority", (F.col("seq") + last + 1).alias("enqueue_seq")
    )
    old = frontier.select("section", "url", F.col("enqueue_seq").alias("old_seq"))
    new = new.join(old, ["section", "url"], "left").withColumn("enqueue_seq", F.coalesce("old_seq", "enqueue_seq")).drop("old_seq")
    return upsert(frontier, new.select(*frontier.columns), ["section", "url"])


def frontier_aged(frontier: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Urls that no page of a cycle mentions have their priority counted up."""
    seen = mentioned.select("url", F.lit(1).alias("__seen")).distinct()
    aged = F.col("priority") + F.when(F.col("__seen").isNull(), 1).otherwise(0)
    return frontier.join(seen, "url", "left").withColumn("priority", aged.cast("int")).select(*frontier.columns)


def frontier_remove(frontier: DataFrame, urls: DataFrame) -> DataFrame:
    """A domain that is OUT loses its urls there, else IN."""
    gone = urls.select("url", U.netloc(F.col("url")).alias("domain")).distinct()
    out = frontier.where("section = 'OUT'").select("domain", F.lit("OUT").alias("section")).distinct()
    gone = gone.join(out, "domain", "left").select("url", F.coalesce("section", F.lit("IN")).alias("section"))
    return delete(frontier, gone, ["section", "url"])


def visited_update(visited: DataFrame, domains: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events: url, is_english, skipped, seq. The last skipped flag of a url holds; a domain
    is English once any of its pages was. Returns (visited, domains)."""
    events = events.withColumn("domain", U.netloc(F.col("url")))
    urls = events.groupBy("domain", "url").agg(F.max_by("skipped", "seq").alias("skipped"))
    english = domains.unionByName(events.select("domain", F.col("is_english").alias("eng"))).groupBy("domain").agg(F.bool_or("eng").alias("eng"))
    return upsert(visited, urls.select(*visited.columns), ["domain", "url"]), english


def unseen(urls: DataFrame, visited: DataFrame, url_col: str = "url") -> DataFrame:
    seen = visited.select(F.col("domain").alias("__d"), F.col("url").alias("__u"))
    return urls.join(seen, (U.netloc(F.col(url_col)) == F.col("__d")) & (F.col(url_col) == F.col("__u")), "left_anti")
