"""Connected components of an edge table, by contraction.

Each round every component hooks on to its smallest neighbour, chains of hooks are
shortened by pointer jumping, and edges are rewritten between the merged components; the
components that still have edges at least halve. All steps are joins and partial
aggregations of stored tables, so a hub's edges can be split over tasks, nothing is
collected but row counts, and every round can start again from its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of long ids, not null -> (id, comp) for each id with an edge; comp is
    the smallest id of the component. Repeated edges and loops change nothing."""
    spark = edges.sparkSession
    edges = base.stored(edges.select("a", "b").where("a <> b").distinct(), "edges")
    ids = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct()
    labels = base.stored(ids.withColumn("comp", F.col("id")), "labels")
    live = edges
    while live.head(1):
        both = live.select("a", "b").union(live.select("b", "a"))
        # (id, up): up is the smallest neighbour, where it is smaller.
        hooks = base.stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("up")).where("up < id"), "hooks")
        while True:
            above = hooks.select(F.col("id").alias("up"), F.col("up").alias("top"))
            jumped = base.stored(hooks.join(above, "up", "left").select("id", F.coalesce("top", "up").alias("up"), F.col("top").isNotNull().alias("moved")), "hooks")
            moved = jumped.where("moved").head(1)
            base.delete(spark, hooks)
            hooks = jumped.select("id", "up")
            if not moved:
                break
        roots = hooks.select(F.col("id").alias("comp"), "up")
        old, labels = labels, base.stored(labels.join(roots, "comp", "left").select("id", F.coalesce("up", "comp").alias("comp")), "labels")
        base.delete(spark, old)
        ends_a, ends_b = hooks.select(F.col("id").alias("a"), F.col("up").alias("ua")), hooks.select(F.col("id").alias("b"), F.col("up").alias("ub"))
        merged = live.join(ends_a, "a", "left").select(F.coalesce("ua", "a").alias("a"), "b")
        merged = merged.join(ends_b, "b", "left").select("a", F.coalesce("ub", "b").alias("b")).where("a <> b")
        old, live = live, base.stored(merged.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        base.delete(spark, old, hooks)
    return labels
