"""Diversified rankings: round-robin over clusters and topics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brambling.config import SearchSettings
from brambling.functions import vectors as V
from brambling.operators.rank import DIGITS, checked_weights, ranked

#: Up to so many rows are fitted by the ML library.
LIBRARY_ROWS = 2500
#: Rows of a task, and centres that are compared at once.
TASK_ROWS, CENTRES = 2048, 2048


def interleave(scores: DataFrame, group: str, k: int = 100) -> DataFrame:
    """query_id, doc_id, score, place: groups in the order of their best members, each
    giving its next best in turn. With k groups or more only their heads can be among the
    first k rows, so each group is cut to its first k before the second window."""
    order = (F.desc("score"), F.asc("doc_id"))
    own = Window.partitionBy("query_id", group)
    turns = scores.withColumn("turn", F.row_number().over(own.orderBy(*order))).where(F.col("turn") <= k)
    turns = turns.withColumns({"best": F.max("score").over(own), "head": F.min(F.when(F.col("turn") == 1, F.col("doc_id"))).over(own)})
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc("turn"), F.desc("best"), F.asc("head")))
    return turns.withColumn("place", place).where(F.col("place") <= k).select("query_id", "doc_id", "score", "place")


def cluster_count(n: int, share: float) -> int:
    return min(n, max(3, int(n * share)))


def _nearest(x, centres, lengths):
    """For each row its nearest centre, the first of equals, and the square of the distance."""
    own, best, at = np.einsum("ij,ij->i", x, x), np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for of in range(0, len(centres), CENTRES):
        d = lengths[of : of + CENTRES] - 2 * (x @ centres[of : of + CENTRES].T)
        i = d.argmin(axis=1)
        nearer = d[rows, i] < best
        best[nearer], at[nearer] = d[rows, i][nearer], i[nearer] + of
    # What rounding leaves between equal vectors is nothing.
    return at, np.where(best + own > 1e-12 * own, best + own, 0.0)


def _matrix(column):
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _with_nearest(rows: DataFrame, centres, schema: str, out) -> DataFrame:
    """rows: doc_id, x. out makes a batch of ids, vectors, nearest centres and distances."""
    held = rows.sparkSession.sparkContext.broadcast((centres, np.einsum("ij,ij->i", centres, centres)))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1))
                yield pa.RecordBatch.from_arrays(*out(batch, x, *_nearest(x, *held.value)))

    return rows.mapInArrow(run, schema)


def _first_centres(rows: DataFrame, id_type: str, k: int, seed: int, rounds: int = 8):
    """k rows, far ones sooner, in rounds: each draws its share by the square of the distance
    from those drawn before (k-means++, many at a time). Fewer if fewer rows differ."""
    draw = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    centres = _matrix(rows.orderBy(draw, "doc_id").limit(1).toArrow().column("x").combine_chunks())
    while len(centres) < k:
        d = _with_nearest(rows, centres, f"doc_id {id_type}, x array<double>, d double", lambda b, x, at, d: ([b.column(0), b.column(1), pa.array(d)], ["doc_id", "x", "d"]))
        share = min(max(1, -(-k // rounds)), k - len(centres))
        drawn = d.where("d > 0").orderBy(-F.log(draw) / F.col("d"), "doc_id").limit(share).select("x").toArrow().column("x").combine_chunks()
        if not len(drawn):
            break
        centres = np.unique(np.vstack([centres, _matrix(drawn)]), axis=0)
    return centres


def _moved(rows: DataFrame, centres):
    """The means of the rows of each centre; one without rows stays."""

    def sums(batch, x, at, d):
        own, place = np.unique(at, return_inverse=True)
        total = np.zeros((len(own), x.shape[1] + 1))
        np.add.at(total, place, np.hstack([x, np.ones((len(x), 1))]))
        return [pa.array(own), pa.array([r.tobytes() for r in total], pa.binary())], ["centre", "total"]

    found = _with_nearest(rows, centres, "centre long, total binary", sums).toArrow()
    total = np.zeros((len(centres), centres.shape[1] + 1))
    values = np.frombuffer(b"".join(found.column("total").to_pylist()), float).reshape(-1, total.shape[1])
    np.add.at(total, found.column("centre").to_numpy(), values)
    return np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)


def blocked_kmeans(embeddings: DataFrame, k: int, n: int, seed: int = 0, most_rounds: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """doc_id, cluster: Lloyd's rounds as products of matrices, block by block. The driver
    holds the centres; each round compares all rows with all of them."""
    id_type = embeddings.schema["doc_id"].dataType.simpleString()
    plain = embeddings.select("doc_id", V.doubles(F.col("embedding")).alias("x"))
    rows = plain.repartition(-(-n // TASK_ROWS)).persist()
    try:
        centres = _first_centres(rows, id_type, k, seed)
        for _ in range(most_rounds):
            centres, before = _moved(rows, centres), centres
            if np.max(np.square(centres - before).sum(axis=1)) <= tolerance**2:
                break
    finally:
        rows.unpersist()
    plain = plain.repartition(-(-n // TASK_ROWS))
    return _with_nearest(plain, centres, f"doc_id {id_type}, cluster int", lambda b, x, at, d: ([b.column(0), pa.array(at, pa.int32())], ["doc_id", "cluster"]))


def kmeans_clusters(embeddings: DataFrame, share: float = 0.5, most: int | None = None, seed: int = 0) -> DataFrame:
    """doc_id, cluster: k = max(3, share * n), at most the number of rows (and ``most``,
    if given). The ML library draws its first centres on the driver, in a time that grows
    with the square of k; beyond ``LIBRARY_ROWS`` rows they are drawn in blocks."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = embeddings.count()
    if n == 0:
        return embeddings.select("doc_id", F.lit(0).alias("cluster"))
    rows = embeddings.select("doc_id", array_to_vector(V.doubles(F.col("embedding"))).alias("features"))
    if n == 1:
        return rows.select("doc_id", F.lit(0).alias("cluster"))
    k = cluster_count(n, share)
    k = k if most is None else min(most, k)
    if n > LIBRARY_ROWS:
        return blocked_kmeans(embeddings, k, n, seed)
    model = KMeans(k=k, seed=seed).fit(rows)
    return model.transform(rows).select("doc_id", F.col("prediction").alias("cluster"))


def topic_of(topics: DataFrame, least_likely: bool = True) -> DataFrame:
    """doc_id, topic: the place of the smallest share (or of the largest)."""
    return topics.select("doc_id", (V.argmin if least_likely else V.argmax)(F.col("topics")).alias("topic"))


def combine(by_cluster: DataFrame, by_topic: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """query_id, doc_id, score, rank: weighted sum of both lists, best first."""
    wc, wt = checked_weights(2, (settings.cluster_weight, settings.topic_weight))
    both = by_cluster.select("query_id", "doc_id", (F.col("score") * wc).alias("score")).unionByName(
        by_topic.select("query_id", "doc_id", (F.col("score") * wt).alias("score"))
    )
    return ranked(both.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score")), settings.results)


def diversify(scores: DataFrame, clusters: DataFrame, topics: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """scores: query_id, doc_id, score; clusters: doc_id, cluster; topics: doc_id, topic."""
    by_cluster = interleave(scores.join(clusters, "doc_id"), "cluster", settings.results)
    by_topic = interleave(scores.join(topics, "doc_id"), "topic", settings.results)
    return combine(by_cluster, by_topic, settings)
