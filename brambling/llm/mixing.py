"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its share of the weights, times the size of
the mix, over its own number of documents. A document's count is the inverse of the
Poisson distribution with that mean at a uniform number hashed from the seed and its id,
so the same document always gets the same count, and no random state is kept anywhere.
Documents are exploded by their counts and dealt into a global order by a second hash.

Defined results: a null source counts as the source ''; a null id hashes like the text
'null'; repeated rows are repeated equally; an empty table gives an empty one; a source
of weight 0 goes; any rate is drawn, as one row of a source
may stand for many. The columns ``copy_no`` and ``shuffle_key`` replace any of those names;
all other columns stay, whatever their names.
The hash decides the partition directly, so no sampling pass and no hot partition: a hot
source is spread like all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: Rates above this would underflow exp(-rate); their chances are summed about the mean.
FAR_RATE = 500.0
#: Up to so many sources and chances the table of rates is broadcast; else it is joined by shuffle.
BROADCAST_SOURCES, BROADCAST_CHANCES = 20_000, 16_000_000
BITS = 52


def uniform(*parts):
    """A number in [0, 1) of 52 bits, from the MD5 of the parts."""
    return hashed(*parts).cast("double") / F.lit(float(2**BITS))


def hashed(*parts):
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


def far_chances(rate: float) -> tuple[int, np.ndarray]:
    """The least count of any weight, and the chances of at most so many repetitions from
    there on. Counts beyond 12 deviations have chances below any number drawn."""
    least, last = int(rate - 12 * rate**0.5), int(rate + 12 * rate**0.5 + 30)
    logs = np.cumsum(np.log(rate / np.arange(least + 1, last + 1)))
    p = np.exp(np.concatenate([[0.0], logs]) - logs.max())
    return least, np.cumsum(p) / p.sum()


def far_rates(per: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [far_chances(r) for r in batch.column("rate").to_pylist()]
            first, cdf = pa.array([f for f, _ in found], pa.int32()), pa.array([c for _, c in found], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("source", "n", "rate")), first, cdf], ["source", "n", "rate", "first", "cdf"])

    return per.mapInArrow(run, "source string, n long, rate double, first int, cdf array<double>")


def source_rates(docs: DataFrame, weights: dict[str, float], default_weight: float, epochs: float, source_col: str) -> DataFrame:
    """(source, n, rate, first, cdf): cdf[k] is the chance of at most first + k repetitions."""
    spark = docs.sparkSession
    per = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    per = base.stored(per.withColumn("weight", weight), "sources")
    rows, total, most = per.agg(F.sum("n"), F.sum("weight"), F.max(F.col("weight") / F.col("n"))).first()
    if not total:
        return spark.createDataFrame([], "source string, n long, rate double, first int, cdf array<double>")
    rate = F.lit(float(epochs)) * F.lit(rows) * F.col("weight") / F.lit(float(total)) / F.col("n")
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 30).cast("int")
    start = F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc, k):
        p = acc["p"] * F.col("rate") / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    per = per.select("source", "n", rate.alias("rate"))
    cdf = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda a: a["cdf"]).alias("cdf")
    columns = ("source", "n", "rate", F.lit(0).alias("first"), cdf)
    if epochs * rows * most / total <= FAR_RATE:
        return per.select(*columns)
    return per.where(F.col("rate") <= FAR_RATE).select(*columns).union(far_rates(per.where(F.col("rate") > FAR_RATE)))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, epochs: float = 1.0,
                seed: str = "mix-1", id_col: str = "doc_id", source_col: str = "source", partitions: int | None = None) -> DataFrame:
    """The documents, each ``copy_no`` = 1.. up to its count, in the global order of
    ``shuffle_key`` (ties: by id and copy). ``epochs``: rows of the mix over rows of docs."""
    spark = docs.sparkSession
    own = [c for c in docs.columns if c.lower() not in ("copy_no", "shuffle_key")]
    source, first, cdf, u, count = (base.free_name(docs, c) for c in ("__source", "__first", "__cdf", "__u", "__count"))
    with base.scratch(spark):
        rates = source_rates(docs, weights or {}, default_weight, epochs, source_col)
        rates = base.stored(rates.select(F.col("source").alias(source), F.col("first").alias(first), F.col("cdf").alias(cdf)), "rates", keep=True)
    sources, chances = rates.agg(F.count("*"), F.sum(F.size(cdf))).first()
    if sources <= BROADCAST_SOURCES and (chances or 0) <= BROADCAST_CHANCES:
        rates = F.broadcast(rates)
    keyed = docs.select(*own).withColumns({source: F.coalesce(F.col(source_col).cast("string"), F.lit("")), u: uniform(F.lit(seed), F.col(id_col))})
    joined = keyed.join(rates, source)
    counted = joined.withColumn(count, F.col(first) + F.size(F.filter(cdf, lambda c: c <= F.col(u)))).where(F.col(count) > 0)
    copies = counted.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(count))))
    keyed = copies.withColumn("shuffle_key", hashed(F.lit(f"{seed}|order"), F.col(id_col), F.col("copy_no"))).select(*own, "copy_no", "shuffle_key")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = F.floor(F.col("shuffle_key").cast("double") / F.lit(float(2**BITS)) * n).cast("int")
    return keyed.repartitionById(n, place).sortWithinPartitions("shuffle_key", id_col, "copy_no")


#: The mix of the registered query: two sources above the rest, the others alike.
WEIGHTS = {"src1": 2.0, "src2": 1.5}
EPOCHS = 1.2


def op3_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return poisson_mix(base.table(spark, sf_dir, "documents"), WEIGHTS, epochs=EPOCHS)


ORACLE_MIX = """
WITH RECURSIVE src AS (
  SELECT coalesce(source, '') AS s, count(*) AS n,
         CASE coalesce(source, '') WHEN 'src2' THEN 1.5e0 WHEN 'src1' THEN 2e0 ELSE 1e0 END AS w
  FROM {docs} GROUP BY 1),
rate AS (SELECT s, {epochs}::DOUBLE * (SELECT sum(n) FROM src)::DOUBLE * w / (SELECT sum(w) FROM src) / n AS rate FROM src),
pois AS (
  SELECT s, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rate
  UNION ALL
  SELECT s, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM pois WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
counted AS (
  SELECT d.*, (SELECT count(*) FROM pois WHERE pois.s = coalesce(d.source, '')
     AND pois.c <= ('0x' || substr(md5('mix-1|' || coalesce(d.doc_id::VARCHAR, 'null')), 1, 13))::BIGINT / 4503599627370496e0) AS cnt
  FROM {docs} d),
copies AS (SELECT doc_id, text, lang, source, n_chars, unnest(generate_series(1, cnt))::INTEGER AS copy_no FROM counted)
SELECT *, ('0x' || substr(md5('mix-1|order|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy_no), 1, 13))::BIGINT AS shuffle_key
FROM copies
"""
ORACLE = {"op3_poisson_mix": ORACLE_MIX.format(docs="documents", epochs=EPOCHS)}
