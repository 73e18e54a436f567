"""The crawl loop as a stream of page files.

A micro-batch is a crawl cycle; its rate is the number of files a trigger takes, its
restart point the checkpoint. Stores are written as a new version for each batch, so a
batch that runs again writes the same version again.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from brambling import config
from brambling.operators.crawl import schedule
from brambling.plans.ingest import ingest
from brambling.sources import stores

SCHEMAS = {
    "meta": stores.META, "corpus": stores.CORPUS, "frontier": stores.FRONTIER, "visited": stores.VISITED,
    "domains": stores.DOMAINS, "frequencies": stores.FREQUENCIES,
}


def page_stream(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string", files: int = config.CrawlSettings.bucket_capacity) -> DataFrame:
    """At most ``files`` page files a trigger: the token bucket's capacity."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def first_of_url(pages: DataFrame, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each url once; with a time column the remembered urls are bounded by the delay."""
    if time is None:
        return pages.dropDuplicates(["url"])
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url"])


def load_state(spark: SparkSession, root: str, version: int) -> dict[str, DataFrame]:
    return {name: stores.read_table(spark, f"{root}/v={version}/{name}", schema) for name, schema in SCHEMAS.items()}


def cycle(root: str, terms=config.TOPIC_TERMS) -> Callable[[DataFrame, int], None]:
    def run(pages: DataFrame, batch: int) -> None:
        spark, count = pages.sparkSession, itertools.count()
        state = load_state(spark, root, batch - 1)

        def store(df: DataFrame) -> DataFrame:
            """Written beside the version's stores, so that a lost executor repeats nothing."""
            path = f"{root}/v={batch}/_steps/{next(count)}"
            stores.write_table(df, path)
            return spark.read.schema(df.schema).parquet(path)

        for name, df in ingest(pages, state, terms, store).items():
            stores.write_table(df, f"{root}/v={batch}/{name}")
        # What the next cycle would fetch, in the order of its turns.
        frontier = stores.read_table(spark, f"{root}/v={batch}/frontier", SCHEMAS["frontier"])
        stores.write_table(schedule(frontier, cursor=batch), f"{root}/v={batch}/scheduled")

    return run


def crawl(pages: DataFrame, root: str, checkpoint: str, terms=config.TOPIC_TERMS) -> StreamingQuery:
    """Run all that is there, a batch at a time, and stop."""
    return pages.writeStream.foreachBatch(cycle(root, terms)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_version(spark: SparkSession, root: str) -> int:
    """-1 if no batch was written yet."""
    try:
        rows = spark.read.option("basePath", root).schema("domain string, eng boolean, v int").parquet(f"{root}/v=*/domains")
    except AnalysisException:
        return -1
    return max((int(f.split("/v=")[1].split("/")[0]) for f in rows.inputFiles()), default=-1)
