"""From raw documents to a token store: toxicity, near-duplicates, benchmark passages,
source mix and token ids, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brambling.llm import base, decontaminate, mixing, near_duplicates, token_store, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, base.table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, base.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(docs, mixing.WEIGHTS, epochs=mixing.EPOCHS).select(*docs.columns)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_store.verify_store(spark, token_store.write_store(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("tokens", store_tokens),
]
#: Models and sketches have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = base.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
