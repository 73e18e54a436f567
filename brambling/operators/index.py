"""Inverted index: postings, lengths, statistics, hashed embeddings, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brambling.functions import text as T
from brambling.operators.topics import dealt_topics

DIMENSIONS = 64
#: Topics x terms that the ML library fits, 80 MB a copy.
LIBRARY_VALUES = 10_000_000


def corpus(docs: DataFrame, analyse=T.analyse, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, tokens."""
    return docs.select(F.col(id_col).alias("doc_id"), analyse(F.col(text_col)).alias("tokens"))


def postings(corpus_: DataFrame) -> DataFrame:
    """term, doc_id, tf. Counts are combined before the shuffle."""
    return corpus_.select("doc_id", F.explode("tokens").alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_lengths(corpus_: DataFrame) -> DataFrame:
    return corpus_.select("doc_id", F.size("tokens").cast("long").alias("dl"))


def document_frequencies(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(corpus_: DataFrame) -> DataFrame:
    """One row: n, total, avgdl (over all documents, empty ones too)."""
    out = corpus_.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("total"))
    return out.withColumn("avgdl", F.try_divide(F.col("total").cast("double"), F.col("n").cast("double")))


def grouped_postings(postings_: DataFrame) -> DataFrame:
    """term, df and its postings as one array, for export."""
    return postings_.groupBy("term").agg(F.count("*").alias("df"), F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def hash_slot(term: Column, dimensions: int = DIMENSIONS) -> tuple[Column, Column]:
    """(slot, sign) of a term, from its MD5."""
    digest = F.md5(term)
    slot = F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(dimensions)).cast("int")
    return slot, F.when(F.pmod(F.conv(F.substring(digest, 9, 4), 16, 10).cast("long"), F.lit(2)) == 0, 1.0).otherwise(-1.0)


def hashed_vectors(counts: DataFrame, id_col: str = "doc_id", weight: str = "tf") -> DataFrame:
    """id, slot, w: sparse hashed embeddings of length 1, the default where no sentence
    model is plugged in. Zero slots and vectors have no rows."""
    slot, sign = hash_slot(F.col("term"))
    slots = counts.groupBy(id_col, slot.alias("slot")).agg(F.sum(sign * F.col(weight)).alias("v")).where("v <> 0")
    lengths = slots.groupBy(id_col).agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return slots.join(lengths, id_col).select(id_col, "slot", (F.col("v") / F.col("len")).alias("w"))


def dense_vectors(sparse: DataFrame, id_col: str = "doc_id", dimensions: int = DIMENSIONS) -> DataFrame:
    """id, embedding array<double>."""
    held = sparse.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return held.select(id_col, every.alias("embedding"))


def topic_distributions(docs: DataFrame, topics: int = 100, max_iter: int = 20, vocabulary: int | None = None, min_df: float = 2.0, seed: int = 0, text_col: str = "text") -> DataFrame:
    """doc_id, topics array<double>: LDA over count vectors of all terms, or of the
    ``vocabulary`` most frequent ones. An empty corpus has no topics. The ML library's driver
    holds topics x terms; all terms beyond ``LIBRARY_VALUES`` are dealt over the executors."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    tokens = docs.select("doc_id", T.vector_terms(F.col(text_col)).alias("tokens"))
    if not tokens.where(F.size("tokens") > 0).head(1):
        return docs.select("doc_id", F.array().cast("array<double>").alias("topics")).limit(0)
    if vocabulary is None:
        each = tokens.select(F.explode("tokens").alias("term"))
        terms, words = each.agg(F.approx_count_distinct("term"), F.count("*")).first()
        if terms * topics > LIBRARY_VALUES:
            return dealt_topics(tokens, topics, max_iter, words, terms, min_df, seed)
    counts = CountVectorizer(inputCol="tokens", outputCol="features", vocabSize=vocabulary or 2**31 - 1, minDF=min_df).fit(tokens).transform(tokens)
    model = LDA(k=topics, seed=seed, maxIter=max_iter).fit(counts)
    return model.transform(counts).select("doc_id", vector_to_array("topicDistribution").alias("topics"))
