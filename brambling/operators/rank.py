"""Scoring, normalisation, fusion and feedback, for all queries of a batch at once.

Scores are rounded before they are ranked, and ties go to the smaller doc_id, so a
ranking is the same in any partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brambling.config import SearchSettings
from brambling.functions import vectors as V
from brambling.operators import index as I

DIGITS = 6


def query_terms(queries: DataFrame, analyse, text_col: str = "query") -> DataFrame:
    """query_id, term, qcount."""
    tokens = queries.select("query_id", F.explode(analyse(F.col(text_col))).alias("term"))
    return tokens.groupBy("query_id", "term").agg(F.count("*").alias("qcount"))


def matched_postings(corpus_: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, dl, tf of the terms alone: the term join comes before the shuffle
    that counts them, so that of the corpus only matching tokens are moved."""
    wanted = terms.select("term").distinct()
    tokens = corpus_.select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    return tokens.join(wanted, "term").groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))


def with_frequencies(matched: DataFrame) -> DataFrame:
    """matched_postings with df: all documents of a term are among them."""
    return matched.join(matched.groupBy("term").agg(F.count("*").alias("df")), "term")


def lexical(matched: DataFrame, terms: DataFrame, n: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75, raw_tf: bool = False, small: bool = False) -> DataFrame:
    """matched (term, doc_id, dl, tf, df), terms (query_id, term, qcount) -> query_id,
    doc_id, tfidf, bm25, both in one aggregation. TF-IDF sums qcount * tf / dl * ln(1 + n / df).
    BM25's term frequencies are shares of the length too, and the length normalises once
    more; ``raw_tf`` takes plain counts instead. ``small``: terms are known to be few."""
    n, avgdl, df, dl, plain = (c.cast("double") for c in (n, avgdl, F.col("df"), F.col("dl"), F.col("tf")))
    share = plain / dl
    tf = plain if raw_tf else share
    weight = (tf * (k1 + 1.0)) / (tf + F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * dl / avgdl))
    parts = {"tfidf": F.log(1 + n / df) * share, "bm25": F.log(1 + (n - df + 0.5) / (df + 0.5)) * weight}
    both = matched.join(F.broadcast(terms) if small else terms, "term")
    return both.groupBy("query_id", "doc_id").agg(*(F.round(F.sum(c * F.col("qcount")), DIGITS).alias(name) for name, c in parts.items()))


def one_score(scores: DataFrame, name: str) -> DataFrame:
    return scores.select("query_id", "doc_id", F.col(name).alias("score"))


def cosine_to_queries(embeddings: DataFrame, queries: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Dense vectors: (doc_id, embedding), (query_id, query_vector) -> query_id, doc_id,
    score of every document. The set of queries goes to the documents; documents aren't
    shuffled."""
    listed = queries.agg(F.collect_list(F.struct("query_id", "query_vector"))).scalar()
    each = embeddings.select("doc_id", "embedding", F.explode(listed).alias("q"))
    return each.select("q.query_id", "doc_id", F.round(V.cosine(F.col("embedding"), F.col("q.query_vector")), digits).alias("score"))


def dots_to_queries(vectors: DataFrame, listed: Column, only: str | None = None) -> DataFrame:
    """Vectors of length 1 (doc_id, embedding) and an array of (query_id, embedding) ->
    query_id, doc_id, score of all that share a dimension. No shuffle. ``only``: a column
    with the query ids that a document is wanted for."""
    each = vectors.withColumn("q", F.explode(listed))
    each = each if only is None else each.where(F.array_contains(only, F.col("q.query_id")))
    products = F.zip_with("embedding", "q.embedding", lambda x, y: x * y)
    each = each.select("q.query_id", "doc_id", products.alias("p")).where(F.exists("p", lambda x: x != 0))
    return each.select("query_id", "doc_id", F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), DIGITS).alias("score"))


def scaled(score: Column, low: Column, high: Column) -> Column:
    """Min-max, 1 where all are equal, 0 where there is no score."""
    return F.coalesce(F.when(score.isNotNull() & (high == low), F.lit(1.0)).otherwise((score - low) / (high - low)), F.lit(0.0))


def fused_near(scores: DataFrame, vectors: DataFrame, query_vectors: DataFrame, weights: Sequence[float], k: int | None) -> DataFrame:
    """query_id, doc_id, score: scores (query_id, doc_id, tfidf, bm25) and the nearness of
    vectors (doc_id, embedding) to those of the queries (query_id, embedding), each min-max
    normalised and weighted. With k only what can be among the first k is given: documents
    with any of the terms, and the k nearest; the others are summed up where they lie."""
    w = checked_weights(3, weights)
    listed = query_vectors.agg(F.collect_list(F.struct("query_id", "embedding"))).scalar()
    near = dots_to_queries(vectors, listed)
    ends = near.groupBy("query_id").agg(F.min("score").alias("low"), F.max("score").alias("high"))
    lexical_ends = scores.groupBy("query_id").agg(*(f(c).alias(f"{name}_{c}") for c in ("tfidf", "bm25") for name, f in (("low", F.min), ("high", F.max))))
    if k is not None:
        held = scores.select(F.col("query_id").alias("own"), "doc_id")
        mine = vectors.join(held, "doc_id")  # of few documents, each with the queries that it holds terms of
        mine = mine.groupBy("doc_id").agg(F.first("embedding").alias("embedding"), F.collect_set("own").alias("own"))
        own = dots_to_queries(mine, listed, "own")
        near = own.union(ranked(near, k).select("query_id", "doc_id", "score")).distinct()
    both = near.join(scores, ["query_id", "doc_id"], "full").join(ends, "query_id", "left").join(lexical_ends, "query_id", "left")
    parts = [scaled(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")) for c in ("tfidf", "bm25")] + [scaled(F.col("score"), F.col("low"), F.col("high"))]
    total = sum((p * F.lit(float(x)) for p, x in zip(parts, w)), F.lit(0.0))
    return both.select("query_id", "doc_id", F.round(total, DIGITS).alias("score"))


def cosine_sparse(vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """Sparse vectors of length 1: (doc_id, slot, w), (query_id, slot, w)."""
    q = query_vectors.select("query_id", "slot", F.col("w").alias("qw"))
    return vectors.join(q, "slot").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.col("qw")), DIGITS).alias("score"))


def normalise(scores: DataFrame, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """Min-max within each group; all equal: 1. Minima and maxima are aggregated before
    any shuffle and joined back, so that a group of all documents stays distributed.
    Not rounded: rounding twice would make ties of what is fused."""
    ends = scores.groupBy(*by).agg(F.min("score").alias("low"), F.max("score").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), F.lit(1.0)).otherwise((F.col("score") - F.col("low")) / (F.col("high") - F.col("low")))
    return scores.join(ends, list(by)).withColumn("score", scaled).drop("low", "high")


def checked_weights(n: int, weights: Sequence[float] | None) -> list[float]:
    """Equal ones if none are given, their number is wrong or their sum isn't 1."""
    if weights is None or len(weights) != n or not math.isclose(sum(weights), 1, rel_tol=1e-5, abs_tol=1e-8):
        return [1.0 / n] * n
    return list(weights)


def fuse(lists: Sequence[DataFrame], weights: Sequence[float] | None = None) -> DataFrame:
    """query_id, doc_id, score: the weighted sum; a document missing from a list adds 0."""
    out = None
    for scores, w in zip(lists, checked_weights(len(lists), weights), strict=True):
        part = scores.select("query_id", "doc_id", (F.col("score") * F.lit(float(w))).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), DIGITS).alias("score"))


def ranked(scores: DataFrame, k: int | None = 100, by: Sequence[str] = ("query_id",)) -> DataFrame:
    """With ``rank`` from 1; only the first k are kept before the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("doc_id"))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def feedback_documents(scores: DataFrame, settings: SearchSettings = SearchSettings()) -> DataFrame:
    """query_id, doc_id: the first documents; ``feedback_random`` from the rest come by seeded hash."""
    top = ranked(scores, settings.feedback_docs).select("query_id", "doc_id")
    if settings.feedback_random:
        rest = ranked(scores, None).where(F.col("rank") > settings.feedback_docs)
        draw = F.xxhash64("query_id", "doc_id", F.lit(settings.seed))
        rest = rest.withColumn("draw", F.row_number().over(Window.partitionBy("query_id").orderBy(draw, "doc_id")))
        top = top.unionByName(rest.where(F.col("draw") <= settings.feedback_random).select("query_id", "doc_id"))
    return top


def feedback_terms(top: DataFrame, corpus_: DataFrame, settings: SearchSettings = SearchSettings(), small: bool = False) -> DataFrame:
    """query_id, term, freq: the most frequent terms of the documents top, ties by term."""
    terms = corpus_.join(F.broadcast(top) if small else top, "doc_id").select("query_id", F.explode("tokens").alias("term"))
    counts = terms.groupBy("query_id", "term").agg(F.count("*").alias("freq"))
    w = Window.partitionBy("query_id").orderBy(F.desc("freq"), F.asc("term"))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= settings.feedback_terms).drop("place")


def expand(terms: Column, neighbours: Column | None = None) -> Column:
    """Distinct terms in order, with those of a neighbour table's column, if any."""
    return F.array_distinct(terms) if neighbours is None else F.array_union(terms, neighbours)


def neighbours(terms: DataFrame, vectors: DataFrame, k: int = 5, above: float = 0.7, digits: int = DIGITS) -> DataFrame:
    """terms (query_id, query_vector), vectors (doc_id, embedding) of a vocabulary -> the k
    nearest of each above a similarity, for ``expand``."""
    near = cosine_to_queries(vectors, terms, digits)
    return ranked(near.where(F.col("score") > above), k)


def concat(lists: Sequence[DataFrame]) -> DataFrame:
    """All rows of all lists, where nothing weighs them."""
    out = lists[0]
    for scores in lists[1:]:
        out = out.unionByName(scores)
    return out


def top_terms(corpus_: DataFrame, k: int = 10) -> DataFrame:
    """doc_id, term, freq, place of each document's most frequent terms, ties by first place."""
    tokens = corpus_.select("doc_id", F.posexplode("tokens").alias("pos", "term"))
    counts = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("freq"), F.min("pos").alias("first"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("freq"), F.asc("first"))
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("doc_id", "term", "freq", "place")


def hashed_query_vectors(terms: DataFrame) -> DataFrame:
    return I.hashed_vectors(terms.withColumnRenamed("qcount", "tf"), "query_id")
