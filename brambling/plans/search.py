"""Search and index plans: all queries of a batch in one plan, over a stored index or over
a corpus as it is."""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brambling.config import SearchSettings
from brambling.functions import text as T
from brambling.operators import diversify as D
from brambling.operators import index as I
from brambling.operators import rank as R
from brambling.sources import stores

#: Terms and feedback documents of a query batch of up to so many rows are known when its
#: plan is made, and choose what is read; a larger batch is joined.
LOCAL_ROWS, FILTERED = 100_000, 2_000


_HELD: WeakKeyDictionary[DataFrame, list] = WeakKeyDictionary()


def known(rows: DataFrame) -> DataFrame:
    """The rows as a table of their own, whose values ``_HELD`` has; a larger table as it is."""
    found = rows.limit(LOCAL_ROWS + 1).collect()
    if len(found) > LOCAL_ROWS:
        return rows
    out = rows.sparkSession.createDataFrame(found, rows.schema)
    _HELD[out] = found
    return out


@dataclass(frozen=True)
class SearchIndex:
    """What ``build_index`` wrote."""

    tables: dict[str, DataFrame]
    n: int
    avgdl: float
    buckets: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SearchIndex:
        tables = stores.read_index(spark, path)
        n, _, avgdl, buckets = tables["stats"].first()
        return cls(tables, n, avgdl or 0.0, buckets)

    def matched(self, terms: DataFrame) -> DataFrame:
        """term, doc_id, dl, tf, df: of the postings only the buckets of the terms are read."""
        postings, frequencies = (self.tables[t] for t in ("postings", "terms"))
        if terms in _HELD:
            wanted = sorted({r.term for r in _HELD[terms]})
            in_bucket = F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in wanted}))
            postings, frequencies = postings.where(in_bucket), frequencies.where(in_bucket)
            if len(wanted) <= FILTERED:
                postings, frequencies = (t.where(F.col("term").isin(wanted)) for t in (postings, frequencies))
        else:
            postings = postings.join(terms.select("term").distinct(), "term", "left_semi")
        return postings.drop("bucket").join(frequencies.select("term", "df"), "term")

    def documents(self, top: DataFrame) -> DataFrame:
        """doc_id, tokens of top's documents."""
        corpus = self.tables["corpus"]
        if _HELD.get(top):
            ids = sorted({r.doc_id for r in _HELD[top]})
            corpus = corpus.where(F.col("doc_id").between(ids[0], ids[-1]))
            corpus = corpus.where(F.col("doc_id").isin(ids)) if len(ids) <= FILTERED else corpus
        return corpus


@dataclass
class Engine:
    """corpus: doc_id, tokens; or stored, an index. Optional: embeddings (doc_id, embedding)
    with query vectors given to ``search``, clusters (doc_id, cluster), topics (doc_id, topic)."""

    corpus: DataFrame | None = None
    settings: SearchSettings = SearchSettings()
    analyse: object = T.analyse
    embeddings: DataFrame | None = None
    clusters: DataFrame | None = None
    topics: DataFrame | None = None
    stored: SearchIndex | None = None

    def known(self, rows: DataFrame) -> DataFrame:
        return rows if self.stored is None else known(rows)

    def scores(self, terms: DataFrame) -> DataFrame:
        """query_id, doc_id, tfidf, bm25."""
        s = self.settings
        if self.stored is not None:
            return R.lexical(self.stored.matched(terms), terms, F.lit(self.stored.n), F.lit(self.stored.avgdl), s.k1, s.b, small=terms in _HELD)
        stats = I.corpus_stats(self.corpus)
        matched = R.with_frequencies(R.matched_postings(self.corpus, terms))
        return R.lexical(matched, terms, stats.select("n").scalar(), stats.select("avgdl").scalar(), s.k1, s.b)

    def lexical(self, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(TF-IDF, BM25)."""
        scores = self.scores(self.known(terms))
        return R.one_score(scores, "tfidf"), R.one_score(scores, "bm25")

    def first_pass(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(terms, fused scores)."""
        analyse = self.analyse
        if self.settings.glue_first_pass:
            analyse = lambda c: self.analyse(T.query_text(R.expand(self.analyse(c)), ""))
        terms = self.known(R.query_terms(queries, lambda c: R.expand(analyse(c))))
        scores = self.scores(terms)
        ends = scores.groupBy("query_id").agg(*(f(c).alias(f"{name}_{c}") for c in ("tfidf", "bm25") for name, f in (("low", F.min), ("high", F.max))))
        parts: list[Column] = [R.scaled(F.col(c), F.col(f"low_{c}"), F.col(f"high_{c}")) * F.lit(0.5) for c in ("tfidf", "bm25")]
        return terms, scores.join(ends, "query_id").select("query_id", "doc_id", F.round(parts[0] + parts[1], R.DIGITS).alias("score"))

    def feedback(self, queries: DataFrame) -> DataFrame:
        """query_id, term, freq of the first pass's best documents."""
        top = self.known(R.feedback_documents(self.first_pass(queries)[1], self.settings))
        return R.feedback_terms(top, self.corpus if self.stored is None else self.stored.documents(top), self.settings, small=top in _HELD)

    def refined_terms(self, queries: DataFrame) -> DataFrame:
        """The feedback terms and the query's own, each counted as often as it stands there."""
        feedback = self.feedback(queries).select("query_id", "term", F.lit(1).cast("long").alias("qcount"))
        own = R.query_terms(queries, lambda c: R.expand(self.analyse(c)))
        return self.known(feedback.unionByName(own).groupBy("query_id", "term").agg(F.sum("qcount").alias("qcount")))

    def fused(self, queries: DataFrame, query_vectors: DataFrame | None = None, k: int | None = None) -> DataFrame:
        """query_id, doc_id, score: both passes, before diversification; with k only what can
        be among the first k. Without dense vectors the embedding score is that of hashed terms."""
        terms = self.refined_terms(queries)
        scores = self.scores(terms)
        if self.embeddings is not None and query_vectors is not None:
            near = R.cosine_to_queries(self.embeddings, query_vectors)
            return R.fuse([R.normalise(s) for s in (R.one_score(scores, "tfidf"), R.one_score(scores, "bm25"), near)], self.settings.fusion_weights)
        own = I.dense_vectors(R.hashed_query_vectors(terms), "query_id")
        vectors = I.dense_vectors(I.hashed_vectors(I.postings(self.corpus))) if self.stored is None else self.stored.tables["embeddings"]
        return R.fused_near(scores, vectors, self.known(own), self.settings.fusion_weights, k)

    def search(self, queries: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """query_id, doc_id, score, rank of the first results, diversified where clusters
        and topics are given. Blank queries have no results."""
        queries = queries.where(F.trim("query") != "")
        if self.clusters is None or self.topics is None:
            return R.ranked(self.fused(queries, query_vectors, self.settings.results), self.settings.results)
        return D.diversify(self.fused(queries, query_vectors), self.clusters, self.topics, self.settings)

    def search_batch(self, queries: DataFrame, meta: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """query_id, seq, rank, url, score of a query batch, for ``sources.stores.write_results``."""
        found = self.search(queries, query_vectors).join(queries.select("query_id", "seq"), "query_id")
        return found.join(meta.select("doc_id", "url"), "doc_id").select("query_id", "seq", "rank", "url", "score")


def build_index(docs: DataFrame, path: str, topics: int | None = None, analyse=T.analyse, buckets: int = 64) -> SearchIndex:
    """Tokens, postings, term and document counts, hashed embeddings and, if asked for,
    topics, as Parquet. Texts are cut into tokens once; a table of few partitions is dealt
    anew before, by document, so that all cores take part."""
    spark = docs.sparkSession
    if docs.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism:
        docs = docs.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "doc_id")
    corpus = I.corpus(docs, analyse)
    stores.write_index(path, corpus, buckets)
    tables = stores.read_index(spark, path)
    corpus, postings = tables["corpus"], tables["postings"]
    frequencies = postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))
    frequencies.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
    I.document_lengths(corpus).write.mode("overwrite").parquet(f"{path}/lengths")
    I.corpus_stats(corpus).withColumn("buckets", F.lit(buckets)).write.mode("overwrite").parquet(f"{path}/stats")
    I.dense_vectors(I.hashed_vectors(postings)).write.mode("overwrite").parquet(f"{path}/embeddings")
    if topics:
        I.topic_distributions(docs, topics).write.mode("overwrite").parquet(f"{path}/topics")
    return SearchIndex.open(spark, path)
