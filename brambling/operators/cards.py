"""Result cards: what a page of results shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.config import CrawlSettings
from brambling.functions import text as T
from brambling.operators.rank import top_terms


def result_cards(results: DataFrame, meta: DataFrame, corpus_: DataFrame, settings: CrawlSettings = CrawlSettings()) -> DataFrame:
    """results: query_id, doc_id, score, rank; meta: doc_id, url, title, description,
    keywords. Without keywords a card shows its document's most frequent terms."""
    hit = corpus_.join(results.select("doc_id").distinct(), "doc_id", "left_semi")
    terms = top_terms(hit, settings.card_terms).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t"))
    terms = terms.select("doc_id", F.array_join(F.transform("t", lambda x: x["term"]), ", ").alias("terms"))
    cards = results.join(meta, "doc_id", "left").join(terms, "doc_id", "left")
    keywords = F.coalesce(F.nullif(F.substring("keywords", 1, settings.keyword_chars), F.lit("")), "terms", F.lit(""))
    return cards.select(
        "query_id", "rank", "doc_id", "score", "url", "title",
        T.shortened(F.coalesce("description", F.lit("")), settings.description_chars).alias("description"), keywords.alias("keywords"),
    )


def without_pinned(results: DataFrame, pins: DataFrame) -> DataFrame:
    return results.join(pins.select("doc_id").distinct(), "doc_id", "left_anti")


def history(queries: DataFrame, asked: DataFrame) -> DataFrame:
    """(query, seq): every query once, at its first place."""
    return queries.unionByName(asked).groupBy("query").agg(F.min("seq").alias("seq"))
