"""Gates, link filters and scheduling of a crawl cycle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brambling import config
from brambling.functions import text as T
from brambling.functions import urls as U
from brambling.operators import stores


def language_gate(lang: Column, score: Column, text: Column, german_below: float = config.CrawlSettings.german_below) -> Column:
    """English, or German the detector isn't sure of; never an empty text."""
    ok = (lang == "en") | ((lang == "de") & (score < german_below))
    return F.coalesce(ok & (F.coalesce(text, F.lit("")) != ""), F.lit(False))


def topic_gate(text: Column, terms=config.TOPIC_TERMS) -> Column:
    return T.contains_any(F.lower(F.trim(T.clean_text(text))), terms)


def decide(pages: DataFrame, terms=config.TOPIC_TERMS) -> DataFrame:
    """pages: url, no_html, text (joined blocks), full_text, lang, lang_score, seen, has_body,
    duplicate -> decision, by the first gate that stops the page."""
    gates = [
        (F.col("no_html"), "empty"),
        (F.col("seen"), "visited"),
        (~F.col("has_body"), "no_body"),
        (~language_gate(F.col("lang"), F.col("lang_score"), F.col("text")), "language"),
        (~topic_gate(F.col("full_text"), terms), "off_topic"),
        (F.col("duplicate"), "duplicate"),
    ]
    out = F.lit("accept")
    for stop, name in reversed(gates):
        out = F.when(F.coalesce(stop, F.lit(False)), F.lit(name)).otherwise(out)
    return pages.withColumn("decision", out)


def filter_links(links: DataFrame, visited: DataFrame, domains: DataFrame, blacklist=config.BLACKLIST) -> DataFrame:
    """links: page_url, pos, href, hreflang -> the same with url and path of those to follow.
    One link for each page and path is kept, the first of those that pass all tests. Cheap
    tests come before regexes and joins."""
    href = F.col("href")
    rows = links.where(href.isNotNull() & ~href.contains("#"))
    rows = rows.where(F.coalesce(F.col("hreflang"), F.lit("")).contains("en") | (F.coalesce(F.col("hreflang"), F.lit("")) == ""))
    rows = rows.withColumn("url", U.absolute(href, F.col("page_url"))).where(U.is_web(F.col("url")))
    rows = rows.withColumns({"path": U.path(F.col("url")), "domain": U.netloc(F.col("url")), "page_domain": U.netloc(F.col("page_url"))})
    bad = U.is_file(F.col("path")) | U.is_editor(F.col("path")) | U.is_unwanted(F.col("path")) | U.is_blacklisted(F.col("url"), blacklist)
    rows = stores.unseen(rows.where(~bad), visited)
    english = domains.where("eng").select(F.col("domain").alias("page_domain"), F.lit(True).alias("eng")).distinct()
    rows = rows.join(english, "page_domain", "left")
    leaves = F.col("eng") & (F.col("domain") == F.col("page_domain")) & U.has_english_path(U.path(F.col("page_url"))) & ~U.has_english_path(F.col("path"))
    rows = rows.where(~F.coalesce(leaves, F.lit(False))).drop("eng", "page_domain")
    first = Window.partitionBy("page_url", "path").orderBy("pos")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def english_alternate(links: Column, page_url: Column) -> Column:
    """The first link of an array of (href, hreflang, ..) whose hreflang contains ``en``."""
    found = F.filter(links, lambda x: F.coalesce(x["hreflang"], F.lit("")).contains("en"))
    return F.when(F.size(found) > 0, U.absolute(F.get(found, F.lit(0))["href"], page_url))


def schedule(frontier: DataFrame, group: int = 3, limit: int = config.CrawlSettings.cache_limit, cursor: int = 0) -> DataFrame:
    """section, domain, url, slot: one url of each domain in turn, first in first out; the
    cursor says with which domain to begin. group: 1 IN, 2 OUT, 3 both with half the limit each."""
    sections = {1: ["IN"], 2: ["OUT"], 3: ["IN", "OUT"]}[group]
    each = limit // len(sections)
    domains = frontier.groupBy("section", "domain").agg(F.min("enqueue_seq").alias("first"))
    w = Window.partitionBy("section").orderBy("first", "domain")
    domains = domains.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("section")))
    domains = domains.select("section", "domain", F.pmod(F.col("i") - cursor, F.col("n")).alias("turn"))
    queue = Window.partitionBy("section", "domain").orderBy("enqueue_seq", "url")
    # No domain can give more than the limit.
    rows = frontier.where(F.col("section").isin(sections)).withColumn("nth", F.row_number().over(queue)).where(F.col("nth") <= each)
    rows = rows.join(domains, ["section", "domain"])
    slot = F.row_number().over(Window.partitionBy("section").orderBy("nth", "turn"))
    return rows.withColumn("slot", slot).where(F.col("slot") <= each).select("section", "domain", "url", "slot")


def refilled(tokens: Column, elapsed_s: Column, capacity: int = config.CrawlSettings.bucket_capacity, per_second: float = config.CrawlSettings.bucket_refill_s) -> Column:
    """Tokens of a bucket after some seconds."""
    return F.least(F.lit(float(capacity)), tokens + elapsed_s * F.lit(per_second))


def wait_seconds(tokens: Column, elapsed_s: Column, capacity: int = config.CrawlSettings.bucket_capacity, per_second: float = config.CrawlSettings.bucket_refill_s) -> Column:
    """Until a bucket has a token to give, never below 0."""
    return F.greatest(F.lit(0.0), (F.lit(1.0) - (tokens - F.lit(float(capacity)))) / F.lit(per_second) - elapsed_s)


def failed(urls: DataFrame) -> DataFrame:
    """Events of fetches that failed: visited, and skipped."""
    return urls.select("url", F.lit(True).alias("is_english"), F.lit(True).alias("skipped"), "seq")
