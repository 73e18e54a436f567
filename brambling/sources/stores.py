"""Readers and writers: JSON stores of the whole-file layout, Parquet index tables, query
batches and result files. A missing file is an empty table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brambling import config
from brambling.functions import bits as B
from brambling.functions import text as T

META = "doc_id long, url string, title string, description string, keywords string, simhash long"
CORPUS = "doc_id long, tokens array<string>"
POSTINGS = "term string, doc_id long, tf long"
INDEX_POSTINGS = "term string, doc_id long, tf long, dl long, bucket int"
INDEX_TERMS = "term string, df long, bucket int"
INDEX_STATS = "n long, total long, avgdl double, buckets int"
LENGTHS = "doc_id long, dl long"
FREQUENCIES = "term string, cf long"
FRONTIER = "section string, domain string, url string, priority int, enqueue_seq long"
VISITED = "domain string, url string, skipped boolean"
DOMAINS = "domain string, eng boolean"
BLACKLIST = "pattern string"
EMBEDDINGS = "doc_id long, embedding array<double>"
TOPICS = "doc_id long, topics array<double>"
QUERIES = "query_id string, query string, seq long"


def json_document(spark: SparkSession, path: str, kind: str) -> DataFrame | None:
    """The whole file parsed as ``kind``, one row, or a row for each line where it holds an
    object a line (between two of them alone a brace ends a line and the next begins with
    one); None if there is no file."""
    try:
        raw = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    objects = raw.select(F.explode(F.split("value", r"(?<=\})\r?\n(?=\{)")).alias("value"))
    return objects.where(F.trim("value") != "").select(F.from_json("value", kind).alias("v"))


def _empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def read_meta(spark: SparkSession, path: str) -> DataFrame:
    raw = json_document(spark, path, "map<string, struct<url: string, title: string, description: string, keywords: string, hash: decimal(20,0)>>")
    if raw is None:
        return _empty(spark, META)
    rows = raw.select(F.explode("v").alias("k", "m"))
    texts = [F.coalesce(f"m.{c}", F.lit("")).alias(c) for c in ("url", "title", "description", "keywords")]
    return rows.select(F.col("k").cast("long").alias("doc_id"), *texts, B.from_unsigned(F.col("m.hash")).alias("simhash"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    raw = json_document(spark, path, "map<string, string>")
    if raw is None:
        return _empty(spark, CORPUS)
    return raw.select(F.explode("v").alias("k", "t")).select(F.col("k").cast("long").alias("doc_id"), T.split_blocks(F.col("t")).alias("tokens"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    raw = json_document(spark, path, "map<string, array<array<string>>>")
    if raw is None:
        return _empty(spark, POSTINGS)
    rows = raw.select(F.explode("v").alias("term", "l")).select("term", F.explode("l").alias("p"))
    return rows.select("term", F.get("p", F.lit(0)).cast("long").alias("doc_id"), F.get("p", F.lit(1)).cast("long").alias("tf"))


def read_index_meta(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lengths, embeddings, topics)."""
    kind = "struct<doc_lengths: map<string, bigint>, doc_embeddings: map<string, array<double>>, doc_topic_distributions: map<string, array<double>>>"
    raw = json_document(spark, path, kind)
    if raw is None:
        return _empty(spark, LENGTHS), _empty(spark, EMBEDDINGS), _empty(spark, TOPICS)

    def part(field: str, name: str) -> DataFrame:
        return raw.select(F.explode(f"v.{field}").alias("k", name)).select(F.col("k").cast("long").alias("doc_id"), name)

    return part("doc_lengths", "dl"), part("doc_embeddings", "embedding"), part("doc_topic_distributions", "topics")


def read_frequencies(spark: SparkSession, path: str) -> DataFrame:
    raw = json_document(spark, path, "map<string, bigint>")
    return _empty(spark, FREQUENCIES) if raw is None else raw.select(F.explode("v").alias("term", "cf"))


def read_frontier(spark: SparkSession, path: str) -> DataFrame:
    """JSON maps have no order once parsed: the place in the file is found by the parsed keys' order."""
    raw = json_document(spark, path, "map<string, map<string, map<string, int>>>")
    if raw is None:
        return _empty(spark, FRONTIER)
    rows = raw.select(F.posexplode("v").alias("i", "section", "d")).select("i", "section", F.posexplode("d").alias("j", "domain", "u"))
    rows = rows.select("i", "j", "section", "domain", F.posexplode("u").alias("k", "url", "priority"))
    seq = F.row_number().over(Window.orderBy("i", "j", "k")) - 1  # one file, read as one row
    return rows.select("section", "domain", "url", "priority", seq.cast("long").alias("enqueue_seq"))


def read_visited(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(visited, domains): the flag ``eng`` lies among the urls of its domain."""
    raw = json_document(spark, path, "map<string, map<string, boolean>>")
    if raw is None:
        return _empty(spark, VISITED), _empty(spark, DOMAINS)
    rows = raw.select(F.explode("v").alias("domain", "m")).select("domain", F.explode("m").alias("url", "flag"))
    return rows.where("url <> 'eng'").withColumnRenamed("flag", "skipped"), rows.where("url = 'eng'").select("domain", F.col("flag").alias("eng"))


def read_blacklist(spark: SparkSession, path: str) -> DataFrame:
    raw = json_document(spark, path, "array<string>")
    return _empty(spark, BLACKLIST) if raw is None else raw.select(F.explode("v").alias("pattern")).distinct()


def blacklist_table(spark: SparkSession, patterns=config.BLACKLIST) -> DataFrame:
    return spark.createDataFrame([(p,) for p in dict.fromkeys(patterns)], BLACKLIST)


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """label, pattern: a phrase, or the lower-case tokens of a token list joined by blanks."""
    raw = json_document(spark, path, "array<struct<label: string, pattern: string>>")
    if raw is None:
        return _empty(spark, "label string, pattern string")
    rows = raw.select(F.inline("v"))
    tokens = F.from_json("pattern", "array<map<string, string>>")
    lower = F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(t, F.lit("LOWER")), F.map_keys(t)[0])), " ")
    return rows.select("label", F.when(F.col("pattern").startswith("["), lower).otherwise(F.col("pattern")).alias("pattern"))


def write_json(df: DataFrame, path: str, key: str, value: str) -> None:
    """A table of (key, value) as one JSON object a line: lines, so that any size is written
    in parallel; the ``read_`` functions read them like one object."""
    df.select(F.to_json(F.map_from_arrays(F.array(F.col(key).cast("string")), F.array(value)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


_REMEMBERED: dict[tuple, tuple[tuple, DataFrame]] = {}


def remembered(spark: SparkSession, path: str, read) -> DataFrame:
    """``read(spark, path)``, cached until the files under path change."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    found = fs.listStatus(at) if fs.exists(at) else []
    state = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))
    key = (spark.sparkContext.applicationId, path, read)
    if key not in _REMEMBERED or _REMEMBERED[key][0] != state:
        if key in _REMEMBERED:
            _REMEMBERED[key][1].unpersist()
        _REMEMBERED[key] = (state, read(spark, path).persist())
    return _REMEMBERED[key][1]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_results`` wrote."""
    return spark.read.schema("query_id string, rank int, url string, score double").option("sep", "\t").csv(path)


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return _empty(spark, schema)
        raise


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(buckets)).cast("int")


def write_index(path: str, corpus: DataFrame, buckets: int) -> None:
    """corpus (doc_id, tokens) as it is dealt; its postings (term, doc_id, tf, dl) in folders of
    term buckets, of which a query reads its own, sorted by term, so that row groups are
    skipped within them. Ranges go by document too: no task holds all of a frequent term."""
    corpus.sortWithinPartitions("doc_id").write.mode("overwrite").parquet(f"{path}/corpus")
    tokens = read_table(corpus.sparkSession, f"{path}/corpus", CORPUS).select("doc_id", F.size("tokens").cast("long").alias("dl"), F.explode("tokens").alias("term"))
    postings = tokens.groupBy("term", "doc_id", "dl").agg(F.count("*").alias("tf"))
    keyed = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    order = ("bucket", "term", "doc_id")
    keyed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    kinds = {"corpus": CORPUS, "postings": INDEX_POSTINGS, "terms": INDEX_TERMS, "stats": INDEX_STATS, "lengths": LENGTHS, "embeddings": EMBEDDINGS, "topics": TOPICS}
    return {name: read_table(spark, f"{path}/{name}", schema) for name, schema in kinds.items()}


def parse_queries(lines: DataFrame) -> DataFrame:
    """lines: value, seq -> query_id, query, seq. Id and text are parted by any white space;
    the last text of an id holds, at its first place. A line of one word or none is an error."""
    pattern = r"(?Us)^\s*(\S+)\s+(\S.*)$"
    line = F.when(F.col("value").rlike(pattern), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("no id and query in line: "), "value")))
    rows = lines.select(F.regexp_extract(line, pattern, 1).alias("query_id"), F.regexp_extract(line, pattern, 2).alias("query"), "seq")
    return rows.groupBy("query_id").agg(F.max_by("query", "seq").alias("query"), F.min("seq").alias("seq"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("seq", "value"))
    return parse_queries(lines.select("value", F.col("seq").cast("long")))


def write_results(results: DataFrame, path: str) -> None:
    """query_id, rank, url and score as tab-separated lines without a header, in the batch's
    order. A batch's results are at most a hundred rows a query, so one file holds them."""
    order = ["seq", "rank"] if "seq" in results.columns else ["query_id", "rank"]
    out = results.orderBy(*order).select("query_id", "rank", "url", "score")
    out.coalesce(1).write.mode("overwrite").option("sep", "\t").option("emptyValue", "").csv(path)
