"""URL filters with a path-template tree, in DataFrame functions alone.

Every page votes for the path of its host: rules label the urls they fit, all others are
unlabelled. Segments that vary by their shape (numbers, ids) become the wildcard ``*``.
Then, level by level from the root of each host's tree, a branch stays literal only if
its labels differ from its siblings' (a two-proportion test) or it holds a fair share of
its parent's rows without labels of its own; the tree ends where the longest path does;
branches that can't be told apart statistically are merged into ``*``. A template's
purity, the share of blocked labels, is smoothed towards that of the same template on all
hosts, and this towards the share over all pages; from ``REJECT`` on it is rejected.

Pages are reduced to (host, segments) counts before anything else, so that a hot host is
pre-aggregated; the tree works on those counts, and the verdicts join back.

Defined results: a null url, or one without ``://``, has host '' and path '' and shares
their template; equal urls get equal verdicts; extra columns are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import base

#: SUPPORT: share of its parent's rows from which an unlabelled branch stays literal.
#: Z: deviation at which a branch differs. ALPHA: pseudo-counts.
SUPPORT, Z, ALPHA, REJECT = 0.02, 1.96, 4.0, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    rule: str  #: host/path, as in ``example.com/en/``


RULES = (
    UrlRule("allow", "com/"),
    UrlRule("block", "example.com/en/"),
    UrlRule("allow", "www.example.com/en/"),
    UrlRule("block", "net/es/"),
    UrlRule("block", "net/fr/"),
)


def split_url(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    rest = F.coalesce(F.regexp_extract(F.col(url_col), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    parts = pages.select(F.col(id_col).cast("long").alias("page_id"), rest.alias("rest"))
    return parts.select(
        "page_id",
        F.translate(F.regexp_extract("rest", r"(?s)^([^/?#]*)", 1), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def matching(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else null."""
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        host, slash, path = r.rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        rule, verdict = F.when(fits, F.lit(r.rule)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def generalised(segment: Column) -> Column:
    """``*`` for segments that vary by their shape; a file's ending stays."""
    return (
        F.when(segment.rlike(r"^[0-9]+\.[A-Za-z]+$"), F.regexp_replace(segment, r"^[0-9]+", "*"))
        .when(segment.rlike(r"^[0-9A-Fa-f-]{16,}$") | segment.rlike(r"[0-9].*[0-9].*[0-9]") | segment.rlike(r"^[0-9]+$"), F.lit("*"))
        .otherwise(segment)
    )


def template_tree(counts: DataFrame) -> DataFrame:
    """counts: host, segments, blocked, allowed, n, stored -> the same rows with ``template``.
    Paths that have ended leave the tree, so that a level costs what still goes on."""
    deepest = counts.agg(F.coalesce(F.max(F.size("segments")), F.lit(0))).first()[0]
    tree, ended = counts.withColumn("prefix", F.lit("")), None
    for k in range(deepest):
        seg = F.coalesce(F.get("segments", F.lit(k)), F.lit(""))
        tree = tree.withColumn("seg", seg)
        children = tree.groupBy("host", "prefix", "seg").agg(*(F.sum(c).alias(c) for c in ("blocked", "allowed", "n")))
        parents = children.groupBy("host", "prefix").agg(F.sum("blocked").alias("all_blocked"), F.sum("allowed").alias("all_allowed"), F.sum("n").alias("all_n"))
        own, rest = F.col("blocked") + F.col("allowed"), F.col("all_blocked") + F.col("all_allowed") - F.col("blocked") - F.col("allowed")
        p_own, p_rest = (F.col("blocked") + 0.5) / (own + 1), (F.col("all_blocked") - F.col("blocked") + 0.5) / (rest + 1)
        p = (F.col("all_blocked") + 1) / (own + rest + 2)
        z = F.abs(p_own - p_rest) / F.sqrt(p * (1 - p) * (1 / (own + 1) + 1 / (rest + 1)))
        differs = (own > 0) & (rest > 0) & (z >= Z)
        common = (own == 0) & (F.col("n") >= SUPPORT * F.col("all_n"))
        decided = children.join(parents, ["host", "prefix"]).select(
            "host", "prefix", "seg",
            F.when(F.col("seg") == "", F.lit("")).when(F.col("seg").contains("*"), F.col("seg")).when(differs | common, F.col("seg")).otherwise("*").alias("kept"),
        )
        tree = tree.join(decided, ["host", "prefix", "seg"]).withColumn("prefix", F.concat("prefix", F.lit("/"), "kept")).drop("seg", "kept")
        tree = base.stored(tree, "tree")
        done = tree.where(F.size("segments") <= k)  # has stood as a path's end among its siblings
        ended, tree = done if ended is None else ended.unionByName(done), tree.where(F.size("segments") > k)
    tree = tree if ended is None else ended.unionByName(tree)
    return tree.withColumn("template", F.regexp_replace(F.concat("prefix", F.lit("/")), "/+$", "/")).drop("prefix")


def filter_urls(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity (of the template, smoothed)."""
    rule, verdict = matching(rules)
    parts = split_url(pages, id_col, url_col)
    parts = parts.withColumn("segments", F.transform(F.split(F.regexp_replace("path", "^/", ""), "/"), generalised))
    parts = parts.withColumns({"rule": rule, "ruled": verdict})
    counts = parts.groupBy("host", "segments").agg(
        F.count_if(F.col("ruled") == "block").alias("blocked"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count("*").alias("n")
    )
    with base.scratch(pages.sparkSession):
        tree = base.stored(template_tree(base.stored(counts, "paths")), "templates")
        blocked, allowed = tree.agg(F.coalesce(F.sum("blocked"), F.lit(0)), F.coalesce(F.sum("allowed"), F.lit(0))).first()
        prior = (blocked + 0.5) / (blocked + allowed + 1)
        anywhere = tree.groupBy("template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a"))
        anywhere = anywhere.select("template", ((F.col("b") + ALPHA * prior) / (F.col("a") + F.col("b") + ALPHA)).alias("shared"))
        here = tree.groupBy("host", "template").agg(F.sum("blocked").alias("b"), F.sum("allowed").alias("a")).join(anywhere, "template")
        purity = (F.col("b") + ALPHA * F.col("shared")) / (F.col("a") + F.col("b") + ALPHA)
        judged = tree.join(here, ["host", "template"]).select("host", "segments", "template", purity.alias("purity"))
        judged = base.stored(judged, "judged", keep=True)
    out = parts.join(judged, ["host", "segments"])
    learned = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity")


def op5_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(base.table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "template")


def _oracle(levels: int = 12) -> str:
    """For paths of so many segments at most; more levels change nothing for shorter ones."""
    level = """
c{k} AS (SELECT host, prefix, coalesce(segments[{k}], '') AS seg, sum(blocked) AS b, sum(allowed) AS a, sum(n) AS n FROM t{j} GROUP BY ALL),
p{k} AS (SELECT host, prefix, sum(b) AS tb, sum(a) AS ta, sum(n) AS tn FROM c{k} GROUP BY ALL),
d{k} AS (
  SELECT host, prefix, seg, CASE WHEN seg = '' THEN '' WHEN contains(seg, '*') THEN seg
    WHEN (b + a > 0 AND tb + ta - b - a > 0 AND abs((b + 0.5e0) / (b + a + 1) - (tb - b + 0.5e0) / (tb + ta - b - a + 1))
          / sqrt((tb + 1e0) / (tb + ta + 2) * (1 - (tb + 1e0) / (tb + ta + 2)) * (1e0 / (b + a + 1) + 1e0 / (tb + ta - b - a + 1))) >= 1.96e0)
      OR (b + a = 0 AND n >= 0.02e0 * tn) THEN seg ELSE '*' END AS kept
  FROM c{k} JOIN p{k} USING (host, prefix)),
t{k} AS (
  SELECT t.host, t.segments, t.blocked, t.allowed, t.n, t.prefix || '/' || d.kept AS prefix
  FROM t{j} t JOIN d{k} d ON t.host = d.host AND t.prefix = d.prefix AND coalesce(t.segments[{k}], '') = d.seg)"""
    return (
        r"""
WITH u AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
v AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
w AS (
  SELECT *, list_transform(string_split(regexp_replace(path, '^/', ''), '/'), lambda s:
           CASE WHEN regexp_matches(s, '^[0-9]+\.[A-Za-z]+$') THEN regexp_replace(s, '^[0-9]+', '*')
                WHEN regexp_matches(s, '^[0-9A-Fa-f-]{16,}$') OR regexp_matches(s, '[0-9].*[0-9].*[0-9]') OR regexp_matches(s, '^[0-9]+$') THEN '*'
                ELSE s END) AS segments,
    CASE WHEN (host = 'www.example.com' OR suffix(host, '.www.example.com')) AND prefix(path, '/en/') THEN 'www.example.com/en/'
         WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND prefix(path, '/en/') THEN 'example.com/en/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/es/') THEN 'net/es/'
         WHEN (host = 'net' OR suffix(host, '.net')) AND prefix(path, '/fr/') THEN 'net/fr/'
         WHEN (host = 'com' OR suffix(host, '.com')) AND prefix(path, '/') THEN 'com/' END AS rule FROM v),
x AS (SELECT *, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS ruled FROM w),
t0 AS (
  SELECT host, segments, count(*) FILTER (ruled = 'block') AS blocked, count(*) FILTER (ruled = 'allow') AS allowed, count(*) AS n, '' AS prefix
  FROM x GROUP BY host, segments),"""
        + ",".join(level.format(k=k, j=k - 1) for k in range(1, levels + 1))
        + f""",
f AS (SELECT host, segments, blocked, allowed, regexp_replace(prefix || '/', '/+$', '/') AS template FROM t{levels}),"""
        + """
g AS (SELECT (sum(blocked) + 0.5e0) / (sum(blocked) + sum(allowed) + 1) AS prior FROM f),
e AS (SELECT template, (sum(blocked) + 4e0 * (SELECT prior FROM g)) / (sum(allowed) + sum(blocked) + 4e0) AS shared FROM f GROUP BY template),
h AS (
  SELECT host, template, (sum(blocked) + 4e0 * any_value(shared)) / (sum(allowed) + sum(blocked) + 4e0) AS purity
  FROM f JOIN e USING (template) GROUP BY host, template)
SELECT x.page_id, x.host, x.path, x.rule, coalesce(x.ruled, CASE WHEN h.purity >= 0.5e0 THEN 'block' ELSE 'allow' END) AS verdict, f.template
FROM x JOIN f ON x.host = f.host AND x.segments = f.segments JOIN h ON f.host = h.host AND f.template = h.template
"""
    )


ORACLE = {"op5_url_filter": _oracle()}
