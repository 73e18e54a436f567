"""Column functions on urls, lenient where ``parse_url`` would raise or give null."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brambling import config
from brambling.functions.text import contains_any

PARTS = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)"


def _part(c: Column, k: int) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), PARTS, k)


def scheme(c: Column) -> Column:
    return F.lower(_part(c, 1))


def netloc(c: Column) -> Column:
    return _part(c, 2)


def path(c: Column) -> Column:
    """Without the ;params of the last segment."""
    return F.regexp_replace(_part(c, 3), r";[^/]*$", "")


def base_url(c: Column) -> Column:
    return F.concat_ws("://", scheme(c), netloc(c))


def absolute(href: Column, base: Column) -> Column:
    """hrefs that begin with a slash get the base's scheme and host; dot segments are
    resolved; others stay as they are."""
    rooted = F.when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(base_url(base), href))
    for _ in range(4):  # a/../ inwards out; deeper nests are left
        rooted = F.regexp_replace(rooted, r"/(?!\.\.?/)[^/:?#]+/\.\./", "/")
    return F.coalesce(F.regexp_replace(rooted, r"/(?:\./)+", "/"), href)


def is_web(c: Column) -> Column:
    return (netloc(c) != "") & scheme(c).isin("http", "https")


def is_file(c: Column, endings: Iterable[str] = config.FILE_ENDINGS) -> Column:
    """Case-sensitive ending of a path, or of a whole url."""
    return F.coalesce(c, F.lit("")).rlike("(?:" + "|".join(re.escape(e) for e in endings) + ")$")


def is_editor(path_: Column) -> Column:
    return contains_any(path_, config.EDITOR_TERMS)


def is_unwanted(path_: Column, terms: Iterable[str] = config.UNWANTED_PATH_TERMS) -> Column:
    return contains_any(path_, terms)


def is_blacklisted(c: Column, patterns: Iterable[str] = config.BLACKLIST) -> Column:
    """The patterns are regexes: an unescaped dot is any character."""
    return contains_any(c, dict.fromkeys(patterns))


def has_english_path(path_: Column) -> Column:
    return contains_any(path_, config.ENGLISH_PATHS)


def registered_domain(c: Column) -> Column:
    """The last two labels of the host without ``www.``; fewer labels stay."""
    host = F.regexp_extract(F.coalesce(c, F.lit("")), r"://(?:www\.)?([^/]+)", 1)
    labels = F.split(host, r"\.")
    return F.when(F.size(labels) > 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
