"""Column functions on text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from brambling import config

#: A word of the default tokenizer: letters of any script with their marks, and numbers.
WORD = r"[\p{L}\p{M}\p{N}]+"
PHONE = r"\+?[0-9][0-9 -]{8,14}[0-9]"
#: ASCII punctuation but the backslash, the en dash and white space.
PUNCTUATION = r"""(?U)[!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~–\s]+"""
LINK = r"(?:https?://|www\.)[^\s]+"


def clean_text(c: Column) -> Column:
    """White space to single blanks, apostrophes away, p.m. and a.m. to ' pm' and ' am'
    with the blanks around them."""
    c = F.regexp_replace(c, r"(?U)\s+", " ")
    c = F.regexp_replace(c, "['’]", "")
    c = F.regexp_replace(c, r"\s*(p\.m\.)\s*", " pm")
    return F.regexp_replace(c, r"\s*(a\.m\.)\s*", " am")


def contains_any(c: Column, terms: Iterable[str]) -> Column:
    """Whether any of the regexes is found, in any case; false for null and empty text."""
    folded = "|".join(f"(?:{t})" for t in terms)
    return F.coalesce(c, F.lit("")).rlike(f"(?iu){folded}") & (F.coalesce(c, F.lit("")) != "") if folded else F.lit(False)


def normalise_word(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, PUNCTUATION, " ")))


def phones(c: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PHONE), F.lit(0))


def without_phones(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), PHONE, "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), F.lit(0))


def allowed(tokens: Column, stop_words: Iterable[str] = ()) -> Column:
    """Tokens of more than one character that are no stop words."""
    stop = list(stop_words)
    return F.filter(tokens, lambda t: (F.length(t) > 1) & (~t.isin(stop) if stop else F.lit(True)))


def entities(c: Column, phrases: Iterable[str] = config.ENTITY_PHRASES) -> Column:
    """Normalised configured phrases, in any case, then links."""
    alternatives = "|".join(p.replace(" ", r"\s+") for p in phrases)
    text = F.coalesce(c, F.lit(""))
    named = F.regexp_extract_all(text, F.lit(f"(?iU)(?:{alternatives})"), F.lit(0)) if alternatives else F.array().cast("array<string>")
    return F.transform(F.concat(named, F.regexp_extract_all(text, F.lit(LINK), F.lit(0))), normalise_word)


def analyse(c: Column, stop_words: Iterable[str] = config.STOP_WORDS, phrases: Iterable[str] = config.ENTITY_PHRASES, lemma=None) -> Column:
    """Phones, then tokens, then entities, so an entity's words count twice. ``lemma``: a
    function from token column to its lemma; none leaves the surface."""
    rest = without_phones(c)
    tokens = allowed(words(rest), stop_words)
    if lemma is not None:
        tokens = F.filter(F.transform(tokens, lemma), lambda t: F.length(t) > 1)
    return F.concat(phones(c), tokens, entities(rest, phrases))


def analyse_replacing(c: Column, stop_words: Iterable[str] = config.STOP_WORDS, phrases: Iterable[str] = config.ENTITY_PHRASES) -> Column:
    """As ``analyse``, but an entity stands in place of its words: its blanks are tied
    together before the text is cut into tokens, and untied after."""
    rest = without_phones(c)
    for phrase in phrases:
        tied = phrase.lower().replace(" ", "\u0001")
        rest = F.regexp_replace(rest, r"(?iU)\b" + phrase.replace(" ", r"\s+") + r"\b", tied)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(rest, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}\x01]+"), F.lit(0))
    return F.concat(phones(c), F.transform(allowed(tokens, stop_words), lambda t: F.translate(t, "\u0001", " ")))


def join_blocks(blocks: Column) -> Column:
    return F.array_join(blocks, config.BLOCK_SEPARATOR)


def split_blocks(c: Column) -> Column:
    """An empty text is one empty block."""
    return F.split(c, config.BLOCK_SEPARATOR, -1)


def query_text(tokens: Column, glue: str = " ") -> Column:
    return F.array_join(tokens, glue)


def vector_terms(c: Column) -> Column:
    """Lower-case runs of two or more word characters, as a count vectorizer cuts them."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def shortened(c: Column, chars: int) -> Column:
    return F.when(F.length(c) > chars, F.concat(F.substring(c, 1, chars), F.lit("..."))).otherwise(c)


def is_number(c: Column) -> Column:
    return c.rlike(r"(?U)^\d+$")
