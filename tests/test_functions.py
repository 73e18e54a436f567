"""Column functions on the cases the tables don't contain."""

import hashlib

import pytest
from pyspark.sql import functions as F

from brambling import config
from brambling.functions import bits as B
from brambling.functions import text as T
from brambling.functions import urls as U
from brambling.functions import vectors as V


@pytest.fixture(scope="module")
def on(spark):
    def run(f, *values):
        rows = spark.createDataFrame([(v,) for v in values], "c string").coalesce(1)
        return [r[0] for r in rows.select(f(F.col("c"))).collect()]

    return run


def test_clean_text(on):
    assert on(T.clean_text, "5 p.m. today", "it's it’s", "a\n \t b", "9 a.m.") == ["5 pmtoday", "its its", "a b", "9 am"]


def test_contains_any(on):
    assert on(lambda c: T.contains_any(c, ["x.z", "Q"]), "aXYZ", "q", "", None, "no") == [True, True, False, False, False]
    assert on(lambda c: T.contains_any(c, []), "a") == [False]


def test_normalise_word(on):
    assert on(T.normalise_word, "a\\b", "en – dash", "[x]", "  Hello, World! ") == ["a\\b", "en dash", "x", "hello world"]


def test_phones(on):
    assert on(T.phones, "call +49 7071 29-0000 or 1234567890123", "123", None) == [["+49 7071 29-0000", "1234567890123"], [], []]
    assert on(T.without_phones, "x +49 7071 29-0000 y") == ["x  y"]


def test_analyse_appends_entities(on):
    got = on(T.analyse, "The Max Planck Institute at www.mpg.de, 07071 290 0000")[0]
    assert got == ["07071 290 0000", "max", "planck", "institute", "www", "mpg", "de", "max planck institute", "www mpg de"]
    assert on(T.analyse_replacing, "The Max Planck Institute sings")[0] == ["max planck institute", "sings"]


def test_tokens_of_any_script(on):
    assert on(T.analyse, "Où est le château déjà 2024 Москва naïve") == [["où", "est", "le", "château", "déjà", "2024", "москва", "naïve"]]
    assert on(T.analyse, "e\u0301te\u0301 日本語 x 7 42, the and these", None) == [["e\u0301te\u0301", "日本語", "42"], []]


def test_blocks(on):
    assert on(T.split_blocks, "a\n;\nb", "", "a\n;\n") == [["a", "b"], [""], ["a", ""]]
    assert on(lambda c: T.join_blocks(T.split_blocks(c)), "a\n;\nb") == ["a\n;\nb"]


def test_shortened(on):
    assert on(lambda c: T.shortened(c, 3), "abc", "abcd") == ["abc", "abc..."]
    assert on(T.is_number, "12", "1a") == [True, False]
    assert on(T.vector_terms, "A bc, Déf g1") == [["bc", "déf", "g1"]]


def test_url_parts(on):
    urls = ["HTTP://a b/c;p?x#y", "mailto:me@x", "//h/p", "", None, "https://u@h:8/x/y;z"]
    assert on(U.scheme, *urls) == ["http", "mailto", "", "", "", "https"]
    assert on(U.netloc, *urls) == ["a b", "", "h", "", "", "u@h:8"]
    assert on(U.path, *urls) == ["/c", "me@x", "/p", "", "", "/x/y"]


def test_absolute(on):
    base = F.lit("https://h.org/dir/page")
    got = on(lambda c: U.absolute(c, base), "/x", "//o/p", "rel.html", "http://q/r", "/a/../b/./c")
    assert got == ["https://h.org/x", "https://o/p", "rel.html", "http://q/r", "https://h.org/b/c"]
    assert on(U.is_web, "ftp://h/x", "http://h", "x", "https:///p") == [False, True, False, False]


def test_url_filters(on):
    assert on(U.is_file, "/a.PDF", "/a.pdf", "/apdf", "/x.c") == [False, True, False, True]
    assert on(U.is_unwanted, "/research", "/uni", "/a:b") == [True, False, True]
    assert on(U.is_blacklisted, "http://x/university", "http://google.com", "http://x.org") == [True, True, False]
    assert on(U.is_editor, "/edit/x", "/star", "/page") == [True, True, False]
    assert on(U.registered_domain, "https://www.a.b.co/x", "http://host/x", "http://www.x.de", "") == ["b.co", "host", "x.de", ""]
    assert len(config.FILE_ENDINGS) == 69 and len(config.UNWANTED_PATH_TERMS) == 35 and len(config.BLACKLIST) == 56


def test_bits(on, spark):
    def signed(w):
        h = int.from_bytes(hashlib.sha256(w.encode()).digest()[-8:], "big")
        return h - (1 << 64) if h >> 63 else h

    words = ["alpha", "ünder", "", "z" * 99]
    assert on(B.hash_word, *words) == [signed(w) for w in words]
    assert on(B.from_unsigned, "18446744073709551615", "9223372036854775808", "5") == [-1, -(2**63), 5]
    row = spark.range(1).select(
        B.hamming(F.lit(-1).cast("long"), F.lit(0).cast("long")), B.prefix(F.lit(-1).cast("long"), 6), B.similarity(F.lit(3).cast("long"), F.lit(0).cast("long"))
    ).first()
    assert tuple(row) == (64, 63, 1 - 2 / 64)


def test_vectors(spark):
    row = spark.range(1).select(
        V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))), V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))),
        V.argmin(F.array(F.lit(2), F.lit(1), F.lit(1))), V.argmax(F.array(F.lit(2), F.lit(1), F.lit(2))),
    ).first()
    assert abs(row[0] - 0.5**0.5) < 1e-12 and tuple(row)[1:] == (None, 1, 0)
