"""What larger tables hold and the small test tables don't, against the SQL."""

import duckdb
import pytest

from brambling import catalog

from .conftest import canonical

WORDS = "the onatth and of to in is that for with was"


def page(title: str, body: str = WORDS) -> str:
    return f"<html><head><title>{title}</title></head><body><article><h1>{title}</h1><p>{body}</p></article></body></html>"


@pytest.fixture
def differs(spark, tmp_path):
    """A query over given tables and its SQL: rows of the one that the other hasn't."""

    def check(name: str, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        got = catalog.QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({catalog.ORACLE[name]}) q").fetchall()
        assert want
        return set(canonical(want)) ^ set(canonical(tuple(r) for r in got.select(*columns).collect()))

    return check


PAGES = "page_id long, url string, html string"
TITLES = ["a &amp;&amp", "token = &quot;5aa&quot;", "a &lt;b&gt; &am", "&#x27;tis &", "plain &amp; simple"]


def pages_of(titles):
    return [(i, f"http://a.example/{i}", page(t)) for i, t in enumerate(titles, 1)], PAGES


def test_blocks_with_cut_references(differs):
    assert not differs("page_blocks", pages=pages_of(TITLES))


def test_titles_with_cut_and_other_references(differs):
    assert not differs("page_meta", pages=pages_of(TITLES))


def test_decisions_of_pages_that_share_a_url(differs):
    """A visited page, and a page of the same url that isn't; two accepted ones of a url."""
    rows = [(10, "http://a.example/x", page("one")), (11, "http://a.example/x", page("two")), (12, "http://a.example/y", page("three", WORDS + " uno")),
            (13, "http://a.example/y", page("four", WORDS + " dos tres")), (14, "http://a.example/z", page("five &amp", WORDS)), (15, "http://a.example/e", "")]
    documents = [(i, f"word{i} other{i % 3} the text", "en", "s", 20) for i in range(8)]
    assert not differs("crawl_decision", pages=(rows, PAGES), documents=(documents, "doc_id long, text string, lang string, source string, n_chars long"))


def plain_topics(docs, k, steps, seed):
    """The library's online LDA in one loop over documents, with the draws of the dealt one."""
    import numpy as np

    from brambling.operators import topics

    terms = sorted({t for _, counts in docs.values() for t in counts})
    place = {t: i for i, t in enumerate(terms)}
    model = topics.first_values(np.array(terms), k, seed)
    alpha, eta, n = np.full(k, 1 / k), 1 / k, len(docs)

    def gamma_of(counts, start):
        beta = np.exp(topics.digamma(model) - topics.digamma(model.sum(axis=0)))[[place[t] for t in counts]]
        times, gamma, change = np.array(list(counts.values()), float), start, 1.0
        while change > 1e-3:
            theta = np.exp(topics.expectation(gamma))
            gamma, before = alpha + theta * (times / (beta @ theta) @ beta), gamma
            change = np.abs(gamma - before).mean()
        theta = np.exp(topics.expectation(gamma))
        return gamma, theta * beta * (times / (beta @ theta))[:, None]

    def start(step):
        return np.random.default_rng([seed, step]).standard_gamma(100.0, k) / 100

    for step in range(steps):
        total, log_theta, drawn = np.zeros_like(model), np.zeros(k), 0
        for key, counts in docs.values():
            times = int(topics.drawn(np.array([key]), step, seed)[0])
            if times and counts:
                gamma, shares = gamma_of(counts, start(step))
                drawn += times
                log_theta += times * topics.expectation(gamma)
                for t, share in zip(counts, shares):
                    total[place[t]] += times * share
        rate = (1024 + step + 1) ** -0.51
        if drawn:
            model = (1 - rate) * model + rate * (n / np.ceil(0.05 * n) * total + eta)
            alpha = topics.moved_alpha(alpha, log_theta / drawn, float(drawn), rate)
    gammas = {i: gamma_of(counts, start(-1 % 2**32))[0] if counts else np.zeros(k) for i, (_, counts) in docs.items()}
    return {i: g / max(g.sum(), 1e-300) for i, g in gammas.items()}


@pytest.mark.parametrize("min_df", [1.0, 2.0])
def test_topics_without_the_model_in_one_place(spark, monkeypatch, min_df):
    """Beyond the library's values: all terms, all documents and all steps, without its driver."""
    import random
    from collections import Counter

    import numpy as np
    from pyspark.sql import functions as F

    from brambling.functions import text
    from brambling.operators import index, topics

    rng = random.Random(4)
    texts = {i: " ".join(rng.choice(["aa", "bb", "cc"]) + str(rng.randint(0, 9 + i % 50)) for _ in range(rng.randint(1, 90))) for i in range(120)}
    texts |= {500: "", 501: "alone", 502: "a"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(index, "LIBRARY_VALUES", 10)
    monkeypatch.setattr(topics, "ROWS", 100)
    monkeypatch.setattr(topics, "WORDS", 900)
    monkeypatch.setattr(topics, "TERMS", 20)
    monkeypatch.setattr("pyspark.ml.clustering.LDA.fit", None)
    got = {r.doc_id: np.array(r.topics) for r in index.topic_distributions(docs, topics=6, max_iter=5, min_df=min_df).collect()}
    tokens = docs.select("doc_id", text.vector_terms(F.col("text")).alias("tokens"))
    rows = tokens.select("doc_id", F.xxhash64("doc_id", "tokens"), F.transform("tokens", lambda t: F.xxhash64(t))).collect()
    df = Counter(t for r in rows for t in set(r[2]))
    held = {r[0]: (r[1], Counter(t for t in r[2] if df[t] >= min_df)) for r in rows}
    want = plain_topics(held, 6, 5, 0)
    assert got.keys() == texts.keys() and not got[500].any()
    assert max(np.abs(got[i] - want[i]).max() for i in texts) < 1e-4
