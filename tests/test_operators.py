"""Operators on hand-written tables and against plain loops."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brambling.config import DuplicateSettings, SearchSettings
from brambling.operators import cards, crawl, diversify, html, index, rank, simhash, stores
from brambling.plans.search import Engine, build_index
from brambling.sources import stores as files
from brambling.streaming import crawl as stream
from brambling.streaming import fold

FRONTIER = files.FRONTIER


def test_simhash_of_fixture(spark):
    corpus = spark.createDataFrame([(1, ["alpha", "beta", "beta", "gamma", "ünder"])], files.CORPUS)
    weights = spark.createDataFrame([("alpha", 2), ("beta", 1), ("gamma", 2)], "term string, weight long")
    assert simhash.simhashes(index.postings(corpus), weights).first().simhash == 1932094038395791219


def test_hamming_bounds(spark):
    h = spark.createDataFrame([(1, 0), (2, (1 << 16) - 1), (3, (1 << 17) - 1), (4, -1), (5, -1)], "doc_id long, simhash long")
    assert sorted((r.a, r.b) for r in simhash.pairs_of_all(h).collect()) == [(1, 2), (2, 3), (4, 5)]
    assert {r.doc_id for r in simhash.drop_duplicates(h, simhash.duplicate_pairs(h)).collect()} == {1, 4}
    few = DuplicateSettings(pairwise_limit=2)
    assert sorted((r.a, r.b) for r in simhash.duplicate_pairs(h, few).collect()) == [(1, 2), (2, 3), (4, 5)]
    assert [r.doc_id for r in simhash.is_duplicate(h.where("doc_id = 1"), h.where("doc_id = 2")).collect()] == [1]


def test_fold_equals_batch_on_first_document(spark):
    rows = [(1, ["a", "b", "c"] * 3), (2, ["a", "b", "c"] * 3), (3, ["x", "y", "z", "q", "r"])]
    out = {r.doc_id: r for r in fold.sequential(spark.createDataFrame(rows, files.CORPUS)).collect()}
    assert [out[i].duplicate for i in (1, 2, 3)] == [False, True, False]
    one = spark.createDataFrame(rows[:1], files.CORPUS)
    assert out[1].simhash == simhash.simhashes(index.postings(one), simhash.term_weights(simhash.term_frequencies(one))).first().simhash


def scores(spark, rows):
    return spark.createDataFrame([("q", d, float(s)) for d, s in rows], "query_id string, doc_id long, score double")


def test_normalise(spark):
    assert {r.score for r in rank.normalise(scores(spark, [(1, 3), (2, 3)])).collect()} == {1.0}
    assert sorted(r.score for r in rank.normalise(scores(spark, [(1, 1), (2, 3), (3, 2)])).collect()) == [0.0, 0.5, 1.0]
    assert rank.normalise(scores(spark, [])).count() == 0


def test_fuse(spark):
    a, b = scores(spark, [(1, 1), (2, 0.5)]), scores(spark, [(1, 0.5)])
    assert {r.doc_id: r.score for r in rank.fuse([a, b], (0.3, 0.7)).collect()} == {1: 0.65, 2: 0.15}
    for wrong in (None, (1.0,), (0.9, 0.9)):
        assert {r.doc_id: r.score for r in rank.fuse([a, b], wrong).collect()} == {1: 0.75, 2: 0.25}


@pytest.mark.parametrize("n,groups", [(1, 1), (20, 1), (20, 20), (90, 7)])
def test_interleave_equals_loop(spark, n, groups):
    rnd = random.Random(n)
    rows = [("q", i, rnd.randrange(9) / 9, rnd.randrange(groups)) for i in range(n)]
    df = spark.createDataFrame(rows, "query_id string, doc_id long, score double, g int")
    got = [r.doc_id for r in diversify.interleave(df, "g").orderBy("place").collect()]
    queues: dict = {}
    for _, d, s, g in sorted(rows, key=lambda r: (-r[2], r[1])):
        queues.setdefault(g, []).append(d)
    want = []
    while any(queues.values()):
        want += [q.pop(0) for q in queues.values() if q]
    assert got == want[:100]


def test_kmeans_guards(spark):
    e = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], files.EMBEDDINGS)
    assert diversify.kmeans_clusters(e).count() == 4 and diversify.kmeans_clusters(e.limit(1)).count() == 1
    assert diversify.kmeans_clusters(e.limit(0)).count() == 0
    assert diversify.cluster_count(2, 0.5) == 2 and diversify.cluster_count(10, 0.5) == 5


def test_search_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame([(1, "castle museum castle"), (2, "food drinks market"), (3, "museum food"), (4, "")], "doc_id long, text string")
    queries = spark.createDataFrame([("1", "castle museum", 0), ("2", "food", 1), ("3", " ", 2)], files.QUERIES)
    engine = Engine(index.corpus(docs))
    top = {r.query_id: r.doc_id for r in engine.search(queries).where("rank = 1").collect()}
    assert top == {"1": 1, "2": 2} or top == {"1": 1, "2": 3}
    meta = docs.select("doc_id", F.concat(F.lit("u"), "doc_id").alias("url"))
    files.write_results(engine.search_batch(queries, meta), str(tmp_path / "out"))
    lines = [x for p in (tmp_path / "out").glob("part*") for x in p.read_text().splitlines()]
    assert lines[0].split("\t")[:3] == ["1", "1", "u1"] and all(len(x.split("\t")) == 4 for x in lines)
    random_picks = SearchSettings(feedback_random=3)
    assert Engine(index.corpus(docs), random_picks).search(queries).count() > 0
    glued = Engine(index.corpus(docs), SearchSettings(glue_first_pass=True))
    assert {r.term for r in glued.first_pass(queries)[0].where("query_id = '1'").collect()} == {"castlemuseum"}
    stored = build_index(docs, str(tmp_path / "index"))
    tables = files.read_index(spark, str(tmp_path / "index"))
    assert tables["postings"].where("term = 'castle'").first().tf == 2 and tables["lengths"].count() == 4 and tables["topics"].count() == 0
    found = lambda e: sorted(tuple(r) for r in e.search(queries).collect())
    assert found(Engine(stored=stored)) == found(engine)
    plan = Engine(stored=stored).search(queries)._jdf.queryExecution().executedPlan().toString()
    assert "regexp" not in plan and "PartitionFilters: [bucket" in plan and "In(term, [" in plan
    blank = spark.createDataFrame([("1", " ", 0)], files.QUERIES)
    assert Engine(stored=stored).search(blank).count() == 0
    empty = build_index(docs.limit(0), str(tmp_path / "empty"))
    assert Engine(stored=empty).search(queries).count() == 0
    clusters = spark.createDataFrame([(i, i % 2) for i in range(1, 5)], "doc_id long, cluster int")
    both = Engine(index.corpus(docs), clusters=clusters, topics=clusters.withColumnRenamed("cluster", "topic"))
    assert both.search(queries).count() > 0


def test_dense_query_vectors(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], files.EMBEDDINGS)
    q = spark.createDataFrame([("q", [1.0, 0.1])], "query_id string, query_vector array<double>")
    assert rank.ranked(rank.cosine_to_queries(e, q), 1).first().doc_id == 1


def test_query_file(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1\ttübingen  attractions\n2   food and drinks\n1 again\n")
    got = [tuple(r) for r in files.read_queries(spark, str(tmp_path / "q.txt")).orderBy("seq").collect()]
    assert got == [("1", "again", 0), ("2", "food and drinks", 1)]
    (tmp_path / "bad.txt").write_text("1 a\n\n")
    with pytest.raises(Exception, match="no id and query"):
        files.read_queries(spark, str(tmp_path / "bad.txt")).collect()


def test_json_stores(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    meta = files.read_meta(spark, put("m", '{"1": {"url": "u", "title": "t", "hash": 18446744073709551615}}')).first()
    assert tuple(meta) == (1, "u", "t", "", "", -1)
    assert files.read_corpus(spark, put("c", '{"1": "a\\n;\\nb", "2": ""}')).orderBy("doc_id").first().tokens == ["a", "b"]
    assert [tuple(r) for r in files.read_postings(spark, put("p", '{"x": [["1", 3], [2, 1]]}')).orderBy("doc_id").collect()] == [("x", 1, 3), ("x", 2, 1)]
    lengths, vectors, topics = files.read_index_meta(spark, put("i", '{"doc_lengths": {"1": 4}, "doc_embeddings": {"1": [0.5]}, "doc_topic_distributions": {}}'))
    assert lengths.first().dl == 4 and vectors.first().embedding == [0.5] and topics.count() == 0
    f = files.read_frontier(spark, put("f", '{"IN": {"a.b": {"http://a.b/2": 0, "http://a.b/1": 1}}, "OUT": {"c": {"http://c/": 0}}}')).orderBy("enqueue_seq").collect()
    assert [(r.section, r.url, r.enqueue_seq) for r in f] == [("IN", "http://a.b/2", 0), ("IN", "http://a.b/1", 1), ("OUT", "http://c/", 2)]
    visited, domains = files.read_visited(spark, put("v", '{"a.b": {"eng": true, "http://a.b/": false}}'))
    assert visited.first().skipped is False and domains.first().eng is True
    assert files.read_blacklist(spark, put("b", '["x", "x", ".it"]')).count() == 2
    e = {r.label: r.pattern for r in files.read_entities(spark, put("e", '[{"label": "A", "pattern": "Max P"}, {"label": "B", "pattern": [{"LOWER": "max"}, {"LOWER": "p"}]}]')).collect()}
    assert e == {"A": "Max P", "B": "max p"}
    assert files.read_frequencies(spark, put("t", '{"x": 2}')).first().cf == 2
    missing = str(tmp_path / "none")
    for read in (files.read_meta, files.read_corpus, files.read_frontier, files.read_blacklist, files.read_postings):
        assert read(spark, missing).count() == 0
    files.write_json(spark.createDataFrame([("x", 2)], files.FREQUENCIES), str(tmp_path / "out"), "term", "cf")
    assert '{"x":2}' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    many = [(f't"\n{{{i}}}', i) for i in range(10)]
    for parts in (1, 3):
        files.write_json(spark.createDataFrame(many, files.FREQUENCIES).repartition(parts), str(tmp_path / f"many{parts}"), "term", "cf")
        assert sorted(tuple(r) for r in files.read_frequencies(spark, str(tmp_path / f"many{parts}")).collect()) == sorted(many)


def test_stores(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(stores.insert_absent(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "d")]
    assert rows(stores.upsert(old, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]
    assert rows(stores.delete(old, new, ["k"])) == [(1, "a")]
    assert [r.doc_id for r in stores.with_ids(spark.createDataFrame([(5,), (3,)], "seq int"), 9).orderBy("seq").collect()] == [10, 11]


def test_frontier_and_visited(spark):
    f = spark.createDataFrame([("IN", "a", "http://a/1", 0, 0), ("OUT", "b", "http://b/1", 0, 1)], FRONTIER)
    new = spark.createDataFrame([("http://a/2", 5, 0), ("http://b/2", 5, 1), ("http://a/1", 7, 2)], "url string, priority int, seq long")
    got = {r.url: (r.section, r.priority, r.enqueue_seq) for r in stores.frontier_add(f, new).collect()}
    assert got == {"http://a/1": ("IN", 7, 0), "http://b/1": ("OUT", 0, 1), "http://a/2": ("IN", 5, 2), "http://b/2": ("OUT", 5, 3)}
    gone = stores.frontier_remove(f, spark.createDataFrame([("http://a/1",), ("http://b/1",), ("http://c/1",)], "url string"))
    assert gone.count() == 0
    visited, domains = spark.createDataFrame([("a", "http://a/1", True)], files.VISITED), spark.createDataFrame([("a", True)], files.DOMAINS)
    events = spark.createDataFrame([("http://a/1", False, False, 1), ("http://b/1", False, True, 0)], "url string, is_english boolean, skipped boolean, seq long")
    v, d = stores.visited_update(visited, domains, events)
    assert {r.url: r.skipped for r in v.collect()} == {"http://a/1": False, "http://b/1": True} and {r.domain: r.eng for r in d.collect()} == {"a": True, "b": False}


PAGE = """<html><head><title> My &amp; page </title><meta name="description" content=" d "></head><body>
<main><div id="x"><p>One <b>bold</b> text</p><div class="inner"><p>Deep text</p><p>One</p></div><p>accept Cookies</p><script>no</script></div></main>
<div class="maincontent"><li>Item text<li>Second item</div><div><p>elsewhere</p></div>
<a href="/en/x" hreflang="en-GB">English</a><a href="a.html">r</a><a href="/y?z=1">y</a><form><p>form</p></form></body></html>"""


def test_html(spark):
    row = html.extract(spark.createDataFrame([("http://h/p", PAGE), ("http://h/q", "plain"), ("http://h/r", None)], "url string, html string")).orderBy("url").collect()
    assert (row[0].title, row[0].description, row[0].keywords) == ("My & page", "d", "")
    assert row[0].blocks == ["One", "bold", "text", "Deep text", "Item text", "Second item"]
    assert [(x.href, x.hreflang) for x in row[0].links] == [("/en/x", "en-GB"), ("a.html", ""), ("/y?z=1", "")]
    assert not row[1].has_body and not row[2].has_body and "form" not in row[0].full_text
    assert [r.no_html for r in row] == [False, False, True]


def test_no_page_stops_the_others(spark):
    deep = "<body>" + "<div>" * 3000 + "<p>deep words</p>" + "</div>" * 3000 + "<p>after</p></body>"
    odd = [("http://[bad/", "<body><p>in brackets</p></body>"), ("http://h/deep", deep), (None, "<body><p>no url</p></body>"), ("http://h/none", None), ("http://h/empty", ""),
           ("http://h/broken", "<body><p>open <b>bold<td></p></i><a href>x<a href='/y'"), ("::", "<<<>>&#xD800;<body a=1 a=2><p>odd one"), ("http://h/nul", "<body>\0<p>nul\0l</p>")]
    got = {r.url: r for r in html.extract(spark.createDataFrame(odd, "url string, html string")).collect()}
    assert len(got) == len(odd) and got["http://[bad/"].full_text == "in brackets" and got[None].full_text == "no url"
    assert "deep words" in got["http://h/deep"].full_text and "after" in got["http://h/deep"].full_text
    assert got["http://h/none"].no_html and got["http://h/empty"].no_html and not got["http://h/broken"].no_html


def test_site_selectors(spark):
    page = '<body><div>no<p>out</p></div><div id="bodyContent"><p>in text<span class="mw-editsection">edit</span></p><div id="catlinks"><p>cats</p></div></div></body>'
    rows = spark.createDataFrame([("https://en.wikipedia.org/wiki/X", page), ("https://arxiv.org/x", page)], "url string, html string")
    got = {r.url: r.blocks for r in html.extract(rows).collect()}
    assert got == {"https://en.wikipedia.org/wiki/X": ["in text"], "https://arxiv.org/x": []}


def test_link_filter(spark):
    hrefs = ["#frag", "a.html", "/x", "//host/x", "mailto:me@h", "/a.PDF", "/a.pdf", "/research", "/university", "/x?again", "http://o/x", "/seen", "/y#f"]
    rows = [("http://h/en/p", i, h, "") for i, h in enumerate(hrefs)] + [("http://h/en/p", 50, "/de", "de"), ("http://h/en/p", 51, "/gb/en/", "en-GB")]
    links = spark.createDataFrame(rows, "page_url string, pos int, href string, hreflang string")
    visited = spark.createDataFrame([("h", "http://h/seen", False)], files.VISITED)
    none, eng = spark.createDataFrame([], files.DOMAINS), spark.createDataFrame([("h", True)], files.DOMAINS)
    got = [r.url for r in crawl.filter_links(links, visited, none).orderBy("pos").collect()]
    assert got == ["http://h/x", "http://h/a.PDF", "http://h/gb/en/"]
    assert [r.url for r in crawl.filter_links(links, visited, eng).orderBy("pos").collect()] == ["http://host/x", "http://h/gb/en/"]


def test_gates_in_order(spark):
    rows = [("a", "t", "Tübingen", "en", 0.9, False, True, False), ("b", "t", "Tuebingen", "de", 0.7, False, True, False), ("c", "t", "tübingen", "de", 0.9, False, True, False),
            ("d", "t", "nothing", "en", 0.9, False, True, True), ("e", "t", "tübingen", "en", 0.9, False, True, True), ("f", "t", "x", "en", 0.9, True, False, False),
            ("g", "", "tübingen", "en", 0.9, False, True, False), ("h", "t", "x", None, None, False, False, False), ("i", "", "", None, None, True, False, False)]
    df = spark.createDataFrame(rows, "url string, text string, full_text string, lang string, lang_score double, seen boolean, has_body boolean, duplicate boolean")
    df = df.withColumn("no_html", F.col("url") == "i")
    got = {r.url: r.decision for r in crawl.decide(df).collect()}
    assert got == {"a": "accept", "b": "accept", "c": "language", "d": "off_topic", "e": "duplicate", "f": "visited", "g": "language", "h": "no_body", "i": "empty"}


def test_schedule_turns(spark):
    rows = [("IN", d, f"http://{d}/{i}", 0, n) for n, (d, i) in enumerate([("a", 0), ("a", 1), ("b", 0), ("a", 2), ("c", 0), ("b", 1)])]
    f = spark.createDataFrame(rows, FRONTIER)
    order = lambda **k: [r.url[7:] for r in crawl.schedule(f, 1, **k).orderBy("slot").collect()]
    assert order() == ["a/0", "b/0", "c/0", "a/1", "b/1", "a/2"]
    assert order(cursor=1, limit=4) == ["b/0", "c/0", "a/0", "b/1"]
    assert crawl.schedule(f, 3, 4).count() == 2 and crawl.schedule(f, 2).count() == 0


def test_cards(spark):
    corpus = spark.createDataFrame([(1, ["x", "y", "y"]), (2, ["z"])], files.CORPUS)
    meta = spark.createDataFrame([(1, "u", "t", "d" * 300, ""), (2, "v", "t", "d", "k" * 20)], "doc_id long, url string, title string, description string, keywords string")
    results = spark.createDataFrame([("q", 1, 1.0, 1), ("q", 2, 0.5, 2), ("q", 3, 0.1, 3)], "query_id string, doc_id long, score double, rank int")
    got = {r.doc_id: r for r in cards.result_cards(results, meta, corpus).collect()}
    assert got[1].keywords == "y, x" and len(got[1].description) == 253 and got[2].keywords == "k" * 10 and got[3].url is None
    assert cards.without_pinned(results, results.where("doc_id = 1")).count() == 2
    h = spark.createDataFrame([("a", 0)], "query string, seq long")
    assert cards.history(h, spark.createDataFrame([("a", 1), ("b", 2)], "query string, seq long")).count() == 2


def test_crawl_stream_and_restart(spark, sf, tmp_path):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    for i in range(3):
        pages.where(f"page_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    root, check = str(tmp_path / "state"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        stream.crawl(stream.page_stream(spark, str(tmp_path / "in"), files=1), root, check, ["the"]).awaitTermination()
        assert stream.latest_version(spark, root) == 2
    state = stream.load_state(spark, root, 2)
    assert state["visited"].count() == pages.select("url").distinct().count()
    assert state["meta"].count() == state["corpus"].count() > 0 and state["frontier"].count() > 0
    assert state["frequencies"].count() > 0 and stream.latest_version(spark, str(tmp_path / "none")) == -1


def test_first_of_url(spark, sf, tmp_path):
    stream_ = stream.first_of_url(stream.page_stream(spark, f"{sf}/pages.parquet*"))
    q = stream_.writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == spark.read.parquet(f"{sf}/pages.parquet").select("url").distinct().count()


def test_topics(spark):
    docs = spark.createDataFrame([(1, "red blue red"), (2, "blue red"), (3, "")], "doc_id long, text string")
    out = index.topic_distributions(docs, topics=3, max_iter=2, min_df=1.0).collect()
    assert len(out) == 3 and all(len(r.topics) == 3 for r in out)
    assert index.topic_distributions(docs.limit(0)).count() == 0


def test_registered_topics_are_whole(spark, sf, monkeypatch):
    from pyspark.ml import clustering, feature

    from brambling import catalog

    seen = {}

    def fit_counts(self, tokens, fit=feature.CountVectorizer.fit):
        model = fit(self, tokens)
        seen["terms"] = (len(model.vocabulary), self.getVocabSize(), self.getMinDF())
        return model

    def fit_topics(self, counts, fit=clustering.LDA.fit):
        seen["model"] = (self.getK(), self.getMaxIter())
        return fit(self, counts, {self.maxIter: 1})

    monkeypatch.setattr(feature.CountVectorizer, "fit", fit_counts)
    monkeypatch.setattr(clustering.LDA, "fit", fit_topics)
    rows = catalog.lda_topics(spark, sf).collect()
    assert {r.k for r in rows} == {100} and seen["model"] == (100, 20)
    assert 5000 < seen["terms"][0] and seen["terms"][1:] == (2**31 - 1, 1.0)


def test_registered_clusters_are_half_the_rows(spark, tmp_path, monkeypatch):
    from pyspark.ml import clustering

    from brambling import catalog

    seen = []

    def fit(self, rows, fit=clustering.KMeans.fit):
        seen.append(self.getK())
        return fit(self, rows, {self.k: 3, self.maxIter: 1})

    monkeypatch.setattr(clustering.KMeans, "fit", fit)
    for n in (600, 2200):
        rows = spark.range(n).selectExpr("id AS vec_id", "array(float(cos(id)), float(sin(id)), float(id % 7)) AS embedding", "int(id % 2) AS label")
        rows.write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
        assert catalog.kmeans_diversify(spark, f"{tmp_path}/{n}").count() > 0
    assert seen == [300, 1100]


def test_pairs_of_blocks_and_sums_of_batches(spark, monkeypatch):
    """Several blocks, strips and batches give what one loop over all gives."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = {i: [rng.choice(words[: 4 + i % 9]) for _ in range(rng.randint(1, 30))] for i in range(90)}
    # A document in two rows, and one without tokens.
    texts[3] += texts[4]
    rows = [(i, t) for i, t in texts.items() if i != 3] + [(3, texts[3][:5]), (3, texts[3][5:]), (95, [])]
    corpus = spark.createDataFrame(rows, files.CORPUS)
    posts, weights = index.postings(corpus), simhash.term_weights(simhash.term_frequencies(corpus))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    monkeypatch.setattr(simhash, "BLOCK", 13)
    try:
        made = simhash.corpus_simhashes(corpus)
        rows, whole = ({r.doc_id: r for r in h.collect()} for h in (simhash.simhashes(posts, weights), made))
        got = sorted(tuple(r) for r in simhash.pairs_of_all(made).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    weight = {r.term: r.weight for r in weights.collect()}
    hashes = {}
    for i, tokens in texts.items():
        own = [(int(hashlib.sha256(t.encode()).hexdigest()[-16:], 16), weight[t]) for t in tokens]
        hashes[i] = sum(1 << b for b in range(64) if sum(w if h >> b & 1 else -w for h, w in own) > 0)
    assert rows == whole
    assert {i: (r.hi, r.lo, r.simhash % (1 << 64)) for i, r in rows.items()} == {i: (h >> 32, h % (1 << 32), h) for i, h in hashes.items()}
    near = [(a, b, (hashes[a] ^ hashes[b]).bit_count()) for a in hashes for b in hashes if a < b]
    assert got == [p for p in near if p[2] <= 16] and got


def test_clusters_in_blocks(spark, monkeypatch):
    """Beyond the library's rows: each row has its nearest mean, the clusters are as tight as
    the library's, and equal vectors are one."""
    rng = random.Random(3)
    middle = [[rng.uniform(-9, 9) for _ in range(4)] for _ in range(50)]
    rows = {i: [x + rng.gauss(0, 1) for x in middle[i % 50]] for i in range(240)}
    frame = spark.createDataFrame(list(rows.items()), files.EMBEDDINGS)

    def means():
        found = {r.doc_id: r.cluster for r in diversify.kmeans_clusters(frame).collect()}
        groups = {c: [rows[i] for i in rows if found[i] == c] for c in found.values()}
        assert len(found) == 240 and len(groups) == 120
        return found, {c: [sum(x) / len(g) for x in zip(*g)] for c, g in groups.items()}

    def far(x, y):
        return sum((a - b) ** 2 for a, b in zip(x, y))

    found, own = means()
    library = sum(far(rows[i], own[c]) for i, c in found.items())
    monkeypatch.setattr(diversify, "LIBRARY_ROWS", 10)
    monkeypatch.setattr(diversify, "TASK_ROWS", 50)
    monkeypatch.setattr(diversify, "CENTRES", 7)
    monkeypatch.setattr("pyspark.ml.clustering.KMeans.fit", None)
    found, own = means()
    assert all(far(rows[i], own[c]) <= min(far(rows[i], m) for m in own.values()) + 1e-9 for i, c in found.items())
    assert sum(far(rows[i], own[c]) for i, c in found.items()) < 1.1 * library
    same = spark.createDataFrame([(i, [float(i % 2), 1.0]) for i in range(40)], files.EMBEDDINGS)
    found = {r.doc_id: r.cluster for r in diversify.kmeans_clusters(same).collect()}
    assert [found[i] for i in range(40)] == [found[0], found[1]] * 20 and found[0] != found[1]
