"""Token store, mix, urls, duplicates, toxicity, chat, benchmark: against SQL, brute force,
exact round trips and held-out labels; odd tables."""

import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from brambling.llm import base, chat, components, decontaminate, mixing, near_duplicates, registry, token_store, toxicity, urls


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_its_sql(same, name):
    assert same(registry.QUERIES[name], registry.ORACLE[name]) > 0


# token store
def library_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [e.ids + [2] for e in t.encode_batch(texts, add_special_tokens=False)]


ODD_TEXTS = ["", " ", "a  b", "x.\ny, z", "\n\n", "don't we're", "a\u00a0b \u00a0c", "<|endoftext|> x <|endoftext|>", "tab\tt", "日本語 é.", "1,000.5 x.,", "\0", "end ", "word " * 9000]


def test_encoder_equals_the_library(spark, sf):
    import public_tokenizers

    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    got = [np.frombuffer(b, enc.kind).tolist() + [2] for b in enc.encode(texts)]
    assert got == library_ids(texts) and [np.frombuffer(b, enc.kind).tolist() + [2] for b in enc.encode(texts)] == got


def test_every_letter_is_encoded_like_the_library_does():
    import sys

    import public_tokenizers

    enc = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    letters = [chr(c) for c in range(sys.maxunicode + 1) if chr(c).isalpha()]
    texts = [" ".join(f"a{x}b {x}, {x}{x}$%& {x}'s" for x in letters[i : i + 500]) for i in range(0, len(letters), 500)]
    assert [np.frombuffer(b, enc.kind).tolist() + [2] for b in enc.encode(texts)] == library_ids(texts)


def test_random_pieces_are_encoded_like_the_library_does():
    import public_tokenizers

    enc, rnd = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json")), random.Random(31)
    signs = list(token_store.SIGNS) + ["'s", "'ll", "é", "Ab", "word", "straße", "1", "٣", "½", "ǅ", "–", "’", "…", "日", "\u0301", "😀", "_", " ", "\n"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(1, 9))) for _ in range(20000)]
    assert [np.frombuffer(b, enc.kind).tolist() + [2] for b in enc.encode(texts)] == library_ids(texts)


def test_store_round_trip(spark):
    rows = [(7, "b c"), (3, None), (None, "first"), (5, "x " * 5000), (5, "x " * 5000), (4, "tail"), (9, "same " * 3000 + "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'k' AS keys", "1 AS start")
    path = token_store.write_store(docs)
    got = token_store.verify_store(spark, path).orderBy("start").collect()
    want, at = [], 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for (d, _), ids in zip(ordered, library_ids([t or "" for _, t in ordered])):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    assert [tuple(r)[:4] for r in got] == [w[:4] for w in want]
    assert [list(r.ids) for r in token_store.read_documents(spark, path).orderBy("start").collect()] == [w[4] for w in want]
    keys = spark.read.parquet(f"{path}/chunks").select("key")
    assert keys.count() == keys.distinct().count()


def test_damage_is_noticed(spark):
    path = token_store.write_store(spark.createDataFrame([(1, "some words here")], "doc_id long, text string"))
    chunks = spark.read.parquet(f"{path}/chunks").selectExpr("key", "n_ids", "concat(payload, X'0000') AS payload")
    rows = chunks.collect()
    spark.createDataFrame(rows, token_store.CHUNKS).write.mode("overwrite").parquet(f"{path}/chunks")
    with pytest.raises(Exception, match="doesn't hold what its key says"):
        token_store.verify_store(spark, path).collect()


def test_lost_recipes_are_noticed(spark):
    docs = spark.createDataFrame([(i % 90, f"text {i} " * (i % 7)) for i in range(100)], "doc_id long, text string")
    path = token_store.write_store(docs)
    assert token_store.verify_store(spark, path).count() == 100
    recipes = spark.read.schema(token_store.RECIPES).parquet(f"{path}/recipes").collect()
    manifest = spark.read.schema(token_store.MANIFEST).parquet(f"{path}/manifest").collect()
    (whole,) = [r for r in manifest if r.part == token_store.WHOLE]
    parts = sorted(r for r in manifest if r.part != token_store.WHOLE)
    assert len(parts) > 1 and whole.n_docs == 100 and whole.root == token_store.merkle([bytes(r.root) for r in parts])
    by_start = sorted(recipes, key=lambda r: r.start)
    second = [r for r in by_start if r.start >= parts[1].offset]
    damaged = ([r for r in recipes if r != by_start[40]], by_start[:-1], by_start[1:], [*recipes, by_start[3]], second, [])
    for rows in damaged:  # a row, the last, the first, one twice, a whole partition, all
        spark.createDataFrame(rows, token_store.RECIPES).write.mode("overwrite").parquet(f"{path}/recipes")
        with pytest.raises(ValueError, match="manifest"):
            token_store.verify_store(spark, path).collect()
    spark.createDataFrame(recipes, token_store.RECIPES).write.mode("overwrite").parquet(f"{path}/recipes")
    assert token_store.verify_store(spark, path).count() == 100
    next(f for f in Path(path.removeprefix("file://"), "recipes").glob("*.parquet") if spark.read.parquet(str(f)).count()).unlink()
    with pytest.raises(ValueError, match="manifest"):
        token_store.verify_store(spark, path).collect()
    empty = token_store.write_store(docs.limit(0))
    assert token_store.verify_store(spark, empty).count() == 0


def test_merkle_of_leaves_one_by_one():
    for n in range(40):
        tree, leaves = token_store.Merkle(), [bytes([k]) * 32 for k in range(n)]
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == token_store.merkle(leaves)


def test_equal_passages_share_chunks():
    ids = np.random.default_rng(1).integers(0, 50000, 9000).astype("<u2")
    shifted = np.concatenate([ids[:7], ids])
    both = []
    for x in (ids, shifted):
        ends = token_store.cuts(x, np.array([0]), np.array([len(x)]))[0]
        both.append({token_store.key_of(x[a:b].tobytes()) for a, b in zip([0, *ends], ends)})
        assert all(token_store.LEAST <= b - a <= token_store.MOST for a, b in zip([0, *ends], ends[:-1]))
    assert len(both[0] & both[1]) > 0.7 * len(both[0])


def test_joined_crc():
    a, b, c = b"abcd" * 9, b"", b"xyz0"
    assert token_store.joined_crc([(len(x), zlib.crc32(x)) for x in (a, b, c)]) == zlib.crc32(a + b + c)


# mix
def test_mix_rates_and_odd_sources(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, null, 's') AS source", "'old' AS copy_no", "id AS extra")
    out = mixing.poisson_mix(docs, {"s": 3.0}, default_weight=1.0, epochs=2.0).cache()
    n = {r.source: r.n for r in out.groupBy("source").count().withColumnRenamed("count", "n").collect()}
    assert abs(n["s"] / 9000 - 1) < 0.05 and abs(n[None] / 3000 - 1) < 0.08
    assert out.columns == ["doc_id", "source", "extra", "copy_no", "shuffle_key"]
    spread = [r.n for r in out.selectExpr("spark_partition_id() AS p").groupBy("p").count().withColumnRenamed("count", "n").collect()]
    assert min(spread) > 0.7 * max(spread)
    assert mixing.poisson_mix(docs.limit(0)).count() == 0
    assert mixing.poisson_mix(docs, {"s": 0.0}).where("source = 's'").count() == 0


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "'s' AS source", "id AS __count", "id + 1 AS __SOURCE", "id + 2 AS __cdf", "id + 3 AS __u", "id + 4 AS __first")
    out = mixing.poisson_mix(docs, epochs=2.0)
    assert out.columns == [*docs.columns, "copy_no", "shuffle_key"]
    assert all(r[2:7] == (r[0], r[0] + 1, r[0] + 2, r[0] + 3, r[0] + 4) for r in out.collect())


def test_counts_are_poisson(spark):
    out = mixing.poisson_mix(spark.range(20000).selectExpr("id AS doc_id", "'s' AS source"), epochs=1.5).groupBy("doc_id").count()
    counts = np.bincount([r[1] for r in out.collect()], minlength=8)
    counts[0] = 20000 - counts.sum()
    want = 20000 * np.array([0.22313, 0.33470, 0.25102, 0.12551])
    assert np.abs(counts[:4] - want).max() < 4 * np.sqrt(want.max())


def test_a_source_of_one_row(spark):
    docs = spark.range(20000).selectExpr("id AS doc_id", "if(id = 77, null, concat('s', id % 20)) AS source")
    n = {r.source: r["count"] for r in mixing.poisson_mix(docs, epochs=1.2).groupBy("source").count().collect()}
    rate = 1.2 * 20000 / 21
    assert len(n) == 21 and abs(n[None] - rate) < 6 * rate**0.5
    assert all(abs(n[f"s{k}"] - rate) < 6 * rate**0.5 for k in range(20))


def test_chances_of_large_rates(spark):
    for rate in (500.5, 650.0):  # the direct sum doesn't underflow yet
        p = np.exp(-rate) * np.cumprod(np.concatenate([[1.0], rate / np.arange(1, 1100)]))
        first, cdf = mixing.far_chances(rate)
        assert np.abs(np.cumsum(p)[first : first + len(cdf)] - cdf).max() < 1e-11
    docs = spark.range(300).selectExpr("id AS doc_id", "'s' AS source")
    counts = [r[1] for r in mixing.poisson_mix(docs, epochs=3000.0).groupBy("doc_id").count().collect()]
    assert len(counts) == 300 and abs(np.mean(counts) - 3000) < 20 and 0.7 < np.var(counts) / 3000 < 1.4


# urls
def test_url_contract_and_odd_rows(spark):
    rows = [(1, "http://A.Example.com/en/5?x"), (2, "https://www.example.com/en/1"), (3, "http://www.example.com"), (4, "HTTP://x.net/es/9.html#a"), (5, None),
            (6, "no url"), (7, ""), (8, "http://net/fr/"), (9, "http://xnet/fr/"), (10, "http://q.org?a://b/c"), (None, "http://q.org/ABC/x"), (1, "http://A.Example.com/en/5?x")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "'h' AS host", "1 AS template")
    out = urls.filter_urls(pages).collect()
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert len(out) == len(rows)
    assert by[1] == ("a.example.com", "/en/5", "example.com/en/", "block")
    assert by[2] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert by[3][:3] == ("www.example.com", "", None) and by[4][:3] == ("x.net", "/es/9.html", "net/es/")
    assert by[5][:3] == by[6][:3] == by[7][:3] == ("", "", None) and by[8][2] == "net/fr/" and by[9][2] is None
    assert by[10][:2] == ("q.org", "") and by[None][:2] == ("q.org", "/ABC/x")
    assert all(r.verdict in ("allow", "block") for r in out)
    assert urls.filter_urls(pages.limit(0)).count() == 0


def test_tree_learns_templates(spark):
    rows = [(i, f"http://s.com/{'bad' if i % 2 else 'good'}/{i}/x{i % 5}.html") for i in range(200)]
    rules = (urls.UrlRule("block", "s.com/bad/1"), urls.UrlRule("allow", "s.com/good/1"), urls.UrlRule("allow", "s.com/good/2"))
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert all(r.verdict == ("block" if "/bad/" in r.path else "allow") for r in out)
    assert {r.template.split("/")[1] for r in out} == {"bad", "good"}


def test_tree_ends_where_the_longest_path_does(spark, tmp_path, duck):
    import duckdb

    rows = [(i, f"http://s.com/a/b/c/d/e/{'bad' if i % 2 else 'good'}/g/h/p{i}.html") for i in range(300)]
    rows += [(1000 + i, f"http://t.org/{'/'.join('k' * (i % 12 + 1))}") for i in range(60)] + [(2000, "http://s.com/a//"), (2001, None), (2002, "http://s.com")]
    rules = (urls.UrlRule("block", "s.com/a/b/c/d/e/bad/g/h/p1"), urls.UrlRule("allow", "s.com/a/b/c/d/e/good/g/h/p1"), urls.UrlRule("allow", "s.com/a/b/c/d/e/good/g/h/p2"))
    pages = spark.createDataFrame(rows, "page_id long, url string")
    out = {r.page_id: r for r in urls.filter_urls(pages, rules).collect()}
    assert all(out[i].verdict == ("block" if i % 2 else "allow") for i in range(300))
    assert all(out[i].template.split("/")[6] == ("bad" if i % 2 else "good") for i in range(300))
    con = duckdb.connect()
    pages.write.parquet(f"{tmp_path}/pages")
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    columns = "page_id, host, path, rule, verdict, template"
    want = con.execute(f"SELECT {columns} FROM ({registry.ORACLE['op5_url_filter']}) q").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in urls.filter_urls(pages).select(*columns.split(", ")).collect())


# near-duplicates
def test_similarity_against_plain_alignment():
    rnd = random.Random(3)
    for _ in range(200):
        a = [rnd.randrange(60) for _ in range(rnd.randrange(1, 50))]
        b = [x for x in a if rnd.random() > 0.03]
        if rnd.random() < 0.5 and len(b) > 4:
            b[1], b[3] = b[3], b[1]
        if not b:
            continue
        x, y = (near_duplicates.first_places(np.array(v, np.uint64) << np.uint64(32)) for v in (a, b))
        p, q = np.frombuffer(x, "<u4").tolist(), np.frombuffer(y, "<u4").tolist()
        t = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p)):
            for j in range(len(q)):
                t[i + 1][j + 1] = t[i][j] + 1 if p[i] == q[j] else max(t[i][j + 1], t[i + 1][j])
        want = t[-1][-1] / (len(p) + len(q) - t[-1][-1])
        got = near_duplicates.similarity(x, y)
        assert got == want if want >= 0.8 else got < 0.8


def brute_classes(rows):
    hashes, first, parent, seqs = near_duplicates.Hashes(), {}, {}, {}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for d, t in sorted(rows):
        parent[d] = first.setdefault(t, d)
        if parent[d] == d:
            s = near_duplicates.shingles(t.encode(), hashes)
            seqs[d] = (near_duplicates.first_places(s), set(s.tolist()))
    ids = sorted(seqs)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = seqs[a], seqs[b]
            if x[1] and min(len(x[1]), len(y[1])) >= 0.8 * max(len(x[1]), len(y[1])) and near_duplicates.similarity(x[0], y[0]) >= 0.8:
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def edited(words, rnd, n):
    words = list(words)
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"new{rnd.randrange(10**6)}"
    return words


def test_near_duplicates_equal_brute_force(spark):
    rnd = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for g in range(12):
        text = [f"w{rnd.randrange(4000)}" for _ in range(rnd.randrange(120, 400))]
        rows += [" ".join(edited(text, rnd, k % 4)) for k in range(rnd.randrange(1, 9))]
        rows.append(" ".join(text[:60] + passage + text[60:]))
    rows += [" ".join(passage + [f"z{rnd.randrange(10**6)}" for _ in range(70)]) for _ in range(40)]
    rows += [rows[0]] * 5 + ["", "", "a b", "a b", "a b c", "!", "?"]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS class_id", "2 AS id")
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()}
    assert got == brute_classes(rows)
    kept = sorted(r.doc_id for r in near_duplicates.keep_one(docs).collect())
    assert kept == sorted(set(got.values()))


def test_variants_linked_through_their_original_alone(spark):
    rnd = random.Random(12)
    text = [f"w{i}" for i in range(200)]
    rows = [" ".join(text)]
    for v in range(400):
        own = list(text)
        for k, at in enumerate(rnd.sample(range(3, 39), 4)):
            own[5 * at] = f"v{v}x{k}"
        rows.append(" ".join(own))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_classes(rows)
    assert len(set(want.values())) == 1
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_buckets_are_finished_exactly(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 16)
    rnd = random.Random(13)
    seqs, entries, classes = {}, [], []
    for g in range(3):  # no star round before: all links are left to the blocks
        text = [rnd.randrange(1, 2**32) for _ in range(100)]
        for v in range(60):
            own = list(text)
            for at in rnd.sample(range(100), rnd.choice([0, 5, 11, 16])):
                own[at] = rnd.randrange(1, 2**32)
            i = 100 * g + v
            seqs[i] = np.array(own[: rnd.choice([100, 100, 90, 70])], "<u4").tobytes()
            entries += [(k, i) for k in (1, 2 + g)]
            classes.append((i, 100 * g + 20 if 20 <= v < 55 else i))
    of = dict(classes)
    want = {(a, b) for a in seqs for b in seqs if a < b and of[a] != of[b] and near_duplicates.similarity(seqs[a], seqs[b]) >= 0.8}

    def components_of(links):
        parent = dict(classes)

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return {i: find(i) for i in parent}

    tables = (spark.createDataFrame(entries, "key long, id long"), spark.createDataFrame(classes, "id long, comp long"),
              spark.createDataFrame([(i, s, len(s)) for i, s in seqs.items()], "id long, seq binary, size int"))
    links = {tuple(r) for r in near_duplicates.finished(*tables, 0.8).collect()}
    assert links <= want and components_of(links) == components_of(want)
    assert len(want) > 100


def test_duplicates_in_odd_tables(spark):
    schema = "doc_id long, text string"
    assert near_duplicates.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "x y z"), (1, "x y z"), (2, None), (3, ""), (None, "x y z"), (None, "lonely"), (4, "long " * 100_000), (5, "long " * 100_000), (1, "other"), (6, "other"), (1, "third text")]
    docs = spark.createDataFrame(rows, schema)
    got = sorted((str(r.doc_id), str(r.class_id)) for r in near_duplicates.near_duplicates(docs).collect())
    assert got == sorted([("1", "1"), ("1", "1"), ("2", "2"), ("3", "2"), ("None", "1"), ("None", "None"), ("4", "4"), ("5", "4"), ("1", "1"), ("6", "1"), ("1", "1")])
    kept = sorted((str(r.doc_id), (r.text or "")[:9]) for r in near_duplicates.keep_one(docs).collect())
    assert kept == sorted([("1", "x y z"), ("2", ""), ("None", "lonely"), ("4", "long long"), ("1", "other"), ("1", "third tex")])


def test_rows_without_ids_are_linked(spark):
    text = [f"w{i}" for i in range(100)]
    near = [" ".join([*text[:k], "new", *text[k + 1 :]]) for k in (10, 50, 90)]
    other = [" ".join([f"v{i}" for i in range(60)] + [x]) for x in "ab"]
    docs = spark.createDataFrame([(None, near[0]), (7, near[1]), (None, near[2]), (None, other[0]), (None, other[1]), (None, other[1])], "doc_id long, text string")
    got = [r.class_id for r in near_duplicates.near_duplicates(docs).collect()]
    assert sorted(map(str, got)) == ["7", "7", "7", "None", "None", "None"]
    kept = near_duplicates.keep_one(docs).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {7, None}


def test_repeated_lines_in_other_numbers(spark):
    rnd, rows = random.Random(21), []
    for g in range(100):
        own, line = [f"t{g}x{i}" for i in range(60)], [f"l{g}x{i}" for i in range(20)]
        rows += [(2 * g, " ".join(own + line)), (2 * g + 1, " ".join(own + line * 40))]
    passage = [f"r{i}" for i in range(100)]  # whole texts repeated, and edited then
    rows += [(1000 + k, " ".join(edited(passage * (k % 4 + 1), rnd, k % 3))) for k in range(12)]
    got = {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * g + 1] == 2 * g for g in range(100))
    assert got == brute_classes(rows)


def test_components_of_chains_and_stars(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200 + rnd.randrange(30), 200 + rnd.randrange(30)) for _ in range(25)] + [(5, 5)]
    got = {r.id: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for start in near:
        seen, stack = {start}, [start]
        while stack:
            for y in near[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        if len(near[start] - {start}):
            assert got[start] == min(seen)


# toxicity
def test_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    out = registry.QUERIES["op7_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hit = sum(r.predicted == r.toxic for r in out)
    toxic = [r for r in out if r.toxic]
    assert len(out) > 500 and hit / len(out) > 0.9
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.6
    assert {r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out} == {True}


def pythons(node):
    """(of the stage that ends in this plan, the most of any stage): steps run by Python workers."""
    name = node.nodeName()
    if name.startswith("AdaptiveSparkPlan"):
        return pythons(node.executedPlan())
    below = [pythons(node.children().apply(k)) for k in range(node.children().size())]
    own = sum(b[0] for b in below) + (name == "MapInArrow")
    most = max([own, *(b[1] for b in below)])
    return (0, most) if "Exchange" in name else (own, most)


def test_toxicity_takes_one_worker_a_task(spark, sf, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    most, plain = [], DataFrame.mapInArrow

    def watched(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        most.append(pythons(out._jdf.queryExecution().executedPlan())[1])
        return out

    monkeypatch.setattr(DataFrame, "mapInArrow", watched)
    docs = base.table(spark, sf, "documents")
    toxicity.drop_toxic(docs, toxicity.fit(docs, base.table(spark, sf, "labels")))
    assert len(most) >= 5 and set(most) == {1}


def test_moments_equal_brute_force(spark):
    texts = ["you idiot, you moron", "idiot", None, "plain words", "stupid stupid loser", ""] * 3
    rows = base.texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    terms = [("word", s.encode()) for s in toxicity.SEEDS] + [("begin", b"plai")]
    votes = np.array([toxicity.Voters(terms).votes(base.words((t or "").encode())) for t in texts], np.int64)
    both, product = toxicity.moments(rows, terms)
    assert (both == np.abs(votes).T @ np.abs(votes)).all() and (product == votes.T @ votes).all() and both.any()
    assert not toxicity.moments(rows.limit(0), terms)[0].any()


def test_a_worker_keeps_the_caches_of_one_operator(spark, monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from pyspark.sql.classic.dataframe import DataFrame

    steps, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, run, *args, **kwargs: steps.append(run) or plain(self, run, *args, **kwargs))
    docs = spark.createDataFrame([(0, "some words to keep"), (1, "others")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    model = toxicity.Model((("word", b"idiot"),), np.zeros(7), np.zeros(7), np.zeros(7))
    token_store.encode_documents(docs, path, 2, "doc_id", "text")
    toxicity.drop_toxic(docs, model)
    toxicity.score(docs, model)
    near_duplicates.sketches(base.texts(docs))
    decontaminate.contaminated(docs, docs.withColumnRenamed("doc_id", "item_id"))
    encode, *others = steps
    batch = pa.RecordBatch.from_pydict({"doc_id": [0, 1], "text": ["some words to keep", "others"], "same": [b"a", b"b"]})
    token_store.encoder.cache_clear()
    for run in others:  # as tasks in one worker
        for _ in range(2):
            assert sum(b.num_rows for b in encode(iter([batch.select(["doc_id", "text"])]))) >= 4
        assert token_store.encoder.cache_info().hits >= 1 and not decontaminate._LAST  # kept between its own tasks
        list(run(iter([batch])))
        assert token_store.encoder.cache_info().currsize == 0


def test_toxicity_in_odd_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = [(1, "you are such an idiot, clown"), (2, None), (3, ""), (2, None), (None, "a fine day of work")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS votes", "0 AS score")
    model = toxicity.fit(docs, labels)
    out = toxicity.score(docs, model).collect()
    by = {r.doc_id: r.score for r in out}
    assert len(out) == 5 and by[1] > by[2] and by[2] == by[3] and all(0 <= s <= 1 for s in by.values())
    assert toxicity.drop_toxic(docs, model).columns == docs.columns
    assert toxicity.score(docs, toxicity.fit(docs.limit(0), labels)).count() == 5
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_classifier_sees_words_that_go_along_with_the_terms(spark):
    """Of two insults that are no voters, the one that stands beside voters counts."""
    rnd, rows = random.Random(17), []
    for i in range(6000):
        words = [f"w{rnd.randrange(900)}" for _ in range(40)]
        if i % 8 == 0:
            words[5:7] = [rnd.choice(["idiot", "moron", "scum"]), "zorgling"]
        elif i % 8 == 1:
            words[5] = "plimming"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "if(doc_id % 8 = 0, 1, 0) AS toxic").where("doc_id < 3000")
    model = toxicity.fit(docs, labels, mined=0)
    assert model.terms == tuple(("word", s.encode()) for s in toxicity.SEEDS)
    texts = [" ".join([f"w{k}" for k in range(40)] + [x]) for x in ("zorgling", "plimming", "w77")]
    bad, other, plain = toxicity.Scorer(model).scores([t.encode() for t in texts])
    odds = lambda p: np.log(p / (1 - p))
    assert odds(bad) - max(odds(other), odds(plain)) > 0.6
    short = toxicity.Scorer(model).scores([b"zorgling w3", b"plimming w3", b"w7 w3"])  # among fewer words a word weighs more
    assert odds(short[0]) - max(odds(short[1]), odds(short[2])) > 1.2


def test_scores_agree_in_any_batch(spark, sf):
    docs = base.table(spark, sf, "documents")
    model = toxicity.fit(docs, base.table(spark, sf, "labels"))
    one = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    scorer = toxicity.Scorer(model)
    assert all(scorer.scores([r.text.encode()])[0] == one[r.doc_id] for r in docs.limit(50).collect())
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {d for d, s in one.items() if s < toxicity.THRESHOLD}


def test_label_model_finds_accuracies():
    rnd = np.random.default_rng(4)
    y = np.where(rnd.random(40000) < 0.5, 1, -1)
    accuracy = np.array([0.9, 0.8, 0.7, 0.6])
    votes = np.where(rnd.random((40000, 4)) < accuracy, 1, -1) * y[:, None] * (rnd.random((40000, 4)) < 0.7)
    copied = np.column_stack([votes, votes[:, 0]]).astype(float)
    a, dependence = toxicity.label_model(np.abs(copied).T @ np.abs(copied), copied.T @ copied)
    assert np.abs(a[1:4] - (2 * accuracy[1:] - 1)).max() < 0.06
    assert dependence[0] > dependence[1:4].max()


# chat
def test_rotation(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", None), (1, 2, "ann", "bye"), (None, 0, None, "x"), (2, 0, "ann", "a"), (2, 0, "ann", "a")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS part", "'m' AS mask")
    out = {(r.conv_id, r.speaker): r for r in chat.rotate(turns).collect()}
    assert set(out) == {(1, "ann"), (1, "bob"), (None, ""), (2, "ann")} and out[2, "ann"].n_turns == 2
    bob = out[1, "bob"]
    assert bob.text == "<|user:ann|>\nhi<|end|>\n<|assistant|>\n<|end|>\n<|user:ann|>\nbye<|end|>\n"
    assert [bob.text[m.start : m.end] for m in bob.mask] == ["<|end|>"]
    assert [out[1, "ann"].text[m.start : m.end] for m in out[1, "ann"].mask] == ["hi<|end|>", "bye<|end|>"]
    assert chat.rotate(turns.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK_PARTS", 3)
    turns = spark.range(1000).selectExpr("if(id < 900, 7L, null) AS conv_id", "id AS turn", "concat('r', id % 3) AS role", "if(id = 5, '<|end|> <|user:r1|>', repeat('t', int(id % 17))) AS text")
    rows = chat.rotate(turns).orderBy("part").collect()
    whole = {r.speaker: r.text for r in chat.rotate(turns, 1000).where("conv_id = 7").collect()}
    marks = {r.speaker: r.mask for r in chat.rotate(turns, 1000).where("conv_id = 7").collect()}
    for speaker in ("r0", "r1", "r2"):
        out = [r for r in rows if r.speaker == speaker and r.conv_id == 7]
        assert len(out) == 15 and sum(r.n_turns for r in out) == 900
        assert "".join(r.text for r in out) == whole[speaker]
        assert all(whole[speaker][r.part_start :].startswith(r.text) for r in out) and out[0].part_start == 0
        assert [(m.start + r.part_start, m.end + r.part_start) for r in out for m in r.mask] == [(m.start, m.end) for m in marks[speaker]]
    assert {(r.part, r.part_start > 0) for r in rows if r.conv_id is None} == {(0, False), (1, True)}


# benchmark
def test_containment_equals_brute_force(spark):
    rnd = random.Random(6)
    items = [(i, " ".join(f"q{rnd.randrange(900)}" for _ in range(n))) for i, n in enumerate([1, 3, 5, 7, 12, 13, 20, 40, 80, 200] * 3)]
    items += [(900, None), (901, "?!"), (902, items[6][1])]
    docs = []
    for i in range(120):
        own = [f"d{rnd.randrange(5000)}" for _ in range(rnd.choice([3, 60, 700, 6000]))]
        if i % 2:
            item = rnd.choice(items[:30])[1].split()
            cut = max(1, int(len(item) * rnd.choice([1, 0.95, 0.85, 0.6])))
            at = rnd.randrange(len(own))
            own[at:at] = item[: cut // 2] + (own[:3] if i % 4 == 1 and cut > 60 else []) + item[cut // 2 : cut]
        docs.append((i, " ".join(own)))
    docs += [(500, None), (501, ""), (501, items[8][1].upper() + "!"), (None, items[8][1])]

    def shingles(t, n):
        w = [x.decode() for x in base.words((t or "").encode())]
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    want = []
    for i, t in items:
        n = min(5, len(base.words((t or "").encode())))
        own = shingles(t, n) if n else set()
        want += [(str(d), i, len(own), len(own & shingles(x, n))) for d, x in docs if own and len(own & shingles(x, n)) >= 0.8 * len(own)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for size in (decontaminate.BLOCK_BYTES, 2000):  # one block of items, and several
        got = [(str(r.doc_id), r.item_id, r.n_item, r.n_shared) for r in decontaminate.contaminated(d, b, block_bytes=size).collect()]
        assert sorted(got) == sorted(want)
    clean = {str(r.doc_id) for r in decontaminate.decontaminate(d, b).collect()}
    assert clean == ({str(x) for x, _ in docs} - {w[0] for w in want}) | {"None"}
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0
