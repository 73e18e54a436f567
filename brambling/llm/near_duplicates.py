"""MinHash near-duplicates by Order MinHash, verified by banded alignment.

A text is its sequence of five-word shingles. Two texts are similar by their distinct
shingles, in the order of their first places:

    similarity = aligned / (shingles of a + shingles of b - aligned) >= 0.8

where ``aligned`` is the longest common subsequence; it is at most the Jaccard similarity
of the shingle sets, and equal to it for texts edited in place. How often a line repeats
doesn't count.

For candidates each shingle is labelled with its occurrence number. For each of ``BANDS``
hash functions the sketch takes the ``SAMPLE`` smallest labelled shingles and keeps them
in text order; texts that agree on such a tuple are candidates. Unlike plain MinHash a
tuple is lost when passages change places, so agreement follows edit similarity. Texts in
which any shingle repeats have a second set of tuples, over the shingles labelled as first
occurrences alone, which are what the similarity is about: these meet each other and the
tuples of texts without repeats.

Two texts of similarity 0.8 agree in one band with a chance of 0.51, in none of 20 with
6e-7, whatever repeats in them. All pairs that meet in a bucket are compared or already in
one class. First members are compared with a representative, picked by hash in each
bucket, in the last round the member in most buckets (an original among its variants).
What stays separate is finished exactly: buckets of more than one class are dealt into
blocks by length and class, and each pair of blocks that may hold a link is one matrix
product of shared shingles, whose pairs of Jaccard similarity 0.8 are aligned. Only links
leave it. Its work grows with the square of the classes in a bucket. Candidates are
verified within the band of diagonals that a qualifying pair can't leave.

Exact copies meet first, by a hash of the text: only one of each goes on.

Defined results: a null text is an empty one; texts without words are equal only when
identical; under five words the whole text is one shingle; rows of one text (repeated
rows too) share a class; a class id is the smallest doc_id of the class; rows of null ids
are linked like all others, and a class of such rows alone has a null class id; an empty
table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .components import components
from .decontaminate import Hashes, grams

SHINGLE, THRESHOLD, BANDS, SAMPLE = 5, 0.8, 20, 3
ROUNDS = ((0, 6), (6, 20))  #: bands compared in each round
#: Members, and bytes of their sequences, in a block of a bucket.
BLOCK, BLOCK_BYTES, COLUMNS = 256, 1_000_000, 4096
_ODD = np.array([(0x9E3779B97F4A7C15 * (2 * k + 1) ^ (k * 0xD1342543DE82EF95)) % 2**64 | 1 for k in range(1, BANDS + 1)], np.uint64)


def shingles(data: bytes, hashes: Hashes) -> np.ndarray:
    w = base.words(data)
    ids = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    return grams(ids, min(SHINGLE, len(w))) if w else np.zeros(0, np.uint64)


def labelled(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of (shingle, its occurrence number), in text order, and the numbers."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    begins = np.concatenate([[True], t[1:] != t[:-1]])
    at = np.arange(len(s))
    number = np.empty(len(s), np.uint64)
    number[order] = (at - np.maximum.accumulate(np.where(begins, at, 0))).astype(np.uint64)
    h = (s ^ (number * np.uint64(0xA24BAED4963EE407))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(32)), number


def sketch(s: np.ndarray) -> list[int | None]:
    """One key for each band, and, where a shingle repeats, one more for each band, of the
    first occurrences, null where it is the same; none for a text without shingles."""
    if not len(s):
        return []
    g, number = labelled(s)
    keys = band_keys(g)
    if not number.any():
        return keys
    return keys + [None if a == b else b for a, b in zip(keys, band_keys(g[number == 0]))]


def band_keys(g: np.ndarray) -> list[int]:
    """Of each band the hash of the smallest labelled shingles in text order."""
    k = min(SAMPLE, len(g))
    keys = np.empty((BANDS, k), np.int64)
    step = max(1, 2_000_000 // len(g))  # bands at a time, for very long texts
    for at in range(0, BANDS, step):
        r = g[None, :] * _ODD[at : at + step, None]
        r ^= r >> np.uint64(29)
        keys[at : at + step] = np.argpartition(r, k - 1, axis=1)[:, :k] if len(g) > k else np.arange(k)
    keys.sort(axis=1)  # back into text order
    h = np.arange(BANDS, dtype=np.uint64) + np.uint64(k << 8)
    for j in range(k):
        h = (h * np.uint64(0x9E3779B97F4A7C15) + g[keys[:, j]]) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(31)
    return h.astype(np.int64).tolist()


def first_places(s: np.ndarray) -> bytes:
    """The distinct shingles in order of their first places, 32 bits of each."""
    _, first = np.unique(s, return_index=True)
    return (s[np.sort(first)] >> np.uint64(32)).astype("<u4").tobytes()


def similarity(a: bytes, b: bytes, threshold: float = THRESHOLD) -> float:
    """Of two ``first_places``; 0 as soon as it is sure to be below the threshold."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    n, m = len(x), len(y)
    if not n or not m or min(n, m) < threshold * max(n, m):
        return 0.0
    least = threshold / (1 + threshold) * (n + m)
    order = np.argsort(y, kind="stable")
    at = np.minimum(np.searchsorted(y, x, sorter=order), m - 1)
    place = order[at]
    here = np.flatnonzero(y[place] == x)
    place = place[here]
    # Beyond these diagonals more shingles stay unmatched than a qualifying pair has.
    near = np.abs(place - here) <= n + m - 2 * least + 1
    place = place[near]
    if len(place) < least:
        return 0.0
    if (np.diff(place) > 0).all():
        aligned = len(place)
    else:  # the longest increasing run of places is the best alignment
        tails: list[int] = []
        for p in place.tolist():
            k = bisect_left(tails, p)
            tails[k : k + 1] = [p]
        aligned = len(tails)
    return aligned / (n + m - aligned)


def sketches(rows: DataFrame) -> DataFrame:
    """doc_id, text hash and band keys of every row."""

    def run(batches):
        base.sole("near_duplicates")
        hashes = Hashes()
        for batch in batches:
            keys = [sketch(shingles(t, hashes)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "same", "keys"])

    return hashed(rows).mapInArrow(run, "doc_id long, same binary, keys array<long>")


def hashed(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("same"), "text")


def sequences(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """(id, seq, size) of the candidate texts (id, own, same), stored for all rounds. Of
    equal texts those of the smallest doc_id are read."""

    def run(batches):
        hashes = Hashes()
        for batch in batches:
            seq = [first_places(shingles(t, hashes)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(seq, pa.binary())], ["doc_id", "same", "seq"])

    own = base.by_ids(rows, base.stored(candidates.where("own IS NOT NULL").select("own").distinct(), "own"), "doc_id", "left_semi")
    if candidates.where("own IS NULL").head(1):
        own = own.union(rows.where("doc_id IS NULL"))
    found = hashed(own).mapInArrow(run, "doc_id long, same binary, seq binary").join(candidates, "same").where("doc_id <=> own")
    found = found.groupBy("same", "id").agg(F.first("seq").alias("seq"))  # dealt by the join already
    return base.stored(found.select("id", "seq", F.length("seq").alias("size")), "sequences")


def verified(pairs: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """pairs (a, b) -> (a, b, sim) of all of them."""
    one, two = seqs.select(F.col("id").alias("a"), F.col("seq").alias("seq_a")), seqs.select(F.col("id").alias("b"), F.col("seq").alias("seq_b"))

    def run(batches):
        for batch in batches:
            sims = [similarity(x, y, threshold) for x, y in zip(batch.column("seq_a").to_pylist(), batch.column("seq_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "sim"])

    both = pairs.join(one, "a").join(two, "b").select("a", "b", "seq_a", "seq_b")
    return both.mapInArrow(run, "a long, b long, sim double")


def with_class(entries: DataFrame, classes: DataFrame | None) -> DataFrame:
    if classes is None:
        return entries.withColumn("comp", F.col("id"))
    return entries.join(classes, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def star_pairs(entries: DataFrame, classes: DataFrame | None, shared: DataFrame | None = None) -> DataFrame:
    """entries (key, id) -> distinct (a, b): every member of a bucket with one of it, or,
    from the second round on, with one of another class where there is one. With
    ``shared`` (id, buckets) the first is the member in most buckets."""
    held = with_class(entries, classes)
    held = held.withColumn("buckets", F.lit(0)) if shared is None else held.join(shared, "id")
    pick = F.struct((-F.col("buckets")).alias("few"), F.xxhash64("id", "key").alias("r"), "id", "comp")
    heads = held.groupBy("key").agg(F.min(pick).alias("head"), F.max(F.struct(F.xxhash64("comp", "key").alias("r"), "id", "comp")).alias("other"), F.count("*").alias("n"))
    # Stored, so that both sides of the join are dealt anew and a hot bucket can be split.
    heads = base.stored(heads.where("n > 1").select("key", "head", "other"), "heads")
    met = base.stored(held, "held").join(heads, "key")
    one = met.select("id", F.col("head.id").alias("rep"), "comp", F.col("head.comp").alias("to"))
    if classes is not None:
        two = met.where("comp <> other.comp AND head.comp <> other.comp").select("id", F.col("other.id").alias("rep"), "comp", F.col("other.comp").alias("to"))
        one = one.union(two)
    return one.where("id <> rep AND comp <> to").select(F.least("id", "rep").alias("a"), F.greatest("id", "rep").alias("b")).distinct()


def open_members(entries: DataFrame, classes: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(key, id, comp, size, band) of the buckets with members of several classes. Two
    members have compared each other in the rounds, and of equal buckets one is enough.
    Texts whose length bands aren't the same or next to each other can't be similar."""
    held = base.stored(with_class(entries, classes), "held")
    marks = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"mark{k}") for k in (1, 2)]
    several = held.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), *marks)
    several = several.where("n > 2 AND low <> high").groupBy("n", "low", "high", "mark1", "mark2").agg(F.min("key").alias("key"))
    own = held.join(base.stored(several.select("key"), "open"), "key").join(seqs.select("id", "size"), "id")
    step = -1.0001 * float(np.log(threshold))
    return base.stored(own.withColumn("band", F.floor(F.log("size") / step).cast("int")), "open")


def block_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """members -> (key, band, pool, no, id, comp), each in its block, and the pairs of
    blocks (pair, key, a, b) that may hold a link. A large class has blocks of its own,
    which aren't compared with each other; small classes share a pool."""
    per = members.groupBy("key", "band", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    per = base.stored(per.withColumn("pool", F.when(F.col("n") > BLOCK, F.col("comp").cast("string")).otherwise("")), "classes")
    pools = per.groupBy("key", "band", "pool").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    pools = base.stored(pools.select("key", "band", "pool", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).alias("blocks")), "pools")
    of = per.select("key", "band", "comp", "pool").join(pools, ["key", "band", "pool"])
    placed = members.join(base.stored(of, "pools"), ["key", "band", "comp"])
    placed = placed.select("key", "band", "pool", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("no"), "id", "comp")
    blocks = pools.select("key", "band", "pool", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("no")).select("key", F.struct("band", "pool", "no").alias("b"))
    both = blocks.withColumnRenamed("b", "a").join(blocks, "key").where("a <= b AND b.band <= a.band + 1 AND (a.pool <> b.pool OR a.pool = '')")
    return placed, base.stored(both.withColumn("pair", F.monotonically_increasing_id()), "blocks")


def block_links(first: list[tuple], second: list[tuple] | None, threshold: float) -> list[tuple[int, int]]:
    """Links between classes among (id, comp, seq) of one block, or between two; those
    within what is already linked here are left out."""
    others = first if second is None else second
    all_of = first if second is None else first + second
    if len({r[1] for r in all_of}) < 2:
        return []
    seqs = [np.unique(np.frombuffer(r[2], "<u4")) for r in all_of]
    owner = np.repeat(np.arange(len(seqs)), [len(s) for s in seqs])
    _, column, count = np.unique(np.concatenate(seqs), return_inverse=True, return_counts=True)
    often = count > 1  # the others add to no intersection
    held = often[column]
    owner, column = owner[held], (np.cumsum(often) - 1)[column[held]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    at = 0 if second is None else len(first)
    met = np.zeros((len(first), len(others)), np.float32)
    for low in range(0, int(often.sum()), COLUMNS):
        i, j = np.searchsorted(column, [low, low + COLUMNS])
        has = np.zeros((len(seqs), COLUMNS), np.float32)
        has[owner[i:j], column[i:j] - low] = 1
        met += has[: len(first)] @ has[at:].T
    sizes = np.array([len(r[2]) // 4 for r in all_of])
    comps = np.array([r[1] for r in all_of], np.int64)
    fits = met >= threshold * (sizes[: len(first), None] + sizes[None, at:] - met) - 1e-3
    fits &= comps[: len(first), None] != comps[None, at:]
    if second is None:
        fits = np.triu(fits, 1)
    parent: dict[int, int] = {}

    def find(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(fits))):
        (a, comp, x), (b, to, y) = first[i], others[j]
        if find(comp) != find(to) and similarity(x, y, threshold) >= threshold:
            parent[find(comp)] = find(to)
            links.append((min(a, b), max(a, b)))
    return links


def finished(entries: DataFrame, classes: DataFrame, seqs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join all classes which have one in any bucket."""
    placed, pairs = block_pairs(open_members(entries, classes, seqs, threshold))
    sides = pairs.select("pair", F.lit(0).alias("side"), "key", "a.*").union(pairs.where("a <> b").select("pair", F.lit(1), "key", "b.*"))
    sent = sides.join(placed, ["key", "band", "pool", "no"]).select("pair", "side", "id", "comp").join(seqs.select("id", "seq"), "id")

    def run(batches):
        now, held = None, ([], [])
        for batch in batches:
            links = []
            for pair, side, *row in zip(*(batch.column(c).to_pylist() for c in ("pair", "side", "id", "comp", "seq"))):
                if pair != now:
                    links += block_links(held[0], held[1] or None, threshold)
                    now, held = pair, ([], [])
                held[side].append(tuple(row))
            yield arrow_links(links)
        yield arrow_links(block_links(held[0], held[1] or None, threshold))

    return sent.repartition("pair").sortWithinPartitions("pair", "side").mapInArrow(run, "a long, b long")


def arrow_links(links: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])


def grouped(docs: DataFrame, threshold: float, id_col: str, text_col: str) -> DataFrame:
    """doc_id, same (a hash of the text), class_id, head: one row for each row of docs,
    stored. The text of a class's smallest doc_id is its head, on the rows of that id."""
    spark = docs.sparkSession
    base.arrow_limits(spark)
    with base.scratch(spark):
        rows = base.texts(docs, id_col, text_col)
        all_rows = base.stored(sketches(rows), "sketches")
        texts = all_rows.groupBy("same").agg(F.min("doc_id").alias("own"), F.first("keys").alias("keys"))
        # Ids of texts: doc_ids may be null or stand for several texts.
        texts = base.stored(texts.withColumn("id", F.monotonically_increasing_id()), "distinct")
        linked = base.stored(texts.select("id", "own", "same").join(classes_of(rows, texts, threshold), "id"), "linked")
        first = F.min(F.struct(F.col("own").isNull().alias("nameless"), "own", "id")).alias("first")
        heads = base.stored(linked.groupBy("comp").agg(first), "heads").select("comp", "first.own", "first.id")
        linked = linked.join(heads.select("comp", F.col("own").alias("class_id"), F.col("id").alias("head")), "comp").select("id", "class_id", "head")
        texts = texts.select("id", "own", "same").join(base.stored(linked, "classes"), "id", "left")
        head = F.coalesce("head", "id") == F.col("id")
        texts = texts.select("same", "own", F.when(F.col("head").isNull(), F.col("own")).otherwise(F.col("class_id")).alias("class_id"), head.alias("head"))
        found = all_rows.select("doc_id", "same").join(base.stored(texts, "texts"), "same")
        return base.stored(found.select("doc_id", "same", "class_id", (F.col("head") & F.col("doc_id").eqNullSafe(F.col("own"))).alias("head")), "near-duplicates", keep=True)


def classes_of(rows: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(id, comp) of the distinct texts (id, own, same, keys) with a link."""
    entries = texts.select("id", F.posexplode("keys").alias("at", "key")).where("key IS NOT NULL")
    entries = entries.select("id", F.pmod("at", F.lit(BANDS)).alias("band"), "key")
    # Buckets of one text need no look.
    shared = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    entries = base.stored(entries.join(shared, "key", "left_semi"), "entries")
    candidates = base.stored(entries.groupBy("id").agg(F.count("*").alias("buckets")), "candidates")
    seqs = sequences(rows, base.stored(texts.select("id", "own", "same").join(candidates, "id", "left_semi"), "candidates"))
    edges, classes, tried = None, None, None
    for low, high in (*ROUNDS, (0, BANDS)):
        pairs = star_pairs(entries.where(f"band >= {low} AND band < {high}").select("key", "id"), classes, candidates if high - low == BANDS else None)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        found = base.stored(verified(pairs, seqs, threshold), "pairs")
        tried = found.select("a", "b") if tried is None else tried.union(found.select("a", "b"))
        good = found.where(F.col("sim") >= threshold).select("a", "b")
        edges = good if edges is None else edges.union(good)
        if classes is None or good.head(1):
            classes = components(edges)
    links = base.stored(finished(entries.select("key", "id"), classes, seqs, threshold), "links")
    return components(edges.union(links)) if links.head(1) else classes


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, class_id: one row for each row of docs."""
    return grouped(docs, threshold, id_col, text_col).select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each class one row, of its smallest id."""
    found = grouped(docs, threshold, id_col, text_col)
    per_id = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if("head").alias("heads"))
    per_id = base.stored(per_id.where("n <> heads OR n > 1 OR doc_id IS NULL"), "ids")
    dropped = base.stored(per_id.where("heads = 0 AND doc_id IS NOT NULL").select("doc_id"), "dropped")
    unsure = base.stored(per_id.where("heads > 0 AND doc_id IS NOT NULL").select("doc_id"), "unsure")
    kept, looked = base.by_ids(docs, dropped, id_col, "left_anti"), None
    if unsure.head(1):
        looked, kept = base.by_ids(docs, unsure, id_col, "left_semi"), base.by_ids(kept, unsure, id_col, "left_anti")
    if per_id.where("doc_id IS NULL").head(1):
        nameless = docs.where(F.col(id_col).isNull())
        looked, kept = nameless if looked is None else looked.unionByName(nameless), kept.where(F.col(id_col).isNotNull())
    if looked is None:
        return kept
    # Ids that are null or repeat don't tell rows apart: their texts do.
    id_, same, head = (base.free_name(docs, c) for c in ("__id", "__same", "__head"))
    heads = found.where("head").select(F.col("doc_id").alias(id_), F.col("same").alias(head)).distinct()
    own = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    looked = looked.withColumn(same, own)
    looked = looked.join(heads, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (F.col(same) == F.col(head)), "left_semi")
    return kept.unionByName(looked.dropDuplicates([id_col, same]).drop(same))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(base.table(spark, sf_dir, "documents"))
