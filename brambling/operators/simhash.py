"""SimHash near-duplicates of token tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from brambling.config import DuplicateSettings
from brambling.functions import bits as B
from brambling.session import shared_path

#: Hashes of a block, of its rows compared at once, and pairs given at once.
BLOCK, STRIP, ROWS = 8192, 128, 65536
#: Columns of an inverted block.
HELD = ["block", "term", "cf", "held", "ids"]
#: Partitions of block pairs at most.
PARTS = 4096


def term_frequencies(corpus_: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """term, cf: of this corpus, added to an earlier table."""
    counts = corpus_.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("cf"))
    return counts if before is None else counts.unionByName(before).groupBy("term").agg(F.sum("cf").alias("cf"))


def term_weights(frequencies: DataFrame) -> DataFrame:
    """term, weight: the largest frequency over the term's own, as an integer."""
    most = frequencies.agg(F.max("cf")).scalar()
    return frequencies.select("term", F.floor(most / F.col("cf")).cast("long").alias("weight"))


def _weighed(w, h):
    """Rows of weights and hashes as sums: of the weight for each bit that is set, then of all."""
    bits = np.unpackbits(np.ascontiguousarray(h, "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.hstack([bits * w[:, None], w[:, None]])


def _signed(sums_of):
    """doc_id and columns of which sums are made, in the order of doc_id -> doc_id, simhash.
    A document that goes on in the next batch is carried there."""

    def rows(ids, sums):
        # What the set bits weigh against what the others do.
        words = np.packbits(2 * sums[:, :-1] > sums[:, -1:], axis=1, bitorder="little").view("<i8").ravel()
        return pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64())], ["doc_id", "simhash"])

    def run(batches):
        kept, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, *columns = batch.columns
            codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            sums = np.add.reduceat(sums_of(*columns), starts, axis=0)
            ids = ids.take(pa.array(starts))
            if held is not None:
                if kept[0].as_py() == ids[0].as_py():
                    sums[0] += held[0]
                else:
                    yield rows(kept, held)
            if len(ids) > 1:
                yield rows(ids[:-1], sums[:-1])
            kept, held = ids[-1:], sums[-1:]
        if held is not None:
            yield rows(kept, held)

    return run


def _halved(words: DataFrame) -> DataFrame:
    low = F.lit((1 << 32) - 1).cast("long")
    return words.select("doc_id", F.shiftrightunsigned("simhash", 32).alias("hi"), F.col("simhash").bitwiseAND(low).alias("lo"), "simhash")


def simhashes(postings_: DataFrame, weights: DataFrame) -> DataFrame:
    """doc_id, hi, lo, simhash: bit i is set if the signed weights of the terms, repeats
    counted, sum to more than 0. Terms are hashed where their weights are, once each; unknown
    terms weigh 1. The 64 sums of a document are made of arrays, as generated code of so
    many sums is too long to be compiled."""
    hashed = weights.withColumn("h", B.hash_word(F.col("term")))
    weight = (F.col("tf") * F.coalesce("weight", F.lit(1))).cast("long")
    weighed = postings_.join(hashed, "term", "left").select("doc_id", weight.alias("w"), F.coalesce("h", B.hash_word(F.col("term"))).alias("h"))
    ordered = weighed.repartition("doc_id").sortWithinPartitions("doc_id")
    schema = StructType([postings_.schema["doc_id"], StructField("simhash", LongType())])
    return _halved(ordered.mapInArrow(_signed(lambda w, h: _weighed(w.to_numpy(), h.to_numpy())), schema))


def _inverted(batches):
    """doc_id, tokens -> for each batch, a block, its ids (a row without term) and a row for each
    term: how often it comes, and (place of the document, tf) of all that hold it."""
    part = TaskContext.get().partitionId()
    for number, batch in enumerate(batches):
        block, ids, tokens = (part << 32) + number, batch.column(0), batch.column(1)
        if not len(ids):
            continue
        nothing = lambda t: pa.nulls(1, t)
        listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        yield pa.RecordBatch.from_arrays([pa.array([block]), nothing(pa.string()), pa.array([0]), nothing(pa.binary()), listed], HELD)
        coded = tokens.flatten().dictionary_encode()
        if not len(coded):
            continue
        docs = np.repeat(np.arange(len(ids)), pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
        keys, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(ids) + docs, return_counts=True)
        codes = keys // len(ids)
        starts = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
        payload = np.column_stack([keys % len(ids), tf]).astype("<i4")
        offsets = np.append(starts, len(keys)).astype(np.int32) * 8
        held = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(payload)])
        cf = pa.array(np.add.reduceat(tf, starts).astype(np.int64))
        columns = [pa.array(np.full(len(starts), block)), coded.dictionary.cast(pa.string()), cf, held, pa.nulls(len(starts), listed.type)]
        whole = pa.RecordBatch.from_arrays(columns, HELD)
        for at in range(0, whole.num_rows, ROWS):
            yield whole.slice(at, ROWS)


def _block_sums(batches):
    """block, ids, w, h, held in the order of blocks, ids first -> doc_id, its sums."""
    key, ids, sums, hit = None, None, None, None

    def ended():
        if ids is not None and hit.any():
            there = np.flatnonzero(hit)
            for at in range(0, len(there), STRIP * 16):
                some = there[at : at + STRIP * 16]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array([r.tobytes() for r in sums[some]], pa.binary())], ["doc_id", "sums"])

    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(blocks[1:] != blocks[:-1]) + 1, [len(blocks)]])
        for start, end in zip(cuts[:-1], cuts[1:]):
            part = batch.slice(start, end - start)
            if key != blocks[start]:
                yield from ended()
                key, ids = blocks[start], part.column(1)[0].values
                sums, hit = np.zeros((len(ids), B.BITS + 1), np.int64), np.zeros(len(ids), bool)
                part = part.slice(1)
            if not part.num_rows:
                continue
            w, h = (part.column(n).to_numpy(zero_copy_only=False) for n in (2, 3))
            lengths = pc.binary_length(part.column(4)).to_numpy() // 8
            held = np.frombuffer(b"".join(part.column(4).to_pylist()), "<i4").reshape(-1, 2)
            row, order = np.repeat(np.arange(len(w)), lengths), np.argsort(held[:, 0], kind="stable")
            for at in range(0, len(order), ROWS // 4):
                some = order[at : at + ROWS // 4]
                docs, rows = held[some, 0], row[some]
                first = np.concatenate([[0], np.flatnonzero(docs[1:] != docs[:-1]) + 1])
                sums[docs[first]] += np.add.reduceat(_weighed(w[rows].astype(np.int64) * held[some, 1], h[rows]), first, axis=0)
                hit[docs[first]] = True
    yield from ended()


def corpus_simhashes(corpus_: DataFrame) -> DataFrame:
    """``simhashes`` of a corpus by its own weights. Its texts are cut once: each block of
    documents is inverted, the blocks' terms are counted together and go back to their blocks
    with their weights, so what is shuffled is a row for each term of a block."""
    spark, path = corpus_.sparkSession, shared_path(corpus_.sparkSession, "inverted")
    kind = corpus_.schema["doc_id"].dataType
    schema = StructType([StructField("block", LongType()), StructField("term", StringType()), StructField("cf", LongType()), StructField("held", BinaryType()), StructField("ids", ArrayType(kind))])
    blocks = corpus_.select("doc_id", "tokens").mapInArrow(_inverted, schema)
    same = Window.partitionBy("term", F.when(F.col("term").isNull(), F.col("block")))
    blocks.withColumn("cf", F.sum("cf").over(same)).write.parquet(path)
    stored = spark.read.parquet(path)
    most = stored.agg(F.max("cf")).first()[0]
    weight = F.floor(F.lit(most) / F.greatest("cf", F.lit(1))).cast("long").alias("w")
    rows = stored.select("block", "ids", weight if most else F.lit(1).cast("long").alias("w"), B.hash_word(F.col("term")).alias("h"), "held")
    ordered = rows.repartition("block").sortWithinPartitions("block", F.col("ids").isNull())
    sums = ordered.mapInArrow(_block_sums, StructType([StructField("doc_id", kind), StructField("sums", BinaryType())]))
    # Rows of one id are one document, whatever their blocks.
    merged = sums.repartition("doc_id").sortWithinPartitions("doc_id")
    read = lambda c: np.frombuffer(b"".join(c.to_pylist()), np.int64).reshape(-1, B.BITS + 1)
    return _halved(merged.mapInArrow(_signed(read), StructType([StructField("doc_id", kind), StructField("simhash", LongType())])))


def most_bits(similarity: float) -> int:
    """Similarity at least s: at most so many bits differ."""
    return int((1 - similarity) * B.BITS + 1e-9)


def _compared(most: int):
    """Rows of two blocks, block pair by block pair (i, j, k: the row's block) -> the pairs
    of rows with at most so many bits between them."""

    def pairs(i, j, k, ids, hashes):
        left = np.flatnonzero(k == i)
        right = left if i == j else np.flatnonzero(k == j)
        for at in range(0, len(left), STRIP):
            strip = left[at : at + STRIP]
            bits = np.bitwise_count(hashes[strip][:, None] ^ hashes[right][None, :])
            near = bits <= most
            if i == j:  # each pair of a block's own rows once
                near &= right[None, :] > strip[:, None]
            x, y = np.nonzero(near)
            for of in range(0, len(x), ROWS):
                a, b = x[of : of + ROWS], y[of : of + ROWS]
                columns = [ids.take(pa.array(strip[a])), ids.take(pa.array(right[b])), pa.array(bits[a, b], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["x", "y", "distance"])

    def run(batches):
        key, parts = None, []

        def ended():
            if parts:
                table = pa.Table.from_batches(parts).combine_chunks()
                k, hashes = (table.column(n).to_numpy() for n in ("k", "simhash"))
                yield from pairs(*key, k, table.column("doc_id").combine_chunks(), hashes.view(np.uint64))

        for batch in batches:
            if not batch.num_rows:
                continue
            i, j = (batch.column(n).to_numpy() for n in ("i", "j"))
            starts = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1, [batch.num_rows]])
            for start, end in zip(starts[:-1], starts[1:]):
                if key != (i[start], j[start]):
                    yield from ended()
                    key, parts = (i[start], j[start]), []
                parts.append(batch.slice(start, end - start))
        yield from ended()

    return run


def pairs_of_all(hashes: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """a < b, distance: every pair is compared. The hashes are stored and dealt into blocks of
    about ``BLOCK`` rows; a task compares two blocks at a time, as arrays."""
    spark, path = hashes.sparkSession, shared_path(hashes.sparkSession, "simhashes")
    hashes.where("simhash IS NOT NULL").select("doc_id", "simhash").write.parquet(path)
    stored = spark.read.parquet(path)
    blocks = -(-stored.count() // BLOCK) or 1
    # A row of block k meets those of each block, its own among them.
    own = F.pmod(F.xxhash64("doc_id", "simhash"), F.lit(blocks)).cast("int")
    met = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("m")
    rows = stored.select("doc_id", "simhash", own.alias("k")).select("*", met)
    rows = rows.select(F.least("k", "m").alias("i"), F.greatest("k", "m").alias("j"), "k", "doc_id", "simhash")
    # As many partitions as block pairs: no task needs more than one of them to be near the others.
    dealt = rows.repartition(min(blocks * (blocks + 1) // 2, PARTS), "i", "j").sortWithinPartitions("i", "j")
    kind = stored.schema["doc_id"].dataType
    schema = StructType([StructField("x", kind), StructField("y", kind), StructField("distance", IntegerType())])
    found = dealt.mapInArrow(_compared(most_bits(settings.similarity)), schema)
    return found.where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def pairs_in_buckets(hashes: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    """Only pairs of equal hash prefixes: an equi-join, and by design misses pairs whose
    prefixes differ. Larger corpora take more ``prefix_bits``."""
    a = hashes.select(F.col("doc_id").alias("a"), F.col("simhash").alias("ha"))
    b = hashes.select(F.col("doc_id").alias("b"), F.col("simhash").alias("hb"))
    distance = B.hamming(F.col("ha"), F.col("hb"))
    same = B.prefix(F.col("ha"), settings.prefix_bits) == B.prefix(F.col("hb"), settings.prefix_bits)
    return a.join(b, same & (F.col("a") < F.col("b")) & (distance <= most_bits(settings.similarity))).select("a", "b", distance.cast("int").alias("distance"))


def duplicate_pairs(hashes: DataFrame, settings: DuplicateSettings = DuplicateSettings()) -> DataFrame:
    small = len(hashes.limit(settings.pairwise_limit).select(F.lit(1)).collect()) < settings.pairwise_limit
    return pairs_of_all(hashes, settings) if small else pairs_in_buckets(hashes, settings)


def drop_duplicates(hashes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Hashes of the documents without an earlier match (batch form: weights of the whole
    corpus; the one-by-one form is ``streaming.fold.sequential``)."""
    return hashes.join(pairs.select(F.col("b").alias("doc_id")).distinct(), "doc_id", "left_anti")


def is_duplicate(target: DataFrame, hashes: DataFrame, settings: DuplicateSettings = DuplicateSettings(), on_prefix: bool = False) -> DataFrame:
    """The targets (doc_id, simhash) that match any of hashes."""
    h = hashes.select(F.col("simhash").alias("__h"))
    near = B.hamming(F.col("simhash"), F.col("__h")) <= most_bits(settings.similarity)
    if on_prefix:
        near = near & (B.prefix(F.col("simhash"), settings.prefix_bits) == B.prefix(F.col("__h"), settings.prefix_bits))
    return target.join(h, near, "left_semi")
