"""Token ids in a content-addressed store.

Texts are encoded with a public byte-level BPE vocabulary, the end id is appended, and a
rolling hash over the last 16 ids cuts each document's stream into chunks, so that equal
passages give equal chunks wherever they stand. The store holds

* ``chunks``: key (SHA-256 of the payload), n_ids, payload (little-endian ids), each once;
* ``recipes``: in ascending doc_id order doc_id, start, n_tokens, the chunk keys and their
  Merkle root;
* ``manifest``: of each recipes partition its place, sizes and the Merkle root over its
  documents' roots; as part -1 the sums, and the root over the partitions' roots.

Reading back checks every chunk against its key, every document against its root and all
recipes against the manifest, so that none is missing, repeated or out of place; the
CRC of a document comes from those of its chunks, so payloads are never shuffled again.

Defined results: a null or empty text is the end id alone; null ids come first; rows of
one doc_id follow each other by root, and repeated rows share all chunks; an empty table
gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import base

END_ID = 2
#: Ids in a chunk: cut where the hash has zeros in MEAN - 1's bits, between these bounds.
LEAST, MEAN, MOST, WINDOW = 128, 512, 4096, 16
#: Entries of a worker's caches, each emptied when full.
CACHE, SEEN = 1_200_000, 200_000

#: White space besides blank and newline; in texts with any a slower look decides.
RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = re.compile(r"\s\s|^\s|\s\Z")
#: Visible ASCII characters besides letters and digits.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: What the byte-level pre-tokenizer's pattern comes to on visible ASCII.
ASCII_PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[!-/:-@\[-`{-~]+")


def odd(t: str) -> bool:
    """Whether white space isn't all single, between words; or a text holds the mark they are cut at."""
    if "  " in t or "\n\n" in t or "\n " in t or " \n" in t or "\0" in t or t[:1].isspace() or t[-1:].isspace():
        return True
    return any(c in t for c in RARE_SPACE) and ODD.search(t) is not None


def _byte_chars() -> dict[int, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible ones for
    themselves, all others in order from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + k for k, b in enumerate(hidden)}


BYTE_CHARS = _byte_chars()


class Shown(dict):
    """Characters to those that stand for their bytes."""

    def __missing__(self, char: str) -> str:
        shown = self[char] = char.encode().decode("latin-1").translate(BYTE_CHARS)
        return shown


class Pieces(dict):
    """Ids, as bytes, of texts between single blanks and newlines, found when first asked for."""

    def __init__(self, tokenizer, code: str, direct: bool):
        super().__init__()
        self.tokenizer, self.code, self.direct = tokenizer, code, direct
        self.tokenize, self.shown = tokenizer.model.tokenize, Shown()  # each look at .model makes an object

    def word(self, part: str) -> bytes:
        """Ids of what the pre-tokenizer leaves whole, from the model alone."""
        shown = part.replace(" ", "\u0120") if part.isascii() else "".join(map(self.shown.__getitem__, part))
        return array(self.code, [t.id for t in self.tokenize(shown)]).tobytes()

    def library(self, piece: str) -> bytes:
        return array(self.code, self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def __missing__(self, piece: str) -> bytes:
        head = piece.rstrip(SIGNS)
        if not self.direct or not piece:
            ids = self.library(piece)
        elif head.isalpha() or head[:1] == " " and head[1:].isalpha():  # signs after letters are a piece of their own
            ids = self.word(piece) if len(head) == len(piece) else self[head] + self[piece[len(head) :]]
        elif piece.isascii() and piece.isprintable():
            parts = ASCII_PARTS.findall(piece)
            ids = self.word(piece) if len(parts) == 1 else b"".join(map(self.__getitem__, parts))
        else:
            ids = self.library(piece)
        self[piece] = ids
        return ids


class Encoder:
    """Ids of whole texts as bytes. At single blanks and newlines the pre-tokenizer always
    cuts, so pieces between them are encoded once and kept; other texts, and those that
    hold an added token's string, go to the library as they are."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # A byte-level pre-tokenizer leaves words of letters whole: they go straight to the model.
        byte_level = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.known = Pieces(self.tokenizer, "H" if self.kind.itemsize == 2 else "I", byte_level)
        trial = [" word", "Straße", " déjàvu", " it's", "(a1,", " 'tis_", "we'll.", " x=3.5%"]
        self.known.direct = byte_level and [self.known[w] for w in trial] == self.bytes_of(trial)
        self.known.clear()

    def bytes_of(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.kind).tobytes() for e in done]

    def encode(self, texts: list[str]) -> list[bytes]:
        known, whole = self.known, [odd(t) or any(a in t for a in self.added) if t else False for t in texts]
        if len(known) > CACHE:
            known.clear()
        rest = iter(self.bytes_of([t for t, w in zip(texts, whole) if w]))
        ids = known.__getitem__
        return [next(rest) if w else b"".join(map(ids, t.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0"))) if t else b"" for t, w in zip(texts, whole)]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def rolling(ids: np.ndarray) -> np.ndarray:
    """At each place a hash of the last WINDOW ids (fewer at the start)."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    for k in (1, 2, 4, 8):  # windows of 2, 4, 8, 16
        longer = h.copy()
        longer[k:] += h[:-k] << np.uint64(k)
        h = longer
    return h


def cuts(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """Of each document the ends of its chunks. A cut depends on the document's ids alone."""
    if not len(ids):
        return [[] for _ in starts]
    marks = np.flatnonzero((rolling(ids) >> np.uint64(24)) & np.uint64(MEAN - 1) == 0) + 1
    first, last = np.searchsorted(marks, starts + LEAST), np.searchsorted(marks, ends)
    out = []
    for s, e, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        own = []
        for m in marks[i:j].tolist():
            while m - s > MOST:
                s += MOST
                own.append(s)
            if m - s >= LEAST and m < e:
                own.append(m)
                s = m
        while e - s > MOST:
            s += MOST
            own.append(s)
        own.append(e)
        out.append(own)
    return out


def key_of(payload: bytes) -> bytes:
    return hashlib.sha256(b"\0" + payload).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary tree; an odd node goes up as it is."""
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(leaves[::2], leaves[1::2])]
        leaves = pairs + leaves[len(leaves) // 2 * 2 :]
    return leaves[0] if leaves else hashlib.sha256(b"\0").digest()


class Merkle:
    """The root of ``merkle`` over leaves that come one by one; holds one node a level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.nodes and self.nodes[-1][0] == level:
            leaf = hashlib.sha256(b"\1" + self.nodes.pop()[1] + leaf).digest()
            level += 1
        self.nodes.append((level, leaf))

    def root(self) -> bytes:
        if not self.nodes:
            return merkle([])
        root = self.nodes[-1][1]
        for _, node in self.nodes[-2::-1]:
            root = hashlib.sha256(b"\1" + node + root).digest()
        return root


def joined_crc(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of joined pieces from (bytes, CRC-32) of each: as a CRC is affine in its
    start value, running zeros of a piece's length over it moves it on."""
    crc = 0
    for n, c in parts:
        zeros = bytes(n)
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ c
    return crc


ENCODED = "kind string, doc_id long, n long, keys array<binary>, root binary, payload binary"
ARROW = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.binary()]


def encode_documents(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: ``recipe`` for each document, ``chunk`` for each chunk that the
    task hasn't seen lately (root is its key)."""
    base.arrow_limits(docs.sparkSession)
    names = [f.split()[0] for f in ENCODED.split(", ")]

    def run(batches):
        base.sole("token_store", encoder.cache_clear)
        enc, seen = encoder(path), set()
        last = np.array([end_id], enc.kind).tobytes()
        for batch in base.uncollected(batches):
            streams = [b + last for b in enc.encode(batch.column(1).to_pylist())]
            ends = np.cumsum([len(s) // enc.kind.itemsize for s in streams], dtype=np.int64)
            joined = b"".join(streams)
            ids = np.frombuffer(joined, enc.kind)
            starts = np.concatenate([[0], ends[:-1]]) if len(streams) else ends
            rows, w = [], enc.kind.itemsize
            for d, s, own in zip(batch.column(0).to_pylist(), starts.tolist(), cuts(ids, starts, ends)):
                keys, at = [], s
                for e in own:
                    payload = joined[at * w : e * w]
                    key = key_of(payload)
                    keys.append(key)
                    if key not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(key)
                        rows.append(("chunk", None, e - at, None, key, payload))
                    at = e
                rows.append(("recipe", d, at - s, keys, merkle(keys), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, ARROW)], names)

    return base.texts(docs, id_col, text_col).mapInArrow(run, ENCODED)


MANIFEST = "part int, offset long, n_docs long, n_ids long, root binary"
WHOLE = -1  #: the part that stands for all


def manifest_rows(parts: list[tuple]) -> list[tuple]:
    """(part, n_docs, n_ids, root) in order of part -> rows of the manifest."""
    rows, docs, at = [], 0, 0
    for part, n_docs, n_ids, root in parts:
        rows.append((part, at, n_docs, n_ids, bytes(root)))
        docs, at = docs + n_docs, at + n_ids
    return [*rows, (WHOLE, 0, docs, at, merkle([r[4] for r in rows]))]


def ordered(recipes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """recipes with ``start`` in ascending doc_id order, and the manifest. A partition
    numbers its own ids and ends with a row of its sums and root; the sums shift it."""
    spark = recipes.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("root").asc()]
    names = ["doc_id", "part", "local", "n_tokens", "keys", "root", "n_docs"]

    def run(batches):
        from pyspark import TaskContext

        part, at, docs, tree = TaskContext.get().partitionId(), 0, 0, Merkle()
        for batch in batches:
            counts = np.array(batch.column("n_tokens").to_pylist(), np.int64)
            ends = at + np.cumsum(counts)
            local = pa.array(ends - counts, pa.int64())
            at, docs = int(ends[-1]) if len(ends) else at, docs + len(ends)
            for root in batch.column("root").to_pylist():
                tree.add(root)
            columns = [batch.column("doc_id"), pa.array([part] * len(counts), pa.int32()), local, *(batch.column(c) for c in ("n_tokens", "keys", "root"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(counts), pa.int64())], names)
        if docs:
            sums = [(None, pa.int64()), (part, pa.int32()), (None, pa.int64()), (at, pa.int64()), (None, pa.list_(pa.binary())), (tree.root(), pa.binary()), (docs, pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in sums], names)

    placed = base.stored(
        recipes.repartitionByRange(n, *order).sortWithinPartitions(*order)
        .mapInArrow(run, "doc_id long, part int, local long, n_tokens long, keys array<binary>, root binary, n_docs long"),
        "ordered",
    )
    sums = placed.where("n_docs IS NOT NULL").select("part", "n_docs", "n_tokens", "root").orderBy("part").collect()
    parts = spark.createDataFrame(manifest_rows([tuple(r) for r in sums]), MANIFEST)
    out = placed.where("n_docs IS NULL").join(F.broadcast(parts.select("part", "offset")), "part")
    return out.select("doc_id", (F.col("offset") + F.col("local")).alias("start"), "n_tokens", "keys", "root"), parts


def write_store(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, end_id: int = END_ID,
                id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode, cut and write; returns the store's folder."""
    import public_tokenizers

    spark = docs.sparkSession
    path = path or base.shared_path(spark, "tokens")
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    staged = f"{path}/staged"
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "2")  # both kinds at once, without a sort of the payloads
    encode_documents(docs, vocabulary, end_id, id_col, text_col).write.option("compression", "zstd").partitionBy("kind").parquet(staged)
    spark.conf.unset("spark.sql.maxConcurrentOutputFileWriters")
    schema = ", ".join(ENCODED.split(", ")[1:])
    rows = spark.read.schema(schema + ", kind string").parquet(staged)
    chunks = rows.where("kind = 'chunk'").groupBy(F.col("root").alias("key")).agg(F.first("n").alias("n_ids"), F.first("payload").alias("payload"))
    chunks.write.option("compression", "zstd").parquet(f"{path}/chunks")
    recipes, manifest = ordered(rows.where("kind = 'recipe'").select("doc_id", F.col("n").alias("n_tokens"), "keys", "root"))
    recipes.write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest.coalesce(1).write.parquet(f"{path}/manifest")
    base.delete(spark, rows)
    return path


RECIPES = "doc_id long, start long, n_tokens long, keys array<binary>, root binary"
CHUNKS = "key binary, n_ids long, payload binary"


def chunk_facts(chunks: DataFrame, width: int = 2) -> DataFrame:
    """(key, n_ids, crc) of every stored chunk, read and checked against its key. The CRC
    is over the ids as little-endian 32-bit integers."""

    def run(batches):
        for batch in batches:
            keys, payloads = batch.column("key").to_pylist(), batch.column("payload").to_pylist()
            for key, payload in zip(keys, payloads):
                if key_of(payload) != key:
                    raise ValueError(f"chunk {key.hex()} doesn't hold what its key says")
            sizes = np.fromiter(map(len, payloads), np.int64, len(payloads)) // width
            wide = memoryview(np.frombuffer(b"".join(payloads), f"<u{width}").astype("<u4").tobytes())
            ends = (4 * np.cumsum(sizes)).tolist()
            crcs = [zlib.crc32(wide[s:e]) for s, e in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(sizes), pa.array(crcs, pa.int64())], ["key", "n_ids", "crc"])

    return chunks.select("key", "payload").mapInArrow(run, "key binary, n_ids long, crc long")


def check_manifest(spark: SparkSession, path: str, recipes: DataFrame) -> None:
    """Raises if the recipes aren't those of the manifest: of each partition the places,
    sizes and root are computed again from ``start`` order, and the root over all."""
    said = sorted(tuple(r) for r in spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect())
    parts = [r for r in said if r[0] != WHOLE]
    if sorted(manifest_rows([(part, n_docs, n_ids, root) for part, _, n_docs, n_ids, root in parts])) != [(*r[:4], bytes(r[4])) for r in said]:
        raise ValueError("the manifest's partitions don't fit its sums")
    offsets = [r[1] for r in parts]

    def place(batches):
        for batch in batches:
            starts = batch.column("start").to_numpy()
            part = np.searchsorted(offsets, starts, side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.columns], ["at", "start", "n_tokens", "root"])

    def run(batches):
        now, next_start, docs, whole, tree, rows = None, 0, 0, True, Merkle(), []
        for batch in batches:
            for at, start, n, root in zip(*(batch.column(c).to_pylist() for c in ("at", "start", "n_tokens", "root"))):
                if at != now:
                    if docs:
                        rows.append((now, docs, next_start, tree.root(), whole))
                    now, next_start, docs, whole, tree = at, offsets[at] if at >= 0 else 0, 0, True, Merkle()
                whole &= start == next_start
                next_start, docs = start + n, docs + 1
                tree.add(root)
        if docs:
            rows.append((now, docs, next_start, tree.root(), whole))
        types = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["at", "n_docs", "end", "root", "whole"])

    own = recipes.select("start", "n_tokens", "root").mapInArrow(place, "at int, start long, n_tokens long, root binary")
    own = own.repartitionById(max(1, len(parts)), F.greatest("at", F.lit(0))).sortWithinPartitions("at", "start").mapInArrow(run, "at int, n_docs long, end long, root binary, whole boolean")
    got = {r.at: (r.n_docs, r.end, bytes(r.root), r.whole) for r in own.collect()}
    want = {k: (n_docs, offset + n_ids, bytes(root), True) for k, (_, offset, n_docs, n_ids, root) in enumerate(parts)}
    if wrong := sorted(k for k in got.keys() | want.keys() if got.get(k) != want.get(k)):
        raise ValueError(f"the recipes of {len(wrong)} of {len(parts)} partitions aren't those of the manifest")


def verify_store(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks of every document, from what is stored.
    Fails on a chunk, recipe or root that doesn't fit, at once on recipes that aren't
    those of the manifest. ``width``: bytes of a stored id."""
    base.arrow_limits(spark)
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    check_manifest(spark, path, recipes)
    facts = chunk_facts(spark.read.schema(CHUNKS).parquet(f"{path}/chunks"), width)
    entries = recipes.select("doc_id", "start", "n_tokens", "root", F.size("keys").alias("n_keys"), F.posexplode("keys").alias("pos", "key"))
    found = entries.join(facts, "key", "left")  # start tells rows apart: each has an id at least
    lists = found.groupBy("start").agg(
        *(F.first(c).alias(c) for c in ("doc_id", "n_tokens", "root", "n_keys")), F.array_sort(F.collect_list(F.struct("pos", "key", "n_ids", "crc"))).alias("parts")
    )

    def run(batches):
        for batch in batches:
            crcs = []
            starts, sizes, roots, counts = (batch.column(c).to_pylist() for c in ("start", "n_tokens", "root", "n_keys"))
            parts = batch.column("parts")
            ends = np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            flat = parts.flatten()  # column by column: a dict for each chunk takes far longer
            keys, n_ids, own_crcs = (flat.field(c).to_pylist() for c in ("key", "n_ids", "crc"))
            for start, n, root, count, i, j in zip(starts, sizes, roots, counts, [0, *ends], ends):
                if j - i != count or None in n_ids[i:j] or merkle(keys[i:j]) != root or sum(n_ids[i:j]) != n:
                    raise ValueError(f"the document at {start} can't be put together from its recipe")
                crcs.append(joined_crc([(4 * k, c) for k, c in zip(n_ids[i:j], own_crcs[i:j])]))
            columns = [*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64()), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "n_chunks"])

    return lists.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long")


def read_documents(spark: SparkSession, path: str, width: int = 2) -> DataFrame:
    """doc_id, start, ids (array of int): the documents put together again."""
    recipes = spark.read.schema(RECIPES).parquet(f"{path}/recipes")
    chunks = spark.read.schema(CHUNKS).parquet(f"{path}/chunks").select("key", "payload")
    entries = recipes.select("doc_id", "start", F.posexplode("keys").alias("pos", "key")).join(chunks, "key")
    whole = entries.groupBy("start").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "payload"))).alias("parts"))

    def run(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["payload"] for p in own), f"<u{width}").astype(np.int32) for own in batch.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "start", "ids"])

    return whole.mapInArrow(run, "doc_id long, start long, ids array<int>")


def op2_token_store(spark, sf_dir: str) -> DataFrame:
    return verify_store(spark, write_store(base.table(spark, sf_dir, "documents")))
