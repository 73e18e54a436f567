"""Benchmark decontamination by size-partitioned MinHash containment search.

A short item inside a long document has a tiny Jaccard similarity, so one sketch length
can't serve all documents. Documents are partitioned by their number of shingles, in
powers of two; a partition's sketch has so many bins (``BINS`` times its upper size
bound) that a shingle is its bin's minimum with a chance of about 0.9 whatever the size.
Items are sketched for each partition with the same bins. A document is a candidate for
an item when any of their minima are equal, and is verified by exact containment: the
share of the item's distinct five-word shingles that the document holds anywhere.

Recall of the candidates: an item of q shingles held to 0.8 is missed with a chance of
about 0.1 to the power of 0.8 q; items of fewer than ``FEW`` shingles (or words than a
shingle) are compared with all shingles of a document instead, which misses none.

Items are few against documents; they are collected and broadcast in blocks of at most
``BLOCK_BYTES`` of text (one pass over the documents each), so no side's size is assumed.

Defined results: null or empty texts match nothing; an item of fewer than five words is
one shingle of all its words; repeated rows give repeated results; words are those of
``base.words`` (case and punctuation don't count); extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

SHINGLE, THRESHOLD, BINS, FEW, BLOCK_BYTES, CACHE = 5, 0.8, 4, 8, 32_000_000, 100_000
SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


class Hashes(dict):
    """Word to 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each n words in a row."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    h = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k]
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def size_class(n: int) -> int:
    """Bits of the bin number of a document with n shingles."""
    return max(1, int(n - 1).bit_length()) + BINS.bit_length() - 1


def minima(h: np.ndarray, bits: int) -> np.ndarray:
    """The smallest hash of each bin; h: sorted."""
    if not len(h):
        return h
    bins = h >> np.uint64(64 - bits)
    return h[np.concatenate([[True], bins[1:] != bins[:-1]])]


class Items:
    """Sketches of the items for every size class, made when first asked for."""

    def __init__(self, rows: list[tuple[int, str]]):
        hashes = Hashes()
        self.ids, self.shingles, self.size = [], [], []
        for item, text in rows:
            w = base.words((text or "").encode())
            if w:
                n = min(SHINGLE, len(w))
                self.ids.append(item)
                self.size.append(n)
                self.shingles.append(np.unique(grams(np.array([hashes[x] for x in w], np.uint64), n)))
        self.few = {n: self.postings([k for k, s in enumerate(self.shingles) if self.size[k] == n and (n < SHINGLE or len(s) < FEW)]) for n in set(self.size)}
        self.many = [k for k, s in enumerate(self.shingles) if self.size[k] == SHINGLE and len(s) >= FEW]
        self.classes: dict[int, tuple] = {}

    def postings(self, items: list[int], bits: int | None = None):
        """(mask over the top 16 bits, hash to items)."""
        mask, lists = np.zeros(65536, bool), defaultdict(list)
        for k in items:
            own = self.shingles[k] if bits is None else minima(self.shingles[k], bits)
            mask[(own >> np.uint64(48)).astype(np.int64)] = True
            for h in own.tolist():
                lists[h].append(k)
        return mask, lists

    def of_class(self, bits: int):
        if bits not in self.classes:
            self.classes[bits] = self.postings(self.many, bits)
        return self.classes[bits]

    @staticmethod
    def look_up(postings, h: np.ndarray, out: set[int]) -> None:
        mask, lists = postings
        if lists:
            for x in h[mask[(h >> np.uint64(48)).astype(np.int64)]].tolist():
                out.update(lists.get(x, ()))

    def matches(self, words: np.ndarray, threshold: float) -> list[tuple[int, int, int, float]]:
        """(item_id, n_item, n_shared, containment)."""
        held = {SHINGLE: np.sort(grams(words, SHINGLE))}
        found: set[int] = set()
        if len(held[SHINGLE]):
            bits = size_class(len(held[SHINGLE]))
            self.look_up(self.of_class(bits), minima(held[SHINGLE], bits), found)
        for n, postings in self.few.items():
            if postings[1]:
                held.setdefault(n, np.sort(grams(words, n)))
                self.look_up(postings, held[n], found)
        out = []
        for k in sorted(found):
            own, h = self.shingles[k], held[self.size[k]]
            shared = int((h[np.minimum(np.searchsorted(h, own), len(h) - 1)] == own).sum())
            if shared >= threshold * len(own):
                out.append((self.ids[k], len(own), shared, shared / len(own)))
        return out


_LAST: dict[str, Items] = {}


def items_of(name: str, sent) -> Items:
    """The sketches of a block of items, made once in each worker; the last block is kept."""
    if name not in _LAST:
        _LAST.clear()
        _LAST[name] = Items(sent.value)
    return _LAST[name]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_item, n_shared, containment."""
    spark = docs.sparkSession
    base.arrow_limits(spark)
    items = base.texts(benchmark, item_col, item_text_col)
    total = items.agg(F.sum(F.length("text") + 16)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    rows = base.texts(docs, id_col, text_col)
    out = None
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)) == block).collect()
        sent, name = spark.sparkContext.broadcast([tuple(r) for r in own]), uuid.uuid4().hex

        def run(batches, sent=sent, name=name):
            base.sole("decontaminate", _LAST.clear)
            index, hashes = items_of(name, sent), Hashes()
            for batch in batches:
                found = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    w = base.words(t)
                    found += [(d, *m) for m in index.matches(np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w)), threshold)]
                kinds = [pa.int64()] * 4 + [pa.float64()]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [[]] * 5, kinds)], names)

        part = rows.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that hold no item. Rows of a null id can't be told apart and stay."""
    hit = base.stored(contaminated(docs, benchmark, threshold, id_col=id_col, text_col=text_col).select("doc_id").distinct(), "contaminated")
    return base.by_ids(docs, hit, id_col, "left_anti")


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(base.table(spark, sf_dir, "documents"), base.table(spark, sf_dir, "benchmark"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = {
    "op10_decontamination": rf"""
WITH i AS (SELECT item_id, row_number() OVER () AS r, {_WORDS} AS w FROM benchmark),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS w FROM documents),
si AS (SELECT DISTINCT r, item_id, least(5, len(w)) AS n, unnest(list_transform(generate_series(1, len(w) - least(5, len(w)) + 1), lambda k: array_to_string(w[k:k + least(5, len(w)) - 1], ' '))) AS s FROM i WHERE len(w) > 0),
sizes AS (SELECT r, item_id, n, count(*) AS q FROM si GROUP BY ALL),
sd AS (SELECT DISTINCT r, doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS s
       FROM d, (SELECT DISTINCT n FROM si) WHERE len(w) >= n),
hits AS (SELECT sd.r AS dr, sd.doc_id, si.r AS ir, count(*) AS shared FROM sd JOIN si ON sd.n = si.n AND sd.s = si.s GROUP BY ALL)
SELECT doc_id, item_id, q AS n_item, shared AS n_shared, shared::DOUBLE / q AS containment
FROM hits JOIN sizes ON hits.ir = sizes.r WHERE shared >= 0.8e0 * q
"""
}
