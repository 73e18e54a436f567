"""Toxicity by weak supervision.

Voters: every term of a lexicon (a fixed list of insults, and words and word beginnings
mined from labelled training rows), three families of terms, and patterns over the terms
(several of them, dense, addressed to somebody). A voter says +1, -1 or abstains.

A generative label model takes the voters' pairwise agreements over all documents, one
aggregation with a bounded result, estimates each accuracy from triplets of voters, finds
correlated voters by what agreement the accuracies leave over, and lowers their weights.
Its posteriors are the labels of a linear classifier in two parts. The first sees hashed
words and word pairs of the text, none of the voters, and is fitted on one half of a
bounded sample of training rows, so that words that go along with the voters' terms count
without them; the second adds the votes, fitted on the other half against the first
part's margin on texts it hasn't seen. A two-parameter logistic curve, fitted on labelled
training rows of that half, turns the margin into the score.

Labels are learned only from rows whose crc32(doc_id as text) mod 4 is not 2. Labels,
language, source and id are never inputs of a score. Bounds: ``fit_rows`` labelled rows
for mining and for the curve, ``fit_rows`` training rows for the classifier, taken by the
smallest hash of their id; ``MINED`` terms, of the ``CANDIDATES`` of largest gain those that
explain rows without any other term. Rarer ones are seen as words by the classifier.

Defined results: a null or empty text has no terms and gets the score of such texts; equal
texts get equal scores; labels that are null are ignored, of several labels of one id the
largest holds; without labels of both classes the curve is left out and the prior is
``PRIOR``; extra columns are ignored (``drop_toxic`` keeps them).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base
from .decontaminate import Hashes, grams

#: Common English insults.
SEEDS = (
    "idiot", "idiots", "moron", "morons", "stupid", "loser", "losers", "scum", "trash", "clown", "clowns", "pathetic",
    "worthless", "disgusting", "dumb", "imbecile", "jerk", "creep", "vermin", "filth", "fool", "coward", "bastard",
)
PREFIXES = (4, 5, 6, 7, 8)  #: bytes of mined word beginnings
FIT_ROWS, MINED, PRECISION, GAIN, PRIOR, THRESHOLD, DENSE, CURVE = 20_000, 256, 0.95, 30.0, 0.1, 0.3, 0.004, 10.0
CANDIDATES, ADDED = 2048, 4.0  #: terms of largest gain that are looked at; gain by rows without other terms
BUCKET_BITS = 13  #: of the hashed words and pairs
EPOCHS, RATE, RIDGE, STEP_ROWS = 6, 0.5, 1e-4, 256  #: of the classifier's first part
PATTERNS = ("seeds", "words", "beginnings", "several", "dense", "addressed")
YOU = {b"you", b"your", b"youre", b"u"}


@dataclass(frozen=True)
class Model:
    """terms: ('word' or 'begin', bytes). words: weights of the buckets. weights: of the
    votes; the score is the logistic function of slope times (words . text + weights . votes
    + bias) + shift."""

    terms: tuple[tuple[str, bytes], ...]
    accuracies: np.ndarray
    dependence: np.ndarray
    weights: np.ndarray
    bias: float = 0.0
    words: np.ndarray | None = None
    slope: float = 1.0
    shift: float = 0.0


class Voters:
    def __init__(self, terms):
        self.n = len(terms)
        self.words = {t: i for i, (kind, t) in enumerate(terms) if kind == "word"}
        self.begin = {n: {t: i for i, (kind, t) in enumerate(terms) if kind == "begin" and len(t) == n} for n in PREFIXES}
        seeds = {s.encode() for s in SEEDS}
        self.seeds = {i for t, i in self.words.items() if t in seeds}
        self.whole = set(self.words.values())

    def hits(self, text: list[bytes]) -> set[int]:
        """The terms that a text holds."""
        own = set(text)
        found = {self.words[w] for w in self.words.keys() & own}
        for n, terms in self.begin.items():
            if terms:
                found |= {terms[p] for p in terms.keys() & {w[:n] for w in own}}
        return found

    def votes(self, text: list[bytes]) -> np.ndarray:
        """int8: one for each term, then PATTERNS. text: its words."""
        out = np.zeros(self.n + len(PATTERNS), np.int8)
        hits = self.hits(text)
        by_word, by_begin = hits & self.whole, hits - self.whole
        out[list(hits)] = 1
        none = 0 if hits else -1  # a family abstains on texts with terms of another
        sign = (1 if by_word & self.seeds else none, 1 if by_word - self.seeds else none, 1 if by_begin else none)
        out[self.n : self.n + 3] = sign
        if hits:
            at = [i for i, w in enumerate(text) if w in self.words or any(w[:n] in t for n, t in self.begin.items())]
            out[self.n + 3] = 1 if len(at) > 1 else 0
            out[self.n + 4] = 1 if len(at) >= DENSE * len(text) else 0
            out[self.n + 5] = 1 if any(not YOU.isdisjoint(text[max(0, i - 3) : i]) for i in at) else 0
        return out


def buckets(text: list[bytes], hashes: Hashes) -> np.ndarray:
    """The places of a text's words and word pairs among 2 ** BUCKET_BITS."""
    h = np.fromiter(map(hashes.__getitem__, text), np.uint64, len(text))
    return np.unique(np.concatenate([h, grams(h, 2)]) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def smallest(rows: DataFrame, n: int, *ties: str) -> DataFrame:
    """At most n rows, by the smallest hash of doc_id. A cut on the hash comes first, as the
    smallest n of each of many tasks would all go to the driver."""
    h = F.xxhash64("doc_id")
    return cut(rows, n).orderBy(h, "doc_id", *ties).limit(n)


def cut(rows: DataFrame, n: int) -> DataFrame:
    """About 1.2 n rows of the smallest hashes of doc_id."""
    total, most = rows.count(), 1.2 * n + 100
    return rows.where(F.xxhash64("doc_id") < F.lit(int(-(2**63) + 2**64 * (most / total)))) if total > most else rows


def labelled_ids(labels: DataFrame, fit_rows: int, id_col: str, label_col: str) -> DataFrame:
    own = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    own = own.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return base.stored(smallest(base.stored(own, "labels"), fit_rows), "labelled")


def mine(rows: DataFrame, labelled: DataFrame, mined: int) -> tuple[list[tuple[str, bytes]], float]:
    """Terms whose rows are labelled toxic far more often than others; and the share of
    toxic rows. Copies of a text count once."""
    own = rows.join(F.broadcast(labelled), "doc_id").groupBy(F.md5(F.col("text").cast("binary"))).agg(F.first("text").alias("text"), F.max("label").alias("label"))
    own = base.stored(own.select("text", "label"), "sample")
    pos, total = own.agg(F.sum("label"), F.count("*")).first()
    if not total or not pos or pos == total:
        return [], PRIOR

    def run(batches):
        base.sole("toxicity")
        for batch in batches:
            counts = (Counter(), Counter())
            for t, y in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("label").to_pylist()):
                words = set(base.words(t))
                counts[y > 0].update(("word", w) for w in words)
                for n in PREFIXES:
                    counts[y > 0].update(("begin", p) for p in {w[:n] for w in words if len(w) > n})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys]), pa.array([t for _, t in keys], pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())],
                ["kind", "term", "pos", "neg"],
            )

    counts = own.mapInArrow(run, "kind string, term binary, pos long, neg long").groupBy("kind", "term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    rate, n = pos / total, F.col("pos") + F.col("neg")
    # Likelihood ratio against the overall rate: of a million terms none should pass by chance.
    gain = 2 * (F.col("pos") * F.log(F.col("pos") / (n * rate)) + F.col("neg") * F.log((F.col("neg") + 1e-9) / (n * (1 - rate))))
    best = counts.where((F.col("pos") > 0) & (F.col("pos") >= PRECISION * n)).withColumn("gain", gain).where(F.col("gain") >= GAIN)
    order = (F.desc("gain"), F.desc("kind"), F.desc(F.length("term")), "term")
    top = [(r.kind, bytes(r.term)) for r in best.orderBy(*order).limit(CANDIDATES).collect()]
    return chosen(own, top, rate, mined), rate


def gain_of(pos: int, neg: int, rate: float) -> float:
    """As in ``mine``; 0 below the precision asked for."""
    n = pos + neg
    if not pos or pos < PRECISION * n:
        return 0.0
    return 2 * (pos * math.log(pos / (n * rate)) + (neg * math.log(neg / (n * (1 - rate))) if neg else 0.0))


def chosen(sample: DataFrame, terms: list[tuple[str, bytes]], rate: float, mined: int) -> list[tuple[str, bytes]]:
    """Terms, best first, that pass by the rows without any term before them alone: a word
    that stands in rows of a known term only, as in copies of one of them, says nothing new."""
    listed = [("word", s.encode()) for s in SEEDS] + terms

    def run(batches):
        voters = Voters(listed)
        for batch in batches:
            held = [voters.hits(base.words(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            rows = [(y, bit_set(np.fromiter(h, np.int64, len(h)), len(listed))) for y, h in zip(batch.column("label").to_pylist(), held) if h]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["label", "held"])

    rows = sample.mapInArrow(run, "label int, held binary").collect()
    if not rows:
        return []
    y = np.array([r.label > 0 for r in rows])
    held = np.unpackbits(np.frombuffer(b"".join(bytes(r.held) for r in rows), np.uint8).reshape(len(rows), -1), axis=1)[:, : len(listed)].astype(bool)
    open_, kept = ~held[:, : len(SEEDS)].any(axis=1), []
    for k in range(len(SEEDS), len(listed)):
        own = held[:, k] & open_
        if len(kept) < mined and gain_of(int((own & y).sum()), int((own & ~y).sum()), rate) >= ADDED:
            kept.append(listed[k])
            open_ &= ~held[:, k]
    return kept


def vote_table(rows: DataFrame, terms) -> DataFrame:
    """doc_id, votes and ``bits``, its buckets as a bit set, of every row."""
    size = 1 << BUCKET_BITS

    def run(batches):
        base.sole("toxicity")
        voters, hashes = Voters(terms), Hashes()
        for batch in base.uncollected(batches):
            texts = [base.words(t) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns = [pa.array([voters.votes(t).tobytes() for t in texts], pa.binary()), pa.array([bit_set(buckets(t, hashes), size) for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "votes", "bits"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, votes binary, bits binary")


def bit_set(places: np.ndarray, size: int) -> bytes:
    held = np.zeros(size, bool)
    held[places] = True
    return np.packbits(held).tobytes()


def moments(rows: DataFrame, terms) -> tuple[np.ndarray, np.ndarray]:
    """Of all rows, for each two voters: how often both vote, and the sum of their products.
    The votes are cast and summed in one pass: two in a row would take two workers a task,
    and executors keep as many as were ever at work at once."""
    m = len(terms) + len(PATTERNS)

    def run(batches):
        base.sole("toxicity")
        voters = Voters(terms)
        both, product = np.zeros((m, m), np.int64), np.zeros((m, m), np.int64)
        for batch in base.uncollected(batches):
            votes = [voters.votes(base.words(t)) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            v = np.array(votes, np.float64).reshape(-1, m)
            product += (v.T @ v).astype(np.int64)
            both += (np.abs(v).T @ np.abs(v)).astype(np.int64)
        i, j = np.nonzero(both)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (i, j, both[i, j], product[i, j])], ["i", "j", "n", "s"])

    out = (np.zeros((m, m)), np.zeros((m, m)))
    # m * m rows at most, m is bounded by the number of terms
    for r in rows.select("text").mapInArrow(run, "i long, j long, n long, s long").groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        out[0][r.i, r.j], out[1][r.i, r.j] = r.n, r.s
    return out


def label_model(both: np.ndarray, product: np.ndarray, least: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """(accuracies, dependence): accuracy a is the mean of vote times truth, where it votes;
    with independent voters i and j agree a_i a_j on average, so three voters give one of
    them. Dependence sums what agreement is left over, by how often the two vote together."""
    m = len(both)
    known = (both >= least) & ~np.eye(m, dtype=bool)
    mean = np.where(known, product / np.maximum(both, 1), np.nan)
    a = np.full(m, 0.5)
    for i in range(m):
        j = np.flatnonzero(known[i])
        sub = mean[np.ix_(j, j)]
        with np.errstate(invalid="ignore", divide="ignore"):
            squares = np.outer(mean[i, j], mean[i, j]) / sub
        squares = squares[np.isfinite(squares) & (np.abs(sub) > 0.05)]
        if len(squares):
            a[i] = math.sqrt(min(max(float(np.median(squares)), 0.0025), 0.95**2))
    left = np.where(known, np.abs(mean - np.outer(a, a)), 0)
    share = both / np.maximum(np.diag(both), 1)[:, None]
    return a, np.nansum(np.where(left > 0.05, left * share, 0), axis=1)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, bias_penalty: float = 1e-3, offset=0.0, steps: int = 30) -> np.ndarray:
    """Newton steps of logistic regression to soft labels y; the last weight is the bias.
    ``offset`` is added to the margin: the weights are then kept small against it."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], penalty)
    ridge[-1] = bias_penalty
    for _ in range(steps):
        p = sigmoid(x @ w + offset)
        gradient = x.T @ (p - y) + ridge * w
        hessian = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return w


def word_classifier(bits: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights of the buckets, bias) of logistic regression to soft labels y, in adaptive
    steps over the rows in their order. bits: packed, a row for each text."""
    size = 1 << BUCKET_BITS
    w, b = np.zeros(size), math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    seen = np.full(size, 1e-8)
    for _ in range(EPOCHS):
        for at in range(0, len(y), STEP_ROWS):
            x = np.unpackbits(bits[at : at + STEP_ROWS], axis=1).astype(np.float32)
            x /= np.sqrt(np.maximum(x.sum(axis=1, keepdims=True), 1))
            off = sigmoid(x @ w.astype(np.float32) + b) - y[at : at + STEP_ROWS]
            gradient = x.T @ off.astype(np.float32) / len(x) + RIDGE * w
            seen += gradient**2
            w -= RATE * gradient / np.sqrt(seen)
            b -= 0.1 * off.mean()
    return w, b


def word_margins(bits: np.ndarray, w: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits))
    for at in range(0, len(bits), 1024):
        x = np.unpackbits(bits[at : at + 1024], axis=1).astype(np.float32)
        out[at : at + 1024] = x @ w.astype(np.float32) / np.sqrt(np.maximum(x.sum(axis=1), 1))
    return out


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, mined: int = MINED, id_col: str = "doc_id", text_col: str = "text",
        label_id_col: str = "doc_id", label_col: str = "toxic") -> Model:
    spark = docs.sparkSession
    base.arrow_limits(spark)
    with base.scratch(spark):
        rows = base.texts(docs, id_col, text_col)
        labelled = labelled_ids(labels, fit_rows, label_id_col, label_col)
        found, prior = mine(rows, labelled, mined)
        terms = tuple(dict.fromkeys([("word", s.encode()) for s in SEEDS] + found))
        m, start = len(terms) + len(PATTERNS), math.log(prior / (1 - prior))
        a, dependence = label_model(*moments(rows, terms))
        strength = np.log((1 + a) / (1 - a)) / (1 + dependence)

        def features(wanted: DataFrame, *more: str):
            own = base.stored(vote_table(wanted, terms), "features")
            own = own.join(F.broadcast(labelled), "doc_id") if more else own
            taken = smallest(own, fit_rows, "votes", "bits").select("doc_id", "votes", "bits", *more).toArrow()
            votes = np.frombuffer(b"".join(taken["votes"].to_pylist()), np.int8).reshape(-1, m).astype(np.float64)
            bits = np.frombuffer(b"".join(taken["bits"].to_pylist()), np.uint8).reshape(-1, (1 << BUCKET_BITS) // 8)
            return taken, votes, bits

        taken, votes, bits = features(cut(rows.where(~held_out()), fit_rows))
        if not len(votes):
            return Model(terms, a, dependence, strength, start)
        posterior = sigmoid(votes @ strength + start)
        first = np.array([first_half(d) for d in taken["doc_id"].to_pylist()])
        words, bias = word_classifier(bits[first], posterior[first]) if first.any() else (None, 0.0)
        rest = ~first if (~first).any() else first
        ahead = word_margins(bits[rest], words) + bias if words is not None else 0.0
        w = logistic(votes[rest], posterior[rest], offset=ahead)
        # Labelled rows that the first part hasn't been fitted on.
        marked, votes, bits = features(rows.join(F.broadcast(labelled.select("doc_id")), "doc_id", "left_semi").where(~_first()), "label")
        slope, shift, y = 1.0, 0.0, np.array([float(x > 0) for x in marked["label"].to_pylist()])
        if len(y) and 0 < y.sum() < len(y):
            # Kept close to the classifier's own margin, or labels without errors would set the
            # curve anywhere between the classes.
            margin = votes @ w[:-1] + w[-1] + bias + (word_margins(bits, words) if words is not None else 0.0)
            turn, shift = logistic(margin[:, None], y, CURVE, CURVE, margin)
            slope = 1 + turn
        return Model(terms, a, dependence, w[:-1], float(w[-1] + bias), words, float(slope), float(shift))


def first_half(doc_id: int | None) -> bool:
    return doc_id is None or zlib.crc32(str(doc_id).encode()) % 4 < 2


def _first():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 < 2, F.lit(True))


class Scorer:
    def __init__(self, model: Model):
        self.model, self.voters, self.hashes = model, Voters(model.terms), Hashes()

    def scores(self, texts: list[bytes]) -> np.ndarray:
        model, margins = self.model, np.empty(len(texts))
        for i, t in enumerate(texts):
            text = base.words(t)
            margin = float(self.voters.votes(text) @ model.weights) + model.bias
            if model.words is not None and text:
                own = buckets(text, self.hashes)
                margin += float(model.words[own].sum()) / math.sqrt(len(own))
            margins[i] = margin
        return sigmoid(model.slope * margins + model.shift)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    base.arrow_limits(docs.sparkSession)

    def run(batches):
        base.sole("toxicity")
        scorer = Scorer(model)
        for batch in base.uncollected(batches):
            found = scorer.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = base.texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold."""
    base.arrow_limits(docs.sparkSession)

    def run(batches):
        base.sole("toxicity")
        scorer = Scorer(model)
        for batch in base.uncollected(batches):
            found = scorer.scores([t or b"" for t in batch.column(text_col).cast(pa.binary()).to_pylist()])
            yield batch.filter(pa.array(found < threshold))

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, base.table(spark, sf_dir, "labels")))
