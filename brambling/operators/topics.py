"""Online LDA with a model dealt by term: the steps of ``pyspark.ml.clustering.LDA``, whose driver
holds topics x terms, without a copy of the model in any one place.

Documents lie in partitions of their own, terms (64-bit hashes) in others. In a step the terms
send a document's partition what it needs of the model, it sends back its documents' topics, and
the terms are moved. Terms that no step has drawn have no rows: their values are made again from
their hashes. The driver holds a few vectors of one number a topic."""

from __future__ import annotations

import gc
import pickle
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling.session import shared_path

#: Words in a partition of documents, terms in one of terms.
WORDS, TERMS = 2_000_000, 120_000
#: Rows of the model that documents are compared with at once, and passes over all documents.
ROWS, WAVES = 4096, 5
#: Parts of the model that are stored one after the other, each before its old rows are deleted.
GROUPS = 4
#: The library's defaults.
SHARE, OFFSET, DECAY, SHAPE = 0.05, 1024.0, 0.51, 100.0


def _place(number: int) -> int:
    """Keys are numbers of partitions."""
    return number


def _above(x):
    """z and r, where digamma(x) is log(z) + r: six steps up, over one denominator, and a series."""
    z = x + 6
    w = 1 / z
    y = w * w
    u = x * (z - 1)
    r = (x + z - 1) * ((3 * u + 20) * u + 24) / (u * (u + 4) * (u + 6))
    r += w * 0.5
    r += y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y * (1 / 240 - y * (1 / 132)))))
    return z, -r


def digamma(x):
    z, r = _above(x)
    return np.log(z) + r


def trigamma(x):
    z = x + 6
    y = 1 / (z * z)
    tail = y * (1 / 6 - y * (1 / 30 - y * (1 / 42 - y * (1 / 30 - y * 5 / 66))))
    return 1 / z + y / 2 + tail / z + sum(1 / (x + i) ** 2 for i in range(6))


def expectation(x):
    """Of the logarithm of a Dirichlet distribution, by row."""
    return digamma(x) - digamma(x.sum(axis=-1, keepdims=True))


def weights_of(x, level=None):
    """exp E[log] of a Dirichlet distribution, by row, or with its totals' digamma given."""
    z, r = _above(x)
    return z * np.exp(r - (digamma(x.sum(axis=-1, keepdims=True)) if level is None else level))


def first_values(terms, topics: int, seed: int):
    """A row of Gamma(100, 1/100) for each term, drawn by its hash."""
    bits = np.random.Philox(key=0)
    draw, state, out = np.random.Generator(bits), bits.state, np.empty((len(terms), topics))
    for row, term in zip(out, terms.view(np.uint64)):
        state["state"]["key"][:] = term, seed
        bits.state = state
        row[:] = draw.standard_gamma(SHAPE, topics)
    return out / SHAPE


def infer(lengths, places, counts, model, alpha, start):
    """For each document (``lengths`` of them, one after the other) its gamma, exp E[log theta] and
    the sum of its terms' shares. Documents of like lengths go together; each stops by itself."""
    begins = np.cumsum(lengths) - lengths
    gammas, thetas, shares = (np.zeros((len(lengths), len(alpha))) for _ in range(3))
    queue = np.argsort(-lengths, kind="stable")[: np.count_nonzero(lengths)]

    def mixed(theta, n, values):
        norm = (values @ theta[:, :, None])[:, :, 0] + 1e-100
        return theta * ((n / norm)[:, None, :] @ values)[:, 0, :]

    rows = queue[:0]
    while len(rows) or len(queue):
        if not len(rows) or len(queue) and len(rows) * n.shape[1] < ROWS // 2:
            # Those that are still moving are no shorter than those that join them.
            width = lengths[rows].max() if len(rows) else lengths[queue[0]]
            new, queue = np.split(queue, [max(1, ROWS // width - len(rows))])
            at = np.arange(width)
            pad = at >= lengths[new, None]
            at = np.where(pad, 0, begins[new, None] + at)
            state = [np.where(pad, 0.0, counts[at]), model[places[at]].astype(float), np.tile(start, (len(new), 1))]
            state.append(mixed(weights_of(state[2]), *state[:2]))
            state = [np.vstack([x[:, :width] if i < 2 else x, y]) for i, (x, y) in enumerate(zip((n, values, gamma, share), state))] if len(rows) else state
            rows, (n, values, gamma, share) = np.r_[rows, new], state
        gamma, before = share + alpha, gamma
        theta = weights_of(gamma)
        share = mixed(theta, n, values)
        done = np.abs(gamma - before).mean(axis=1) <= 1e-3
        if done.any():
            gammas[rows[done]], thetas[rows[done]], shares[rows[done]] = gamma[done], theta[done], share[done]
            rows, n, values, gamma, share = (x[~done] for x in (rows, n, values, gamma, share))
    return gammas, thetas, shares


def moved_alpha(alpha, log_theta, n, rate):
    """A Newton step of the documents' prior, if all of it stays above 0."""
    gradient, c, q = n * (log_theta - expectation(alpha)), n * trigamma(alpha.sum()), -n * trigamma(alpha)
    b = (gradient / q).sum() / (1 / c + (1 / q).sum())
    new = alpha - rate * (gradient - b) / q
    return new if (new > 0).all() else alpha


def drawn(keys, step: int, seed: int):
    """How often a step draws each document, with replacement: a Poisson number from its key."""
    x = keys.view(np.uint64) + np.uint64((seed * 1_000_003 + step + 1) * 0x9E3779B97F4A7C15 % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
    chances = SHARE ** np.arange(12) * np.exp(-SHARE) / np.cumprod([1, *range(1, 12)])
    return np.searchsorted(np.cumsum(chances), u, side="right")


def _cut(parts: int):
    """Batches of doc_id, key, terms as (partition, documents): ids, keys, lengths, terms, counts."""

    def run(batches):
        for batch in batches:
            keys, lists = batch.column(1).to_numpy(), batch.column(2)
            row = np.repeat(np.arange(len(keys)), np.diff(lists.offsets.to_numpy()))
            term = lists.flatten().to_numpy()
            order = np.lexsort((term, row))
            row, term = row[order], term[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (term[1:] != term[:-1])]) if len(row) else np.zeros(0, int)
            counts, row, term = np.diff(np.r_[first, len(row)]).astype(np.int32), row[first], term[first]
            own = (keys.view(np.uint64) % np.uint64(parts)).astype(int)
            for part in np.unique(own):
                docs = np.flatnonzero(own == part)
                mine = own[row] == part
                found = batch.column(0).take(pa.array(docs)), keys[docs], np.bincount(row[mine], minlength=len(keys))[docs], term[mine], counts[mine]
                yield pa.RecordBatch.from_arrays([pa.array([int(part)], pa.int32()), pa.array([pickle.dumps(found)], pa.binary())], ["part", "held"])

    return run


def _joined(blocks):
    """Blocks of documents as one: ids by block, keys, lengths, terms, counts."""
    ids, *rest = zip(*blocks)
    return pa.chunked_array(ids), *(np.concatenate(x) for x in rest)


def _chosen(docs, times):
    """keys, lengths, terms, counts of the documents drawn, and how often each is."""
    _, keys, lengths, terms, counts = docs
    held = times > 0
    pairs = np.repeat(held, lengths)
    return lengths[held], terms[pairs], counts[pairs], times[held]


def _split(kind, part, terms, parts):
    own = (terms.view(np.uint64) % np.uint64(parts)).astype(int)
    return [(int(p), (kind, part, terms[own == p])) for p in np.unique(own)]


class Fit:
    """One run. ``documents`` and ``models`` are keyed by partition: rows of a model are
    ("model", terms in order, float32 values)."""

    def __init__(self, docs: DataFrame, topics: int, words: int, terms: int, seed: int, min_df: float):
        sc = docs.sparkSession.sparkContext
        self.sc, self.topics, self.seed = sc, topics, seed
        self.doc_parts = max(sc.defaultParallelism, -(-words // WORDS))
        self.term_parts = parts = max(sc.defaultParallelism, -(-terms // TERMS))
        cut = docs.mapInArrow(_cut(self.doc_parts), "part int, held binary").rdd.map(lambda r: (r.part, bytes(r.held)))
        self.documents = cut.partitionBy(self.doc_parts, _place)
        if min_df > 1:
            self._drop_rare(min_df)
        sc.setCheckpointDir(shared_path(docs.sparkSession, "lda"))
        self.models = [sc.parallelize([], 1).partitionBy(parts, _place)] * GROUPS
        self.alpha, self.eta = np.full(topics, 1 / topics), 1 / topics
        self.kept, self.added = 1.0, 0.0  # of the first values of a term that no step has drawn

        def sums(rows):
            found = np.unique(np.concatenate([x[2] for _, x in rows] or [np.zeros(0, np.int64)]))
            total = sum((first_values(found[i : i + 10_000], topics, seed).sum(axis=0) for i in range(0, len(found), 10_000)), np.zeros(topics))
            yield len(found), total

        found = self._needs(lambda part, docs: docs[3]).mapPartitions(sums).collect()
        self.terms, self.total = sum(n for n, _ in found), sum(t for _, t in found)

    def _with_documents(self, other, work):
        """``work`` over a partition's number, documents and rows of ``other``."""

        def run(part, rows):
            rows = list(rows)
            blocks = [pickle.loads(x) for _, x in rows if isinstance(x, bytes)]
            if blocks:
                yield from work(part, _joined(blocks), [x for _, x in rows if not isinstance(x, bytes)])

        both = self.documents.union(other) if other else self.documents
        return both.mapPartitionsWithIndex(run)

    def _needs(self, terms_of):
        """The distinct terms of ``terms_of(part, docs)``, with their partitions."""
        parts = self.term_parts
        found = self._with_documents(None, lambda part, docs, _: _split("need", part, np.unique(terms_of(part, docs)), parts))
        return found.partitionBy(parts, _place)

    def _drop_rare(self, min_df: float):
        """Documents without the terms of fewer documents."""
        parts = self.term_parts

        def frequencies(part, docs, _):
            terms, df = np.unique(docs[3], return_counts=True)
            of = dict(zip(terms.tolist(), df))
            return [(p, (part, t, np.array([of[x] for x in t.tolist()]))) for p, (_, _, t) in _split("", part, terms, parts)]

        def kept(rows):
            rows = [x for _, x in rows]
            if rows:
                terms, place = np.unique(np.concatenate([t for _, t, _ in rows]), return_inverse=True)
                often = terms[np.bincount(place, np.concatenate([df for _, _, df in rows])) >= min_df]
                yield from ((part, ("kept", np.intersect1d(t, often))) for part, t, _ in rows)

        def without(part, docs, rows):
            held = np.isin(docs[3], np.concatenate([t for _, t in rows] or [np.zeros(0, np.int64)]))
            row = np.repeat(np.arange(len(docs[2])), docs[2])
            yield part, pickle.dumps((docs[0].combine_chunks(), docs[1], np.bincount(row[held], minlength=len(docs[2])), docs[3][held], docs[4][held]))

        found = self._with_documents(None, frequencies).partitionBy(parts, _place).mapPartitions(kept)
        self.documents = self._with_documents(found.partitionBy(self.doc_parts, _place), without).partitionBy(self.doc_parts, _place)

    def _values(self):
        """A function from a partition's rows to (terms, values) of the model, with the terms that
        are needed, and from values to exp E[log beta], as sent."""
        topics, seed, kept, added, level = self.topics, self.seed, self.kept, self.added, digamma(self.total)

        def held(rows, needed):
            terms, values = next(((x[1], x[2]) for x in rows if x[0] == "model"), (np.zeros(0, np.int64), np.zeros((0, topics), np.float32)))
            new = np.setdiff1d(needed, terms)
            order = np.argsort(np.r_[terms, new], kind="stable")
            made = np.vstack([values, (kept * first_values(new, topics, seed) + added).astype(np.float32)])
            return np.r_[terms, new][order], made[order]

        return held, lambda values: weights_of(values.astype(float), level).astype(np.float32)

    def _sent(self, needs):
        """What each partition of documents needs of the model: terms and values."""
        held, weights = self._values()

        def run(rows):
            rows = [x for _, x in rows]
            wanted = [x for x in rows if x[0] == "need"]
            if wanted:
                terms, values = held(rows, np.unique(np.concatenate([x[2] for x in wanted])))
                for _, part, own in wanted:
                    yield part, ("values", own, weights(values[np.searchsorted(terms, own)]))

        return self.sc.union([*self.models, needs]).mapPartitions(run).partitionBy(self.doc_parts, _place)

    def _start(self, step):
        return np.random.default_rng([self.seed, step]).standard_gamma(SHAPE, self.topics) / SHAPE

    def step(self, step: int, n: int):
        """Draws documents and moves the model and the prior by them; n: all documents."""
        seed, parts, alpha, start, topics, eta = self.seed, self.term_parts, self.alpha, self._start(step), self.topics, self.eta
        rate = (OFFSET + step + 1) ** -DECAY
        scale = n / np.ceil(SHARE * n)
        needs = self._needs(lambda part, docs: _chosen(docs, drawn(docs[1], step, seed))[1])

        def documents(part, docs, rows):
            lengths, terms, counts, times = _chosen(docs, drawn(docs[1], step, seed))
            if not len(terms):
                return
            known, model = _model(rows)
            gamma, theta, share = infer(lengths, np.searchsorted(known, terms), counts, model, alpha, start)
            times = times * (lengths > 0)
            log_theta = times[lengths > 0] @ expectation(gamma[lengths > 0])
            yield -1, (times.sum(), log_theta, times @ share)
            doc = np.repeat(np.arange(len(lengths)), lengths)
            weight = counts * times[doc]
            own = (terms.view(np.uint64) % np.uint64(parts)).astype(int)
            for p in np.unique(own):
                mine = own == p
                yield int(p), ("theta", theta, doc[mine].astype(np.int32), terms[mine], weight[mine])

        inferred = self._with_documents(self._sent(needs), documents).persist(StorageLevel.MEMORY_AND_DISK)
        held, weights = self._values()

        def move(group, part, rows):
            rows = [x for _, x in rows] if part % GROUPS == group else []
            found = [x for x in rows if x[0] == "theta"]
            terms, values = held(rows, np.unique(np.concatenate([x[3] for x in found] or [np.zeros(0, np.int64)])))
            total = np.zeros(values.shape, np.float32)
            for _, theta, doc, own, weight in found:
                order = np.argsort(own, kind="stable")
                doc, weight, at = doc[order], weight[order], np.searchsorted(terms, own[order])
                for of in range(0, len(at), 20_000):
                    chunk = slice(of, of + 20_000)
                    mixed, places = theta[doc[chunk]], at[chunk]
                    firsts = np.flatnonzero(np.r_[True, places[1:] != places[:-1]])
                    beta = weights(values[places[firsts]]).astype(float)
                    norm = np.einsum("ij,ij->i", mixed, beta[np.cumsum(np.r_[False, places[1:] != places[:-1]])]) + 1e-100
                    mixed *= (weight[chunk] / norm)[:, None]
                    total[places[firsts]] += beta * np.add.reduceat(mixed, firsts)
            if len(terms):
                yield part, ("model", terms, ((1 - rate) * values + rate * (scale * total + eta)).astype(np.float32))

        back = self._stored(inferred.filter(lambda x: x[0] >= 0).partitionBy(parts, _place))
        sums = inferred.filter(lambda x: x[0] < 0).values().collect()
        inferred.unpersist()
        del needs, inferred
        self._clean()
        drawn_n = sum(x[0] for x in sums)
        if drawn_n:
            for group in range(GROUPS):
                moved = self._stored(self.models[group].union(back).mapPartitionsWithIndex(partial(move, group), preservesPartitioning=True))
                self._delete(self.models[group])
                self.models[group] = moved
            self.total = (1 - rate) * self.total + rate * (scale * sum(x[2] for x in sums) + eta * self.terms)
            self.alpha = moved_alpha(alpha, sum(x[1] for x in sums) / drawn_n, float(drawn_n), rate)
            self.kept, self.added = (1 - rate) * self.kept, (1 - rate) * self.added + rate * eta
        self._delete(back)
        del back
        self._clean()

    def _stored(self, rows):
        """The rows as stored, without Python's own record of where they came from, which would
        keep shuffled files and rows that are no longer needed."""
        rows.checkpoint()
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        rows._jrdd.count()
        rows.unpersist()
        out = RDD(rows._jrdd, self.sc, rows._jrdd_deserializer)
        out.partitioner = rows.partitioner
        return out

    def _delete(self, rows):
        if path := rows.getCheckpointFile():
            at = self.sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.sc._jsc.hadoopConfiguration()).delete(at, True)

    def _clean(self):
        """Lets Spark delete the shuffled files of steps that ended."""
        gc.collect()
        self.sc._jvm.System.gc()

    def distributions(self, spark, id_type: str) -> DataFrame:
        """doc_id, topics of all documents, stored. A document without terms has zeros."""
        alpha, start, topics, path = self.alpha, self._start(-1 % 2**32), self.topics, shared_path(spark, "topics")

        def decode(batches):
            for batch in batches:
                for held in batch.column(0).to_pylist():
                    ids, values = pickle.loads(held)
                    yield pa.RecordBatch.from_arrays([ids, pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), topics).cast(pa.list_(pa.float64()))], ["doc_id", "topics"])

        for wave in range(WAVES):
            needs = self._needs(lambda part, docs: docs[3] if part % WAVES == wave else docs[3][:0])

            def documents(part, docs, rows):
                if part % WAVES == wave:
                    ids, _, lengths, terms, counts = docs
                    known, model = _model(rows, topics)
                    gamma = infer(lengths, np.searchsorted(known, terms), counts, model, alpha, start)[0]
                    yield (pickle.dumps((ids.combine_chunks(), gamma / np.maximum(gamma.sum(axis=1, keepdims=True), 1e-300))),)

            made = self._with_documents(self._sent(needs), documents)
            spark.createDataFrame(made, "held binary").mapInArrow(decode, f"doc_id {id_type}, topics array<double>").write.mode("append").parquet(path)
            del needs, made
            self._clean()
        for model in self.models:
            self._delete(model)
        return spark.read.parquet(path)


def _model(rows, topics: int = 0):
    """The values sent to a partition of documents, by term."""
    if not rows:
        return np.zeros(0, np.int64), np.zeros((0, topics))
    terms, values = np.concatenate([x[1] for x in rows]), np.concatenate([x[2] for x in rows])
    order = np.argsort(terms)
    return terms[order], values[order]


def dealt_topics(tokens: DataFrame, topics: int, max_iter: int, words: int, terms: int, min_df: float = 1.0, seed: int = 0) -> DataFrame:
    """doc_id, topics of tokens (doc_id, tokens), with about so many words and terms in all."""
    key = F.xxhash64("doc_id", "tokens")
    hashed = F.transform("tokens", lambda t: F.xxhash64(t))
    n = tokens.count()
    fit = Fit(tokens.select("doc_id", key.alias("key"), hashed.alias("terms")), topics, words, terms, seed, min_df if min_df >= 1 else min_df * n)
    for step in range(max_iter):
        fit.step(step, n)
    return fit.distributions(tokens.sparkSession, tokens.schema["doc_id"].dataType.simpleString())
