"""Secret scans with one combined deterministic automaton.

All rule regexes become one minimal automaton over bytes (``automaton.compile_rules``),
and each text is read once, byte by byte, whatever the number of rules. Where a rule
can end, a reversed automaton of that rule walks back to its leftmost start and an anchored
one walks on to its longest end; spans of one kind don't overlap. Then length bounds,
which would only blow up the automaton, are checked on the span.

Defined results: a null or empty text has no spans; repeated rows give repeated results;
rows of a null id keep it; extra columns are ignored. Map-only: no shuffle, memory
bounded by an Arrow batch, any task can be run again.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from . import base
from .automaton import compile_rules


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    min_length: int = 0  #: bytes of the span, or of group 1 of ``value``
    value: str = ""  #: where given, a span must match it as a whole


BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", True, 6,
         r"""[A-Za-z_]+?["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    Rule("access", r"AKIA[A-Z0-9]+", min_length=20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", min_length=40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", min_length=15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", min_length=39),
    Rule("stripe", r"[sr]k_(live|test)_[A-Za-z0-9]+", min_length=24),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", False, 36, r"([A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+)"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]+=*", True, 27),
)
RULES = BASE_RULES + MORE_RULES
SCHEMA = "doc_id long, kind string, start long, end long"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        every = compile_rules([(r.pattern, r.ignore_case) for r in rules], shortest=True)
        # States times 256, so that one addition finds the next state.
        self.moves = (every.table.ravel() * 256).tolist()
        self.accepting = every.first_accepting * 256
        self.ends = [every.accepts[s] for s in range(len(every.accepts))]
        self.single = []
        for r in rules:
            pair = []
            for backwards in (True, False):
                one = compile_rules([(r.pattern, r.ignore_case)], anywhere=False, backwards=backwards, shortest=backwards)
                pair.append((one.table.tolist(), one.first_accepting, one.dead))
            self.single.append(pair)
        self.values = [re.compile(r.value.encode()) if r.value else None for r in rules]

    def span(self, k: int, data: bytes, end: int, least: int) -> tuple[int, int] | None:
        """The leftmost start from ``least`` on of a match that ends at ``end``, and its longest end."""
        (table, accepting, dead), ahead = self.single[k]
        s, start = 0, -1
        for i in range(end - 1, least - 1, -1):
            s = table[s][data[i]]
            if s >= accepting:
                start = i
            elif s == dead:
                break
        if start < 0:
            return None
        table, accepting, dead = ahead
        s, last = 0, end
        for i in range(start, len(data)):
            s = table[s][data[i]]
            if s >= accepting:
                last = i + 1
            elif s == dead:
                break
        return start, last

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and rule."""
        found: list[tuple[int, int, int]] = []
        used = [0] * len(self.rules)
        moves, accepting, s = self.moves, self.accepting, 0
        for i, b in enumerate(data):
            s = moves[s + b]
            if s >= accepting:
                for k in self.ends[s >> 8]:
                    if i >= used[k] and (hit := self.span(k, data, i + 1, used[k])):
                        used[k] = hit[1]
                        if self.long_enough(k, data[hit[0] : hit[1]]):
                            found.append((hit[0], k, hit[1]))
        found.sort()
        return found

    def long_enough(self, k: int, span: bytes) -> bool:
        if value := self.values[k]:
            if not (m := value.fullmatch(span)):
                return False
            span = m[1]
        return len(span) >= self.rules[k].min_length

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, end exclusive."""
        out, at, points = [], 0, 0
        for start, k, end in self.scan(data):
            if start < at:  # overlaps a span of another kind
                points -= len(data[start:at].decode())
            else:
                points += len(data[at:start].decode())
            at = start
            out.append((self.rules[k].kind, points, points + len(data[start:end].decode())))
        return out


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """Compiled once in each Python worker."""
    return Scanner(rules)


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span: doc_id, kind, start, end (code points of the text)."""
    base.arrow_limits(docs.sparkSession)

    def run(batches):
        find = scanner(rules).spans
        for batch in batches:
            rows = [(d, *x) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()) for x in find(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, [pa.int64(), pa.string(), pa.int64(), pa.int64()])],
                ["doc_id", "kind", "start", "end"],
            )

    return base.texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def secret_digests(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base_kinds: tuple[str, ...] = ("assign", "access", "hex"),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: n_<kind> of the base kinds, base_sha256, spans."""
    base.arrow_limits(docs.sparkSession)
    names = ["doc_id", *(f"n_{k}" for k in base_kinds), "base_sha256", "spans"]

    def run(batches):
        find = scanner(rules).spans
        for batch in batches:
            columns: list[list] = [batch.column(0).to_pylist(), *([] for _ in names[1:])]
            for t in batch.column(1).cast(pa.binary()).to_pylist():
                spans = find(t)
                own = [x for x in spans if x[0] in base_kinds]
                for c, kind in zip(columns[1:-2], base_kinds):
                    c.append(sum(x[0] == kind for x in own))
                columns[-2].append(hashlib.sha256(joined(own).encode()).hexdigest())
                columns[-1].append(joined(spans))
            kinds = [pa.int64()] * (len(names) - 2) + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    schema = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    return base.texts(docs, id_col, text_col).mapInArrow(run, schema)


def op8_secret_scan(spark, sf_dir: str) -> DataFrame:
    return secret_digests(base.table(spark, sf_dir, "documents"))
