"""Regular expressions to one minimal deterministic automaton over bytes.

Syntax: literals, ``\\xHH``, ``[...]`` with ranges and ``^``, groups, ``|``, ``?``, ``*``,
``+`` and ``{m}``, ``{m,}``, ``{m,n}``. A rule may ignore the case of ASCII letters.
Several rules go into one automaton; each state knows the rules that end in it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class _Parser:
    """Recursive descent into a tree of ('set', bytes), ('cat', ..), ('alt', ..), ('rep', node, low, high)."""

    def __init__(self, pattern: str, ignore_case: bool):
        self.s, self.i, self.fold = pattern, 0, ignore_case

    def parse(self):
        node = self.alternatives()
        if self.i != len(self.s):
            raise ValueError(f"unexpected {self.s[self.i]!r} at {self.i} in {self.s!r}")
        return node

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def alternatives(self):
        branches = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            branches.append(self.sequence())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        return ("cat", parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            if c == "{":
                end = self.s.index("}", self.i)
                low, comma, high = self.s[self.i : end].partition(",")
                self.i = end + 1
                bounds = (int(low), int(high) if high else None if comma else int(low))
            else:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
            node = ("rep", node, *bounds)
        return node

    def byte(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def folded(self, members: set[int]) -> frozenset[int]:
        if self.fold:
            members = members | {b ^ 32 for b in members if chr(b).isalpha() and b < 128}
        return frozenset(members)

    def atom(self):
        c = self.peek()
        if c == "(":
            self.i += 1
            node = self.alternatives()
            if self.peek() != ")":
                raise ValueError(f"unclosed group in {self.s!r}")
            self.i += 1
            return node
        if c == "[":
            self.i += 1
            negate = self.peek() == "^"
            self.i += negate
            members: set[int] = set()
            while self.peek() != "]" or not members:
                low = self.byte()
                if self.peek() == "-" and self.s[self.i + 1] != "]":
                    self.i += 1
                    members.update(range(low, self.byte() + 1))
                else:
                    members.add(low)
            self.i += 1
            members = set(self.folded(members))
            return ("set", frozenset(range(256)) - members if negate else frozenset(members))
        return ("set", self.folded({self.byte()}))


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append(None)
        return len(self.empty) - 1

    def add(self, node, start: int) -> int:
        """Wire ``node`` in from ``start``; returns its end."""
        if node[0] == "set":
            end, s = self.state(), self.state()
            self.empty[start].append(s)
            self.moves[s] = (node[1], end)
            return end
        if node[0] == "cat":
            for part in node[1]:
                start = self.add(part, start)
            return start
        if node[0] == "alt":
            end = self.state()
            for branch in node[1]:
                s = self.state()
                self.empty[start].append(s)
                self.empty[self.add(branch, s)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop, end = self.state(), self.state()
            self.empty[start].append(loop)
            self.empty[loop].append(end)
            self.empty[self.add(inner, loop)].append(loop)
            return end
        end = self.state()
        for _ in range(high - low):
            self.empty[start].append(end)
            start = self.add(inner, start)
        self.empty[start].append(end)
        return end


@dataclass(frozen=True)
class Automaton:
    """table[state, byte]: next state; accepts[state]: rules that end there. State 0 starts.
    States that accept are numbered from ``first_accepting`` up; ``dead`` is a state that
    can't accept any more, or -1."""

    table: np.ndarray
    accepts: list[tuple[int, ...]]
    first_accepting: int
    dead: int


def _reverse(node):
    if node[0] == "cat":
        return ("cat", [_reverse(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_reverse(x) for x in node[1]])
    if node[0] == "rep":
        return ("rep", _reverse(node[1]), *node[2:])
    return node


def _shortest(node):
    """Without the repeats a match may end with: what it must read before it can end.
    A run that goes on would otherwise double the number of states for each rule."""
    if node[0] != "cat":
        return ("rep", node[1], node[2], node[2]) if node[0] == "rep" else node
    parts = list(node[1])
    while parts and parts[-1][0] == "rep" and parts[-1][2] == 0:
        parts.pop()
    return ("cat", [*parts[:-1], _shortest(parts[-1])]) if parts else node


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool = True, backwards: bool = False, shortest: bool = False) -> Automaton:
    """rules: (pattern, ignore case). ``anywhere``: a match may begin at any byte;
    ``backwards``: the automaton reads matches from their last byte to their first;
    ``shortest``: a rule ends where its trailing repeats have their least number."""
    nfa = _Nfa()
    root = nfa.state()
    ends: dict[int, int] = {}
    for k, (pattern, fold) in enumerate(rules):
        tree = _Parser(pattern, fold).parse()
        tree = _shortest(tree) if shortest else tree
        s = nfa.state()
        nfa.empty[root].append(s)
        ends[nfa.add(_reverse(tree) if backwards else tree, s)] = k

    closures: dict[int, frozenset[int]] = {}

    def closure(s: int) -> frozenset[int]:
        if s not in closures:
            seen, stack = {s}, [s]
            while stack:
                for t in nfa.empty[stack.pop()]:
                    if t not in seen:
                        seen.add(t)
                        stack.append(t)
            # only states that read a byte or end a rule matter
            closures[s] = frozenset(t for t in seen if nfa.moves[t] or t in ends)
        return closures[s]

    # Bytes that no set tells apart share a column.
    signature = [[] for _ in range(256)]
    for k, sets in enumerate(sorted({m[0] for m in nfa.moves if m}, key=sorted)):
        for b in sets:
            signature[b].append(k)
    columns: dict[tuple, int] = {}
    column_of = np.array([columns.setdefault(tuple(s), len(columns)) for s in signature])
    sample = [int(np.argmax(column_of == c)) for c in range(len(columns))]

    # Subset construction.
    begin = closure(root)
    numbers, order, rows = {begin: 0}, [begin], []
    for subset in order:
        row = []
        for b in sample:
            target = set(begin) if anywhere else set()
            for s in subset:
                if (m := nfa.moves[s]) and b in m[0]:
                    target |= closure(m[1])
            key = frozenset(target)
            if key not in numbers:
                numbers[key] = len(order)
                order.append(key)
            row.append(numbers[key])
        rows.append(row)
    moves = np.array(rows)
    accepts = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in order]

    # Minimisation: split classes until all members of a class move alike.
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(a, len(kinds)) for a in accepts])
    while True:
        keys = np.column_stack([classes, classes[moves]])
        _, finer = np.unique(keys, axis=0, return_inverse=True)
        finer = finer.ravel()
        if finer.max() == classes.max():
            break
        classes = finer

    n = int(classes.max()) + 1
    member = [int(np.argmax(classes == c)) for c in range(n)]
    ranked = sorted(range(n), key=lambda c: (bool(accepts[member[c]]), c != classes[0], c))
    place = {c: i for i, c in enumerate(ranked)}
    table = np.array([[place[int(classes[moves[member[c], column_of[b]]])] for b in range(256)] for c in ranked], dtype=np.int32)
    final = [accepts[member[c]] for c in ranked]
    dead = next((i for i in range(n) if not final[i] and (table[i] == i).all()), -1)
    return Automaton(table, final, sum(not a for a in final), dead)
