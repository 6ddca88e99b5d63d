"""Label regular expressions as automata without empty moves.

Grammar: labels [A-Za-z0-9_]+, concatenation by white space or adjacency,
alternation |, groups ( ), postfix + * ?. Compilation follows Glushkov: a state per
label occurrence, so that the result joins directly with edges.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

TOKEN = re.compile(r"\s*([A-Za-z0-9_]+|[()|+*?])")


@dataclass(frozen=True)
class Nfa:
    """transitions (from, to, label) as a bag; initial and accepting states, any number of each."""

    transitions: tuple[tuple[int, int, str], ...]
    initial: tuple[int, ...]
    accepting: tuple[int, ...]

    @property
    def labels(self) -> list[str]:
        return sorted({t[2] for t in self.transitions})

    def edges(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.transitions), "from_state int, to_state int, label string")

    def states(self, spark: SparkSession) -> DataFrame:
        """(id, type): a state that is both initial and accepting has two rows."""
        rows = [(s, "initial") for s in self.initial] + [(s, "accepting") for s in self.accepting]
        return spark.createDataFrame(rows, "id int, type string")

    def accepts(self, word: list[str]) -> bool:
        now = set(self.initial)
        for label in word:
            now = {t for f, t, x in self.transitions if f in now and x == label}
        return bool(now & set(self.accepting))

    def determinised(self) -> Nfa:
        """The subset automaton: one run per accepted word, so that paths count once."""
        start = frozenset(self.initial)
        number, todo, moves = {start: 0}, [start], []
        while todo:
            own = todo.pop()
            for label in self.labels:
                to = frozenset(t for f, t, x in self.transitions if f in own and x == label)
                if to:
                    if to not in number:
                        number[to] = len(number)
                        todo.append(to)
                    moves.append((number[own], number[to], label))
        accepting = [n for states, n in number.items() if states & set(self.accepting)]
        return Nfa(tuple(sorted(moves)), (0,), tuple(sorted(accepting)))


def simple(expression: str) -> Nfa:
    """Concatenation of labels with an optional + each: state i moves to i + 1, and loops there after a +.

    Empty expressions, groups and alternation raise ValueError, as does any other
    character (in a single token too, where others might drop it silently).
    """
    if re.search(r"[()|]", expression):
        raise ValueError("only concatenation with postfix + is supported here")
    tokens = re.findall(r"[A-Za-z0-9_]+\+?", expression)
    if not tokens or re.sub(r"[A-Za-z0-9_]+\+?|\s+", "", expression):
        raise ValueError(f"not a sequence of labels: {expression!r}")
    moves = []
    for i, token in enumerate(tokens):
        moves.append((i, i + 1, token.rstrip("+")))
        if token.endswith("+"):
            moves.append((i + 1, i + 1, token.rstrip("+")))
    return Nfa(tuple(moves), (0,), (len(tokens),))


def compile_regex(expression: str) -> Nfa:
    """The position automaton of a label expression; ValueError if it is empty or malformed."""
    tokens, at = [], 0
    text = expression.strip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at]!r} in {expression!r}")
        tokens.append(m[1])
        at = m.end()
    if not tokens:
        raise ValueError("the expression is empty")
    labels: list[str] = []
    follow: dict[int, set[int]] = {}
    rest = list(reversed(tokens))

    # each part: (may be empty, first positions, last positions)
    def union():
        part = concat()
        while rest and rest[-1] == "|":
            rest.pop()
            other = concat()
            part = (part[0] or other[0], part[1] | other[1], part[2] | other[2])
        return part

    def concat():
        part = None
        while rest and rest[-1] not in "|)":
            other = repeat()
            if part is None:
                part = other
                continue
            for p in part[2]:
                follow[p] |= other[1]
            part = (part[0] and other[0], part[1] | (other[1] if part[0] else set()), other[2] | (part[2] if other[0] else set()))
        if part is None:
            raise ValueError(f"an empty part in {expression!r}")
        return part

    def repeat():
        token = rest.pop()
        if token == "(":
            part = union()
            if not rest or rest.pop() != ")":
                raise ValueError(f"an open group in {expression!r}")
        elif token in "+*?":
            raise ValueError(f"nothing to repeat in {expression!r}")
        else:
            labels.append(token)
            follow[len(labels)] = set()
            part = (False, {len(labels)}, {len(labels)})
        while rest and rest[-1] in "+*?":
            mark = rest.pop()
            if mark in "+*":
                for p in part[2]:
                    follow[p] |= part[1]
            part = (part[0] or mark in "*?", part[1], part[2])
        return part

    empty, first, last = union()
    if rest:
        raise ValueError(f"unexpected {rest[-1]!r} in {expression!r}")
    moves = {(0, p, labels[p - 1]) for p in first} | {(p, q, labels[q - 1]) for p, to in follow.items() for q in to}
    return Nfa(tuple(sorted(moves)), (0,), tuple(sorted(last | ({0} if empty else set()))))
