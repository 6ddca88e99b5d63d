"""Constraints over a running state, as Catalyst expressions or as Python callables.

valid sees the state before the edge; update gives the state after it; final
judges complete paths. valid is pushed into the expansion, so it must be
prefix-closed: once false, false for all continuations.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Step:
    """What an expansion step sees: state fields, the edge's columns, the automaton's move."""

    state: Callable[[str], Column]
    edge: Callable[[str], Column]
    from_state: Column
    to_state: Column


@dataclass(frozen=True)
class Constraint:
    """state: field -> (type, initial value). needs: edge columns. increasing: strictly rising edge column."""

    state: dict[str, tuple[str, Any]] = field(default_factory=dict)
    update: Callable[[Step], dict[str, Column]] = lambda step: {}
    valid: Callable[[Step], Column | None] = lambda step: None
    final: Callable[[Callable[[str], Column]], Column | None] = lambda state: None
    needs: tuple[str, ...] = ()
    increasing: str | None = None
    keeps_ids: bool = False


def all_of(*parts: Constraint) -> Constraint:
    """All parts at once. Beside a part whose key strictly rises a trail need only watch edges without a key."""
    key = next((p.increasing for p in parts if p.increasing), None)
    if key:
        parts = (*(p for p in parts if not p.keeps_ids), *([trail_of_nulls(key)] if any(p.keeps_ids for p in parts) else []))
    named = list(enumerate(parts))
    inner = lambda step, i: Step(lambda n: step.state(f"{n}_{i}"), step.edge, step.from_state, step.to_state)

    def conj(columns: list[Column | None]) -> Column | None:
        out = None
        for c in columns:
            out = c if out is None else out if c is None else out & c
        return out

    return Constraint(
        {f"{k}_{i}": v for i, p in named for k, v in p.state.items()},
        lambda step: {f"{k}_{i}": c for i, p in named for k, c in p.update(inner(step, i)).items()},
        lambda step: conj([p.valid(inner(step, i)) for i, p in named]),
        lambda state: conj([p.final(lambda n, i=i: state(f"{n}_{i}")) for i, p in named]),
        tuple(dict.fromkeys(n for p in parts for n in p.needs)),
        next((p.increasing for p in parts if p.increasing), None),
        any(p.keeps_ids for p in parts),
    )


def trail(edge_id: str = "edge_id") -> Constraint:
    """No edge twice. Ids must not be null."""
    return Constraint(
        {"ids": ("array<bigint>", None)},
        lambda s: {"ids": F.array_append(s.state("ids"), s.edge(edge_id))},
        lambda s: ~F.array_contains(s.state("ids"), s.edge(edge_id)),
        needs=(edge_id,),
        keeps_ids=True,
    )


def trail_of_nulls(key: str, edge_id: str = "edge_id") -> Constraint:
    """No edge twice, beside a strictly rising key: edges with a key can't repeat, and those without come first.

    So only the ids of a path's first edges without a key are held, none where keys
    aren't null, and frontier rows still merge.
    """
    none = F.array().cast("array<bigint>")
    return Constraint(
        {"early": ("array<bigint>", None)},
        lambda s: {"early": F.when(s.edge(key).isNull(), F.array_append(s.state("early"), s.edge(edge_id))).otherwise(none)},
        lambda s: s.edge(key).isNotNull() | ~F.array_contains(s.state("early"), s.edge(edge_id)),
        needs=(key, edge_id),
    )


def monotonic(key: str, kind: str = "double") -> Constraint:
    """The edge column strictly rises along the path."""
    return Constraint(
        {"last": (kind, None)},
        lambda s: {"last": s.edge(key)},
        lambda s: s.state("last").isNull() | (s.edge(key) > s.state("last")),
        needs=(key,),
        increasing=key,
    )


def range_bound(key: str, bound: float, inclusive: bool = True, kind: str = "double") -> Constraint:
    """Largest minus smallest value of the edge column stays within bound."""

    def spread(s: Step) -> Column:
        return F.greatest(s.state("most"), s.edge(key)) - F.least(s.state("least"), s.edge(key))

    return Constraint(
        {"least": (kind, None), "most": (kind, None)},
        lambda s: {"least": F.least(s.state("least"), s.edge(key)), "most": F.greatest(s.state("most"), s.edge(key))},
        lambda s: spread(s) <= bound if inclusive else spread(s) < bound,
        needs=(key,),
    )


def adjacent_equal(key: str, kind: str = "string") -> Constraint:
    """Some two consecutive edges have an equal value; once seen, the value is forgotten so that states merge."""
    seen = lambda s: s.state("seen") | F.coalesce(s.state("value") == s.edge(key), F.lit(False))
    return Constraint(
        {"value": (kind, None), "seen": ("boolean", False)},
        lambda s: {"seen": seen(s), "value": F.when(~seen(s), s.edge(key))},
        final=lambda state: state("seen"),
        needs=(key,),
    )


def same_value(key: str, kind: str = "string") -> Constraint:
    """All edges have one value; an edge with null after the first value ends the path."""
    return Constraint(
        {"value": (kind, None)},
        lambda s: {"value": s.edge(key)},
        lambda s: s.state("value").isNull() | (s.state("value") == s.edge(key)),
        needs=(key,),
    )


def sum_at_least(key: str, bound: float) -> Constraint:
    return Constraint({"sum": ("double", 0.0)}, lambda s: {"sum": s.state("sum") + s.edge(key)}, final=lambda state: state("sum") >= bound, needs=(key,))


def risk_then_fraud(key: str, spread: float, least: float, normal: int = 1, fraud: int = 2, kind: str = "double") -> Constraint:
    """While the automaton is in normal, values lie within spread; entering fraud needs a last value of least.

    Moves other than 0 -> normal, normal -> normal, normal -> fraud and fraud -> fraud are invalid.
    """

    def valid(s: Step) -> Column:
        within = F.greatest(s.state("most"), s.edge(key)) - F.least(s.state("low"), s.edge(key)) <= spread
        move = lambda a, b: (s.from_state == a) & (s.to_state == b)
        return F.when(move(0, normal) | move(normal, normal), within | s.state("most").isNull()).when(move(normal, fraud), s.state("final") >= least).when(move(fraud, fraud), F.lit(True)).otherwise(F.lit(False))

    return Constraint(
        {"low": (kind, None), "most": (kind, None), "final": (kind, None)},
        lambda s: {"low": F.least(s.state("low"), s.edge(key)), "most": F.greatest(s.state("most"), s.edge(key)), "final": s.edge(key)},
        valid,
        needs=(key,),
    )


def truth(value, name: str) -> bool:
    if not isinstance(value, (bool, np.bool_)):
        raise TypeError(f"{name} must give True or False, not {value!r}")
    return bool(value)


@dataclass(frozen=True)
class PyConstraint:
    """User callables over a state. They see edges as dicts (columns) of Python values, nulls as None.

    init() -> D; update(D, from_state, to_state, edge) -> D; is_valid(D, from, to,
    edge) -> bool; finalize(D) -> D; is_valid_final(D) -> bool. A step is one Arrow
    UDF that checks and updates together. state: the fields of a dict D with their
    types, which then travels as a struct; without it D may be anything like JSON.
    """

    init: Callable[[], Any]
    update: Callable[[Any, int, int, dict], Any]
    is_valid: Callable[[Any, int, int, dict], bool] = lambda D, f, t, e: True
    is_valid_final: Callable[[Any], bool] = lambda D: True
    finalize: Callable[[Any], Any] = lambda D: D
    columns: tuple[str, ...] = ()
    state: str | None = None

    @property
    def kind(self) -> str:
        return StructType.fromDDL(self.state).simpleString() if self.state else "string"

    def step(self):
        init, update, is_valid, typed = self.init, self.update, self.is_valid, self.state is not None
        arrow = to_arrow_type(StructType.fromDDL(self.state)) if typed else pa.string()

        def run(state: pa.Array, from_state: pa.Array, to_state: pa.Array, edge: pa.Array) -> pa.Array:
            ok, out = [], []
            for d, f, t, e in zip(state.to_pylist(), from_state.to_pylist(), to_state.to_pylist(), edge.to_pylist()):
                own = init() if d is None else d if typed else json.loads(d)
                good = truth(is_valid(own, f, t, e), "is_valid")
                after = update(own, f, t, e) if good else None
                ok.append(good)
                out.append(after if typed or not good else json.dumps(after, default=str))
            return pa.StructArray.from_arrays([pa.array(ok, pa.bool_()), pa.array(out, arrow)], names=["ok", "state"])

        return F.arrow_udf(run, f"struct<ok:boolean,state:{self.kind}>")

    def final(self):
        finalize, is_valid_final, typed = self.finalize, self.is_valid_final, self.state is not None

        def run(state: pa.Array) -> pa.Array:
            return pa.array([truth(is_valid_final(finalize(d if typed else json.loads(d))), "is_valid_final") for d in state.to_pylist()], pa.bool_())

        return F.arrow_udf(run, "boolean")


def naive(is_valid_final: Callable[[list[dict]], bool], columns: tuple[str, ...]) -> PyConstraint:
    """Only complete paths are judged: the state is the list of edges, and nothing is pruned."""
    return PyConstraint(list, lambda D, f, t, e: [*D, e], is_valid_final=is_valid_final, columns=columns)


def py_trail(edge_id: str = "edge_id") -> PyConstraint:
    """No edge twice."""
    return PyConstraint(lambda: {"ids": []}, lambda D, f, t, e: {"ids": [*D["ids"], e[edge_id]]}, lambda D, f, t, e: e[edge_id] not in D["ids"], columns=(edge_id,), state="ids array<bigint>")


def py_all_of(*parts: PyConstraint) -> PyConstraint:
    """All Python constraints at once, each with its own state; a struct if all of them are typed."""
    if len(parts) == 1:
        return parts[0]
    named = [(f"p{i}", p) for i, p in enumerate(parts)]
    return PyConstraint(
        lambda: {k: p.init() for k, p in named},
        lambda D, f, t, e: {k: p.update(D[k], f, t, e) for k, p in named},
        lambda D, f, t, e: all(truth(p.is_valid(D[k], f, t, e), "is_valid") for k, p in named),
        lambda D: all(truth(p.is_valid_final(D[k]), "is_valid_final") for k, p in named),
        lambda D: {k: p.finalize(D[k]) for k, p in named},
        tuple(dict.fromkeys(c for p in parts for c in p.columns)),
        ", ".join(f"{k} {p.kind}" for k, p in named) if all(p.state for p in parts) else None,
    )
