"""One call per request of an interactive workbench: preview, automaton, run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.constraints import PyConstraint, naive, truth
from .plans.nfa import Nfa, simple
from .plans.query import PathQuery
from .sources.graphs import preview

__all__ = ["dry_run", "generate_nfa", "message", "preview", "run", "scaffold"]


def generate_nfa(expression: str) -> dict:
    """The automaton of a label sequence as lists of states and moves."""
    nfa = simple(expression)
    return {
        "nodes": [{"id": s, "type": "initial"} for s in nfa.initial] + [{"id": s, "type": "accepting"} for s in nfa.accepting],
        "edges": [{"from_state": f, "to_state": t, "label": x} for f, t, x in nfa.transitions],
    }


def run(edges: DataFrame, expression: str | Nfa, start: int, lower: int, upper: int, mode: str, functions: dict, columns: tuple[str, ...]) -> DataFrame:
    """One row (start, min_len, max_len, n_paths).

    mode naive: functions has is_viable_d_final, which sees the list of a path's
    edges; advanced: also init_d, update_d, is_viable_d, finalize_d over any
    JSON-like state. They are callables: no source text is executed. Paths are
    walks; constraints that need distinct edges check them.
    """
    if mode == "naive":
        constraint = naive(functions["is_viable_d_final"], columns)
    elif mode == "advanced":
        constraint = PyConstraint(functions["init_d"], functions["update_d"], functions["is_viable_d"], functions["is_viable_d_final"], functions["finalize_d"], columns)
    else:
        raise ValueError(f"mode {mode!r}: naive or advanced")
    nfa = simple(expression) if isinstance(expression, str) else expression
    found = PathQuery(edges, nfa, [start], upper, lower, constraint, "walk").count()
    return found.selectExpr(f"CAST({start} AS BIGINT) AS start", f"{lower} AS min_len", f"{upper} AS max_len", "n_paths")


def scaffold(expression: str | Nfa) -> str:
    """Python stubs of update_d and is_viable_d, with a case for each pair of states that the automaton joins."""
    nfa = simple(expression) if isinstance(expression, str) else expression
    moves: dict[tuple[int, int], list[str]] = {}
    for f, t, label in nfa.transitions:
        moves.setdefault((f, t), []).append(label)
    out = []
    for name, default in (("update_d", "D"), ("is_viable_d", "True")):
        out += [f"def {name}(D, from_state, to_state, edge):", "    match from_state, to_state:"]
        for (f, t), labels in sorted(moves.items()):
            out += [f"        case ({f}, {t}):  # {', '.join(labels)}", f"            return {default}"]
        out += ["        case _:", f"            return {default}", "", ""]
    return "\n".join(out).rstrip() + "\n"


def dry_run(functions: dict, edges: list[dict], moves: list[tuple[int, int]]) -> dict:
    """The five callables on sample edges, without Spark: how many steps were viable, the final state, and the verdict.

    A step that isn't viable ends the run, as it ends a path. Checks that give
    anything but True or False raise TypeError.
    """
    state, steps = functions["init_d"](), 0
    for (f, t), edge in zip(moves, edges):
        if not truth(functions["is_viable_d"](state, f, t, edge), "is_viable_d"):
            break
        state = functions["update_d"](state, f, t, edge)
        steps += 1
    state = functions.get("finalize_d", lambda D: D)(state)
    return {"steps": steps, "state": state, "accepted": truth(functions["is_viable_d_final"](state), "is_viable_d_final")}


def message(result) -> str:
    return f"Number of paths [{result.min_len}, {result.max_len}] from {result.start} are: {result.n_paths}"
