"""Path queries: start nodes, a label automaton, length bounds and a constraint."""

from __future__ import annotations

import tempfile
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.expand import can_accept, product_edges, seeds, union_all
from .constraints import Constraint, PyConstraint, Step, all_of, py_all_of, trail
from .nfa import Nfa

#: Levels up to which the expansion is one lazy plan; beyond, each level is kept in the checkpoint folder.
LAZY_LEVELS = 3


def shared_folder(spark: SparkSession) -> str:
    """The session's folder in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="waymark-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df computed once, in the session's shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


@dataclass(frozen=True)
class PathQuery:
    """Paths from starts whose labels nfa accepts, of min_len to max_len edges, that satisfy constraint.

    edges: (src, dst, label, edge_id, ...). semantics: trail (no edge twice) or
    walk. Bag semantics: parallel edges and ambiguous runs count each; determinise
    the automaton to count paths. constraint: one, or a tuple of Column and Python
    ones, which must all hold. collect: edge columns gathered as lists.

    The expansion joins the frontier with product edges on (node, state), one join
    a level; Spark picks broadcast or shuffle by the edges' size and splits hot
    nodes. Prefix-closed constraints are join filters. grouped merges frontier
    rows of equal (start, node, state, constraint state) into a count, which
    needs a state without edge lists: walks, or trails whose key strictly rises.
    """

    edges: DataFrame
    nfa: Nfa
    starts: DataFrame | list[int]
    max_len: int
    min_len: int = 1
    constraint: Constraint | PyConstraint | tuple | None = None
    semantics: str = "trail"
    grouped: bool = False
    pruned: bool = False
    collect: tuple[str, ...] = ()

    @property
    def parts(self) -> tuple:
        return self.constraint if isinstance(self.constraint, tuple) else (self.constraint,)

    @property
    def python(self) -> PyConstraint | None:
        """The Python constraints as one."""
        own = [p for p in self.parts if isinstance(p, PyConstraint)]
        return py_all_of(*own) if own else None

    def plan(self) -> Constraint:
        """The Column constraints as one, with the trail."""
        own = [p for p in self.parts if isinstance(p, Constraint)]
        return all_of(*own, *([trail()] if self.semantics == "trail" else []))

    def levels(self) -> list[DataFrame]:
        """The frontier after 1, 2, ... max_len edges, before length and acceptance are judged."""
        plan, python = self.plan(), self.python
        if self.grouped and (plan.keeps_ids or self.collect or python):
            raise ValueError("grouped counting needs a state without edge lists")
        columns = tuple(dict.fromkeys([*plan.needs, *self.collect, *(python.columns if python else ())]))
        moves = product_edges(self.edges, self.nfa, columns)
        moves = moves.select(*(F.col(c).alias(f"e_{c}") for c in moves.columns))
        by_level = python is not None or self.max_len > LAZY_LEVELS
        if by_level:
            moves = moves.persist()
        frontier = seeds(self.edges, self.starts, self.nfa).withColumn("n", F.lit(1).cast("bigint"))
        for name, (kind, value) in plan.state.items():
            start = F.array() if kind.startswith("array") and value is None else F.lit(value)
            frontier = frontier.withColumn(f"d_{name}", start.cast(kind))
        for c in self.collect:
            frontier = frontier.withColumn(f"l_{c}", F.array().cast(f"array<{dict(self.edges.dtypes)[c]}>"))
        if python:
            frontier = frontier.withColumn("py", F.lit(None).cast(python.kind))
        reach = can_accept(product_edges(self.edges, self.nfa), self.nfa, self.max_len) if self.pruned else None
        out = []
        for level in range(1, self.max_len + 1):
            frontier = self.step(frontier, moves, plan, python)
            if reach:
                near = reach[self.max_len - level].select(F.col("v").alias("r_v"), F.col("s").alias("r_s"))
                frontier = frontier.join(near, (frontier.v == near.r_v) & (frontier.s == near.r_s), "left_semi")
            if self.grouped:
                keys = [c for c in frontier.columns if c != "n"]
                frontier = frontier.groupBy(*keys).agg(F.sum("n").alias("n"))
            if by_level:
                frontier = kept(frontier)
            out.append(frontier.withColumn("path_length", F.lit(level)))
        if by_level:
            moves.unpersist()
        return out

    def step(self, frontier: DataFrame, moves: DataFrame, plan: Constraint, python: PyConstraint | None) -> DataFrame:
        step = Step(lambda n: F.col(f"d_{n}"), lambda n: F.col(f"e_{n}"), F.col("e_from_state"), F.col("e_to_state"))
        joined = frontier.join(moves, (F.col("v") == F.col("e_src")) & (F.col("s") == F.col("e_from_state")))
        valid = plan.valid(step)
        if valid is not None:
            joined = joined.where(valid)
        if python:
            edge = F.struct(*(F.col(f"e_{c}").alias(c) for c in python.columns))
            joined = joined.withColumn("py", python.step()("py", "e_from_state", "e_to_state", edge)).where("py.ok").withColumn("py", F.col("py.state"))
        after = {f"d_{k}": c for k, c in plan.update(step).items()}
        after |= {f"l_{c}": F.array_append(f"l_{c}", F.col(f"e_{c}")) for c in self.collect}
        fixed = [F.col("start"), F.col("e_dst").alias("v"), F.col("e_to_state").alias("s")]
        return joined.select(*fixed, *(after.get(c, F.col(c)).alias(c) for c in frontier.columns if c not in ("start", "v", "s")))

    def paths(self) -> DataFrame:
        """(start, end_node, nfa_state, path_length, n, lists): complete paths; n counts merged ones."""
        plan, python = self.plan(), self.python
        found = union_all([f for f in self.levels()[self.min_len - 1 :] if f is not None])
        found = found.where(F.col("s").isin(list(self.nfa.accepting)))
        final = plan.final(lambda n: F.col(f"d_{n}"))
        if final is not None:
            found = found.where(final)
        if python:
            found = found.where(python.final()("py"))
        return found.select("start", F.col("v").alias("end_node"), F.col("s").alias("nfa_state"), "path_length", "n", *(F.col(f"l_{c}").alias(f"{c}s") for c in self.collect))

    def filtered(self, late: Column) -> DataFrame:
        """Late filtering: walks whose collected lists satisfy late at the end."""
        return self.paths().where(late)

    def count(self) -> DataFrame:
        """One row: start nodes aside, the number of paths."""
        return self.paths().agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_paths"))

    def by_length(self) -> DataFrame:
        return counted(self.paths(), "path_length")

    def by_end_node(self) -> DataFrame:
        return counted(self.paths(), "end_node")

    def with_walks(self, *columns: str) -> PathQuery:
        """The same query without pruning, gathering columns for a late filter."""
        return replace(self, constraint=None, semantics="walk", collect=columns)


def counted(paths: DataFrame, *by: str) -> DataFrame:
    return paths.groupBy(*by).agg(F.sum("n").alias("n_paths"))


def recursive_sql(edges: str, nfa: str, initial: int, max_len: int, state: dict[str, tuple[str, str]], valid: str) -> str:
    """A recursive CTE named paths (v, s, path_length, state) over tables edges and nfa; the start node is the parameter :start.

    state: column -> (initial expression, expression after an edge e). The types of
    the first row are those of the whole recursion, so initial expressions are cast.
    Read it with LIMIT ALL, which lifts the session's limit of rows.
    """
    first = "".join(f", {a} AS {k}" for k, (a, _) in state.items())
    after = "".join(f", {b}" for _, b in state.values())
    return f"""WITH RECURSIVE paths(v, s, path_length{"".join(f", {k}" for k in state)}) MAX RECURSION LEVEL {max_len + 1} AS (
  SELECT CAST(:start AS BIGINT), {initial}, 0{first}
  UNION ALL
  SELECT e.dst, m.to_state, p.path_length + 1{after}
  FROM paths p JOIN {edges} e ON e.src = p.v JOIN {nfa} m ON m.from_state = p.s AND m.label = e.label
  WHERE p.path_length < {max_len} AND {valid}
)"""
