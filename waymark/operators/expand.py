"""Steps of the product of graph and automaton, as joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.nfa import Nfa


def product_edges(edges: DataFrame, nfa: Nfa, columns: tuple[str, ...] = ()) -> DataFrame:
    """Each edge with each move on its label: (src, from_state, dst, to_state, columns).

    The automaton is compiled on the driver and small; it is broadcast. Edges of
    other labels are filtered at the scan. Parallel edges and repeated moves stay.
    """
    moves = F.broadcast(nfa.edges(edges.sparkSession))
    wanted = edges.where(F.col("label").isin(nfa.labels)).select("src", "dst", "label", *(c for c in columns if c not in ("src", "dst", "label")))
    return wanted.join(moves, "label").select("src", "from_state", "dst", "to_state", *(c for c in columns if c not in ("src", "dst")))


def seeds(edges: DataFrame, starts: DataFrame | list[int], nfa: Nfa) -> DataFrame:
    """(start, v, s): a row of length 0 for each start node and initial state."""
    if isinstance(starts, list):
        starts = edges.sparkSession.createDataFrame([(x,) for x in starts], "start bigint")
    initial = F.explode(F.array(*(F.lit(s) for s in nfa.initial)))
    return starts.select("start", F.col("start").alias("v"), initial.alias("s"))


def can_accept(product: DataFrame, nfa: Nfa, steps: int) -> list[DataFrame]:
    """For k = 0 .. steps: the (v, s) from which an accepting state is k moves away at most."""
    moves = product.select("src", "from_state", "dst", "to_state").distinct()
    nodes = moves.select(F.col("src").alias("v")).union(moves.select("dst")).distinct()
    out = [nodes.withColumn("s", F.explode(F.array(*map(F.lit, nfa.accepting)).cast("array<int>")))]
    for _ in range(steps):
        near = out[-1]
        before = moves.join(near, (moves.dst == near.v) & (moves.to_state == near.s)).select(F.col("src").alias("v"), F.col("from_state").alias("s"))
        out.append(near.union(before).distinct())
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
