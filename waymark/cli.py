"""Counts paths of CSV graphs: python -m waymark.cli --edges E --nodes N --nfa A --nfanodes S ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .harness import sweep
from .plans.constraints import adjacent_equal, all_of, monotonic, range_bound, risk_then_fraud, same_value, sum_at_least
from .plans.query import PathQuery
from .sources.graphs import assert_unique, read_edges, read_nfa, read_nodes

QUERIES = {
    "walk": (None, "walk"),
    "general": (all_of(same_value("location_region"), monotonic("timestamp_ms", "bigint"), risk_then_fraud("risk_score", 20, 40), sum_at_least("amount", 1000)), "trail"),
    "two-color": (adjacent_equal("color"), "trail"),
    "monotonic": (monotonic("weight"), "trail"),
    "max-min": (range_bound("weight", 2592000 / 2), "trail"),
}


def main(args: list[str] | None = None) -> list[int]:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("edges", "nodes", "nfa", "nfanodes"):
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--query", choices=sorted(QUERIES), default="monotonic")
    parser.add_argument("--start", type=int, nargs="+", required=True)
    parser.add_argument("--min-length", type=int, default=2)
    parser.add_argument("--max-length", type=int, default=4)
    parser.add_argument("--sweep", action="store_true", help="every longest length from --min-length to --max-length; ends at one without paths")
    parser.add_argument("--warmups", type=int, default=0)
    parser.add_argument("--runs", type=int, default=1)
    parser.add_argument("--timeout", type=float, help="seconds that a run may take")
    parser.add_argument("--explain", action="store_true")
    own = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    assert_unique(read_nodes(spark, own.nodes), "id")
    edges = read_edges(spark, own.edges, wide=own.query == "general").persist()
    nfa, (constraint, semantics) = read_nfa(spark, own.nfa, own.nfanodes), QUERIES[own.query]
    counts = []
    for start in own.start:
        query = lambda n, start=start: PathQuery(edges, nfa, [start], n, own.min_length, constraint, semantics)
        if own.explain:
            query(own.max_length).paths().explain("formatted")
        lengths = range(own.min_length if own.sweep else own.max_length, own.max_length + 1)
        for n, timing in sweep(spark, lambda n: query(n).count().first().n_paths, lengths, own.warmups, own.runs, own.timeout):
            if timing is None:
                print(f"length [{own.min_length}, {n}] from {start}: stopped after {own.timeout} s")
                continue
            counts.append(timing.result)
            times = ", ".join(f"{k} {1000 * v:.1f} ms" for k, v in timing.summary.items())
            print(f"{timing.result} paths of length [{own.min_length}, {n}] from {start}: {times}")
    return counts


if __name__ == "__main__":
    main()
