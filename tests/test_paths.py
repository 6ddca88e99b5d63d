"""Path queries against a depth-first search over small graphs."""

import random

import pytest
from pyspark.sql import functions as F

from waymark.functions import paths as L
from waymark.plans.constraints import PyConstraint, adjacent_equal, all_of, monotonic, naive, py_all_of, py_trail, range_bound, same_value, sum_at_least
from waymark.plans.nfa import Nfa, compile_regex
from waymark.plans.query import PathQuery, counted

SCHEMA = "edge_id bigint, src bigint, dst bigint, label string, weight double, color string"


def search(edges, nfa, starts, low, high, valid, trail=True):
    """All accepted runs, as (start, end, state, edge ids)."""
    out = []

    def go(start, v, s, path):
        if low <= len(path) and s in nfa.accepting and path:
            out.append((start, v, s, tuple(e[0] for e in path)))
        if len(path) == high:
            return
        for e in edges:
            if e[1] == v and not (trail and e in path):
                for f, t, label in nfa.transitions:
                    if f == s and label == e[3] and valid(path + [e]):
                        go(start, e[2], t, path + [e])

    for start in starts:
        for s in nfa.initial:
            go(start, start, s, [])
    return out


def rising(path):
    for a, b in zip(path, path[1:]):
        if a[4] is not None and (b[4] is None or b[4] <= a[4]):
            return False
    return True


def near(path):
    known = [e[4] for e in path if e[4] is not None]
    return path[0][4] is not None and max(known) - min(known) <= 1.0


def same(path):
    return rising([(0, 0, 0, 0, None)]) and all(a[5] is None or a[5] == b[5] for a, b in zip(path, path[1:]))


def graph(seed):
    r = random.Random(seed)
    n = r.randint(2, 5)
    return [(i + (1 << 33), r.randrange(n), r.randrange(n), r.choice("ab"), r.choice([None, 0.4, 0.6, 1.0, 1.4, 2.0]), r.choice([None, "x", "y"])) for i in range(r.randint(4, 9))]


AMBIGUOUS = Nfa(((0, 1, "a"), (0, 2, "a"), (1, 1, "b"), (2, 1, "b"), (4, 1, "b")), (0, 4), (1, 2))


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("name", ["rising", "near", "same", "free", "walk"])
def test_against_search(spark, seed, name):
    rows = graph(seed)
    edges = spark.createDataFrame(rows, SCHEMA)
    constraint, valid = {"rising": (monotonic("weight"), rising), "near": (range_bound("weight", 1.0), near), "same": (same_value("color"), same), "free": (None, lambda p: True), "walk": (None, lambda p: True)}[name]
    for nfa in (compile_regex("(a|b)+"), AMBIGUOUS):
        want = search(rows, nfa, [0, 1], 1, 3, valid, name != "walk")
        query = PathQuery(edges, nfa, [0, 1], 3, 1, constraint, "walk" if name == "walk" else "trail", collect=("edge_id",))
        got = sorted((r.start, r.end_node, r.nfa_state, tuple(r.edge_ids)) for r in query.paths().collect())
        assert got == sorted(want)


def test_grouped_pruned_and_plain_agree(spark):
    rows = [r[:4] + (float(i % 5),) + r[5:] for i, r in enumerate(graph(7))]
    edges = spark.createDataFrame(rows, SCHEMA)
    plain = PathQuery(edges, compile_regex("(a|b)+"), [0, 1], 4, 2, monotonic("weight"))
    counts = [sorted(map(tuple, q.by_length().collect())) for q in (plain, PathQuery(**{**plain.__dict__, "grouped": True}), PathQuery(**{**plain.__dict__, "pruned": True}))]
    assert counts[0] == counts[1] == counts[2]
    with pytest.raises(ValueError):
        PathQuery(edges, compile_regex("a"), [0], 2, grouped=True).paths()


def test_parallel_edges_and_loops(spark):
    edges = spark.createDataFrame([(0, 0, 1, "a", 1.0, "x"), (1, 0, 1, "a", 1.0, "x"), (2, 1, 1, "a", 2.0, "x")], SCHEMA)
    nfa = compile_regex("a+")
    trails = {r.path_length: r.n_paths for r in PathQuery(edges, nfa, [0], 3).by_length().collect()}
    walks = {r.path_length: r.n_paths for r in PathQuery(edges, nfa, [0], 3, semantics="walk").by_length().collect()}
    assert trails == {1: 2, 2: 2} and walks == {1: 2, 2: 2, 3: 2}
    assert PathQuery(edges, compile_regex("zzz"), [0], 3).count().first().n_paths == 0


def test_bounds_and_final(spark):
    edges = spark.createDataFrame([(0, 0, 1, "a", 0.0, "x"), (1, 1, 2, "a", 1296000.0, "x")], SCHEMA)
    nfa = compile_regex("a a")
    n = lambda c: PathQuery(edges, nfa, [0], 2, 2, c).count().first().n_paths
    assert n(range_bound("weight", 1296000)) == 1 and n(range_bound("weight", 1296000, False)) == 0
    assert n(adjacent_equal("color")) == 1
    assert n(all_of(adjacent_equal("color"), sum_at_least("weight", 1296001))) == 0


def test_python_constraints(spark):
    rows = graph(11)
    edges = spark.createDataFrame(rows, SCHEMA)
    nfa = compile_regex("(a|b)+")
    want = len(search(rows, nfa, [0], 1, 3, lambda p: True))
    ids = PyConstraint(list, lambda D, f, t, e: D + [e["edge_id"]], lambda D, f, t, e: e["edge_id"] not in D, columns=("edge_id", "weight"))
    late = naive(lambda D: len({e["edge_id"] for e in D}) == len(D), ("edge_id",))
    for c in (ids, late):
        assert PathQuery(edges, nfa, [0], 3, 1, c, "walk").count().first().n_paths == want


def test_list_functions(spark):
    df = spark.sql("select array(1.0, 2.0, 2.0) a, cast(array() as array<double>) b, array(1.0, null, 3.0) c, array('x', null, 'x') d")
    row = df.select(
        L.any_adjacent_equal(F.col("a")).alias("eq"), L.any_adjacent_equal(F.col("b")).alias("eq0"), L.strictly_increasing(F.col("a")).alias("up"),
        L.strictly_increasing(F.col("c")).alias("upc"), L.all_same(F.col("d")).alias("same"), L.total(F.col("b")).alias("sum0"), L.last(F.col("b")).alias("last0"),
        L.reduce_first(F.col("a"), lambda x, y: F.greatest(x, y)).alias("most"), L.reduce_first(F.col("b"), lambda x, y: x + y).alias("none"), L.is_trail(F.col("a")).alias("trail"),
    ).first()
    assert tuple(row) == (True, False, False, True, True, 0.0, None, 2.0, None, False)


def test_counted(spark):
    paths = spark.createDataFrame([(1, 2), (1, 3)], "path_length int, n bigint")
    assert counted(paths, "path_length").first().n_paths == 5


def test_trails_with_null_keys_repeat_no_edge(spark):
    edges = spark.createDataFrame([(5, 0, 0, "a", None, "x"), (6, 0, 0, "a", 1.0, "x")], SCHEMA)
    for grouped in (False, True):
        got = PathQuery(edges, compile_regex("a+"), [0], 4, 1, monotonic("weight"), grouped=grouped).by_length().collect()
        assert {r.path_length: r.n_paths for r in got} == {1: 2, 2: 1}


def test_python_values_are_exact(spark):
    """Integers beside nulls stay integers; checks must be boolean."""
    big = (1 << 53) + 1
    edges = spark.createDataFrame([(big, 0, 1, "a"), (None, 0, 1, "a"), (5, 1, 2, "a")], "edge_id bigint, src bigint, dst bigint, label string")
    seen = PyConstraint(lambda: {"ids": []}, lambda D, f, t, e: {"ids": [*D["ids"], e["edge_id"]]}, is_valid_final=lambda D: D["ids"] == [big, 5] and type(D["ids"][0]) is int, columns=("edge_id",))
    typed = PyConstraint(seen.init, seen.update, seen.is_valid, seen.is_valid_final, columns=seen.columns, state="ids array<bigint>")
    for c in (seen, typed):
        assert PathQuery(edges, compile_regex("a a"), [0], 2, 2, c, "walk").count().first().n_paths == 1
    bad = PyConstraint(dict, lambda D, f, t, e: D, lambda D, f, t, e: 1, columns=("edge_id",))
    with pytest.raises(Exception, match="must give True or False"):
        PathQuery(edges, compile_regex("a"), [0], 1, 1, bad, "walk").count().first()


def test_python_constraints_compose(spark):
    rows = [r[:4] + (float(i % 4),) + r[5:] for i, r in enumerate(graph(13))]
    edges = spark.createDataFrame(rows, SCHEMA)
    nfa = compile_regex("(a|b)+")
    up = PyConstraint(lambda: None, lambda D, f, t, e: e["weight"], lambda D, f, t, e: D is None or e["weight"] > D, columns=("weight",))
    few = PyConstraint(lambda: {"n": 0}, lambda D, f, t, e: {"n": D["n"] + 1}, is_valid_final=lambda D: D["n"] <= 2, finalize=lambda D: {"n": D["n"]}, state="n bigint")
    want = len([p for p in search(rows, nfa, [0, 1], 1, 3, rising) if len(p[3]) <= 2])
    for c in ((up, few, py_trail()), (monotonic("weight"), few)):
        assert PathQuery(edges, nfa, [0, 1], 3, 1, c, "walk").count().first().n_paths == want
    assert py_all_of(few, py_trail()).state == "p0 struct<n:bigint>, p1 struct<ids:array<bigint>>"
