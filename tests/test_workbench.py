import time

import pytest

from waymark import cli, harness, workbench
from waymark.plans.nfa import compile_regex

SCHEMA = "edge_id bigint, src bigint, dst bigint, label string, weight double, color string"


def test_generate_nfa():
    got = workbench.generate_nfa("purchase+")
    assert got["nodes"] == [{"id": 0, "type": "initial"}, {"id": 1, "type": "accepting"}]
    assert {"from_state": 1, "to_state": 1, "label": "purchase"} in got["edges"]


def test_run(spark):
    edges = spark.createDataFrame([(0, 1, 2, "a", 1.0, "x"), (1, 2, 3, "a", 2.0, "x"), (2, 2, 3, "a", 0.5, "y"), (3, 3, 1, "a", None, None)], SCHEMA)
    late = {"is_viable_d_final": lambda D: all(x["weight"] < y["weight"] for x, y in zip(D, D[1:]))}
    row = workbench.run(edges, "a+", 1, 1, 2, "naive", late, ("weight",)).first()
    assert tuple(row) == (1, 1, 2, 2)
    assert workbench.message(row) == "Number of paths [1, 2] from 1 are: 2"
    sums = {"init_d": lambda: {"w": 0}, "update_d": lambda D, f, t, e: {"w": D["w"] + (e["weight"] or 0)}, "is_viable_d": lambda D, f, t, e: e["weight"] is not None, "finalize_d": lambda D: D["w"], "is_viable_d_final": lambda D: D >= 1.5}
    assert workbench.run(edges, "a+", 1, 1, 3, "advanced", sums, ("weight",)).first().n_paths == 2
    with pytest.raises(ValueError):
        workbench.run(edges, "a", 1, 1, 1, "other", {}, ())


def test_cli(spark, tmp_path, capsys):
    files = {"edges": "src,dst,label,weight,color\n1,2,e,1,a\n2,3,e,2,a\n2,3,e,0.5,b\n", "nodes": "id,name,label\n1,a,\n2,b,\n3,c,\n", "nfa": "from,to,label\n0,0,e\n", "nfanodes": "id,type\n0,initial\n0,accepting\n"}
    args = []
    for name, text in files.items():
        (tmp_path / name).write_text(text)
        args += [f"--{name}", str(tmp_path / name)]
    for query, want in (("monotonic", 1), ("two-color", 1), ("max-min", 2), ("walk", 2)):
        assert cli.main([*args, "--query", query, "--start", "1", "--max-length", "2"]) == [want]
    assert "paths of length [2, 2]" in capsys.readouterr().out


def test_scaffold_runs():
    own: dict = {}
    exec(workbench.scaffold(compile_regex("(a | b) c+")), own)
    text = workbench.scaffold("a+")
    assert "case (0, 1):  # a" in text and "case (1, 1):  # a" in text
    assert own["is_viable_d"](1, 0, 1, {}) is True and own["update_d"]("D", 2, 3, {}) == "D"


def test_dry_run():
    sums = {"init_d": lambda: 0, "update_d": lambda D, f, t, e: D + e["weight"], "is_viable_d": lambda D, f, t, e: e["weight"] > 0, "finalize_d": lambda D: -D, "is_viable_d_final": lambda D: D == -3}
    edges, moves = [{"weight": 1}, {"weight": 2}, {"weight": 0}, {"weight": 9}], [(0, 1), (1, 1), (1, 1), (1, 1)]
    assert workbench.dry_run(sums, edges, moves) == {"steps": 2, "state": -3, "accepted": True}
    for name in ("is_viable_d", "is_viable_d_final"):
        with pytest.raises(TypeError, match=name):
            workbench.dry_run(sums | {name: lambda *a: None}, edges, moves)


def test_sweep_stops(spark):
    got = harness.sweep(spark, lambda n: max(0, 3 - n), range(1, 9), warmups=0, runs=2)
    assert [(n, t.result) for n, t in got] == [(1, 2), (2, 1), (3, 0)] and len(got[0][1].seconds) == 2
    assert set(got[0][1].summary) == {"avg", "min", "max", "median"}
    slow = lambda n: spark.range(4, numPartitions=4).rdd.map(lambda x: time.sleep(30) or 1).sum() if n > 1 else 1
    began = time.perf_counter()
    assert [t is None for _, t in harness.sweep(spark, slow, (1, 2, 3), warmups=0, runs=1, limit=2)] == [False, True]
    assert time.perf_counter() - began < 25 and spark.range(3).count() == 3
