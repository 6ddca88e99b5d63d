import json

import pytest

from waymark.plans.nfa import compile_regex
from waymark.sources import graphs as G


def write(path, text):
    path.write_text(text)
    return str(path)


def test_nodes(spark, tmp_path):
    three = G.read_nodes(spark, write(tmp_path / "n.csv", "id,name,label\n70,a,Start\n71,b,\n"), fill_label=True)
    assert [tuple(r) for r in three.orderBy("id").collect()] == [(70, "a", "Start"), (71, "b", "")]
    two = G.read_nodes(spark, write(tmp_path / "v.csv", "id,name\n1,one\n"))
    assert tuple(two.first()) == (1, "one")
    bare = G.read_nodes(spark, write(tmp_path / "w.csv", "x,y\none,1\n"))
    assert tuple(bare.first()) == (1, "one")


def test_edges(spark, tmp_path):
    slim = G.read_edges(spark, write(tmp_path / "e.csv", "from,to,label,weight,color\n2,3,e,1.5,red\n1,3,e,1,magenta\n"))
    assert sorted((r.edge_id, r.src, r.dst, r.weight) for r in slim.collect()) == [(0, 1, 3, 1.0), (1, 2, 3, 1.5)]
    kept = G.read_edges(spark, write(tmp_path / "k.csv", "edge_id,src,dst,label,weight,color\n8589934592,1,2,e,,\n"))
    assert tuple(kept.first()) == (8589934592, 1, 2, "e", None, None)
    wide = G.read_edges(spark, write(tmp_path / "x.csv", "edge_id,timestamp_ms,src,dst,amount,label,risk_score\n5,99,1,2,3.5,sale,\n"), wide=True)
    assert wide.first().amount == 3.5
    row = json.loads(G.edge_json(wide).first().edge_json)
    assert row["id"] == 5 and row["time"] == 99 and "risk_score" not in row
    assert G.preview(wide, 1).columns == ["edge_id", "src", "dst", "label", "amount", "risk_score"]


def test_nfa_round_trip(spark, tmp_path):
    nfa = compile_regex("a+ b")
    G.write_nfa(spark, nfa, str(tmp_path / "m"), str(tmp_path / "s"))
    back = G.read_nfa(spark, str(tmp_path / "m"), str(tmp_path / "s"))
    assert sorted(back.transitions) == sorted(nfa.transitions) and back.initial == nfa.initial and back.accepting == nfa.accepting
    named = G.read_nfa(spark, write(tmp_path / "f.csv", "from,to,label\n0,0,e\n"), write(tmp_path / "t.csv", "id,type\n0,initial\n0,accepting\n"))
    assert named.transitions == ((0, 0, "e"),) and named.initial == named.accepting == (0,)


def test_by_label_and_keys(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2, "a"), (1, 1, 2, "b")], "edge_id bigint, src bigint, dst bigint, label string")
    G.write_by_label(edges, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).where("label = 'a'").count() == 1
    assert G.assert_unique(edges, "edge_id") is edges
    with pytest.raises(ValueError):
        G.assert_unique(edges, "src")


def test_json_leaves_out_nan_and_null(spark):
    edges = spark.createDataFrame([(1, 2, 3, "a", float("nan"), None), (2, 2, 3, "a", 1.5, 2.5)], "edge_id bigint, src bigint, dst bigint, label string, amount double, risk_score double")
    found = [json.loads(r.edge_json) for r in G.edge_json(edges).orderBy("edge_id").collect()]
    assert "amount" not in found[0] and "risk_score" not in found[0] and (found[1]["amount"], found[1]["risk_score"]) == (1.5, 2.5)


def test_one_label_reads_one_folder(spark, tmp_path):
    edges = spark.createDataFrame([(0, 1, 2, "a"), (1, 1, 2, "b"), (2, 4, 2, "b")], "edge_id bigint, src bigint, dst bigint, label string")
    G.write_by_label(edges, str(tmp_path / "p"))
    own = G.read_label(spark, str(tmp_path / "p"), "b")
    assert own.count() == 2 and "PartitionFilters: [isnotnull(label" in own._jdf.queryExecution().toString()
