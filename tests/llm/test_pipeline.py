"""The pipeline and the registered queries."""

import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
import corpus_pipeline
from test_operators import DOCS, reference_ids, words
from waymark.llm import queries, toxicity

SF = "/root/testdata/sf0.001"


def tables(spark, folder):
    r = random.Random(10)
    items = {i: " ".join(words(r, 20, 3000)) for i in range(5)}
    boiler = "\n".join(" ".join(words(r, 8, 3000)) for _ in range(3))
    docs, labels = {}, []
    for i in range(150):
        lines = [" ".join(words(r, 12, 3000)) for _ in range(5)]
        if i % 5 == 0:
            lines[2:2] = boiler.split("\n")
        if i % 11 == 0:
            lines.append(items[i % 5])
        if i % 4 == 0:
            lines[1] += " vileword"
        docs[i] = "\n".join(lines)
        labels.append((i, 1, int(i % 4 == 0)))
    docs |= {200: docs[1], 201: docs[2].replace("\n", " ") + " tail", 202: docs[2].replace("\n", " "), 203: "", 204: None}
    spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in docs.items()], DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(items.items()), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    docs, items = tables(spark, str(tmp_path))
    own = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = queries.toxicity_model(own, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    civil = {r.doc_id for r in toxicity.score(own, model).where(F.col("score") < queries.TOXIC).collect()}
    assert civil == {d for d in docs if "vileword" not in (docs[d] or "")}
    cut = brute.dedup_lines({d: docs[d] for d in civil})
    left = {d: t for d, (t, gone) in cut.items() if not gone or t.strip()}
    groups = brute.groups(left, 5, 80)
    single = {d: t for d, t in left.items() if groups[d][1] == d}
    assert len(civil) > len(left) > len(single)
    leaks = {d for d, _ in brute.leaks(single, items)}
    want = {d: t for d, t in single.items() if d not in leaks}
    assert leaks
    covered = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        covered.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    assert {d: sum(x[1] for x in c) for d, c in covered.items()} == {d: len(reference_ids(t)) for d, t in want.items()}


def test_stages_keep_columns(spark, tmp_path):
    tables(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_rows_of_null_and_repeated_ids_are_judged_each(spark, tmp_path):
    r = random.Random(14)
    own = [" ".join(words(r, 60, 3000)) for _ in range(6)]
    rows = [(1, own[0]), (None, own[0] + " more"), (None, own[1]), (None, own[2]), (None, own[2] + " more"), (7, own[3]), (7, own[3]), (7, own[4]), (None, own[5]), (None, own[5]), (8, ""), (8, ""), (None, None)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()]
    key = lambda x: (str(x[0]), str(x[1]))
    (other,) = [x for x in got if x[0] is None and x[1] and x[1].startswith(own[2])]
    want = [(1, own[0]), (None, own[1]), other, (7, own[3]), (7, own[4]), (None, own[5]), (8, ""), (8, ""), (None, None)]
    assert sorted(got, key=key) == sorted(want, key=key)

    passage = " ".join(words(r, 20, 3000))
    spark.createDataFrame([(0, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, own[0]), (None, f"{own[1]} {passage}"), (3, own[2]), (3, passage), (4, own[3]), (4, own[3]), (None, None), (None, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS).repartition(3)
    got = [(x.doc_id, x.text) for x in corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted((x for x in rows if passage not in (x[1] or "")), key=key)


def test_a_passage_inside_lines_is_cut(spark):
    r = random.Random(13)
    passage = " ".join(" ".join(words(r, 12, 3000)) + "." for _ in range(5))
    docs = [(1, f"One start is here. {passage} One end."), (2, f"Another start here. {passage} Another end.")]
    own = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], DOCS)
    got = {d.doc_id: (d.text, d.n_chars) for d in corpus_pipeline.drop_repeated_lines(spark, own, "").collect()}
    assert got == {1: (docs[0][1], len(docs[0][1])), 2: ("Another start here. Another end.", 32)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_agrees(spark, name):
    got = queries.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(queries.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, map(tuple, got.select(*columns).collect()))) == sorted(map(str, want.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name,columns", [("op5_quality", 4), ("op6_toxicity", 4), ("op9_language_id", 4)])
def test_every_document_is_scored(spark, name, columns):
    got = queries.QUERIES[name](spark, SF)
    assert len(got.columns) == columns and got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert got.where("score is null or score < 0 or score > 1 or held_out is null").count() == 0


def test_columns_of_the_operators_names_stay(spark, tmp_path):
    tables(spark, str(tmp_path / "plain"))
    docs = spark.read.parquet(f"{tmp_path}/plain/documents.parquet").select("*", F.lit(0.77).alias("score"), F.lit("mine").alias("removed"), F.lit(1).alias("th"), F.lit(2).alias("toxicity"))
    whole = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, f"{tmp_path}/plain")
        assert docs.columns == whole.columns, name
    assert docs.select("score", "removed", "th", "toxicity").distinct().collect() == [(0.77, "mine", 1, 2)]


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path / "plain"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/plain/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_nulls_and_repeated_rows_through_all_stages(spark, tmp_path):
    """Rows that no stage objects to all come out packed, whatever their ids."""
    tables(spark, str(tmp_path / "plain"))
    r = random.Random(15)
    own = [" ".join(words(r, 50, 5000)) for _ in range(6)]
    rows = [(None, own[0]), (None, own[1]), (3, own[2]), (3, own[3]), (4, own[4]), (4, own[4]), (5, ""), (None, None), (None, own[5] + " vileword"), (6, own[0] + " vileword")]
    extra = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS)
    base = spark.read.parquet(f"{tmp_path}/plain/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/plain/{name}.parquet").write.parquet(f"{tmp_path}/more/{name}.parquet")
    base.where("doc_id < 150").withColumn("doc_id", F.col("doc_id") + 1000).unionByName(extra).write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.read.parquet(f"{tmp_path}/plain/labels.parquet").withColumn("doc_id", F.col("doc_id") + 1000).write.mode("overwrite").parquet(f"{tmp_path}/more/labels.parquet")
    found = corpus_pipeline.run(spark, f"{tmp_path}/more").where("doc_id is null or doc_id < 1000").collect()
    want = [(None, own[0]), (None, own[1]), (3, own[2]), (3, own[3]), (4, own[4]), (5, ""), (None, "")]
    key = lambda x: (str(x[0]), x[1])
    assert sorted(((x.doc_id, x.doc_tokens) for x in found), key=key) == sorted(((d, len(reference_ids(t))) for d, t in want), key=key)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_packing_and_output_of_the_tables(spark):
    """op4 and op8 over whole tables: every id of every document once, in its place."""
    docs = {r.doc_id: reference_ids(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    covered, filled = {}, {}
    for r in queries.QUERIES["op4_packing"](spark, SF).collect():
        own = np.array(docs[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(own), zlib.crc32(own.tobytes()), len(docs[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
        covered.setdefault(r.doc_id, []).append((r.start, r.length))
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces, whole in [(covered, {d: len(x) for d, x in docs.items()}), (filled, {})]:
        for k, own in pieces.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at == whole.get(k, at) and (pieces is covered or at <= 4096)
    assert covered.keys() == docs.keys()
    seen = {}
    for r in queries.QUERIES["op8_token_output"](spark, SF).collect():
        ids = []
        for d, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens, r.cu_seqlens[1:]):
            ids += docs[d][start : start + b - a]
            seen.setdefault(d, []).append((start, b - a))
        places = [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
        pad = 4096 - len(ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids + [0] * pad, "<u2").tobytes()) and r.positions_crc32 == zlib.crc32(np.array(places + [0] * pad, "<u4").tobytes())
    assert {d: sum(n for _, n in x) for d, x in seen.items()} == {d: len(x) for d, x in docs.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
def test_pipeline_of_the_tables(spark):
    """Each stage on its own input by the plain versions, and every kept document packed once."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    civil = corpus_pipeline.keep_civil(spark, docs, SF).cache()
    left = corpus_pipeline.drop_repeated_lines(spark, civil, SF).cache()
    single = corpus_pipeline.keep_one_of_each_group(spark, left, SF).cache()
    clean = corpus_pipeline.drop_leaks(spark, single, SF).cache()
    text = lambda df: {r.doc_id: r.text for r in df.collect()}
    groups = brute.groups(text(left), 5, 80)
    assert text(single) == {d: t for d, t in text(left).items() if groups[d][1] == d or not groups[d][0]}
    gone = {d for d, _ in brute.leaks({d: t for d, t in text(single).items() if d not in text(clean) or d % 8 == 0}, items)}
    assert text(single).keys() - text(clean).keys() <= gone and not gone & text(clean).keys()
    packed = {}
    for r in corpus_pipeline.run(spark, SF).collect():
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert packed == {d: len(reference_ids(t)) for d, t in text(clean).items()}
