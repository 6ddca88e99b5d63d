"""From raw documents to packed training sequences, in stages of the llm operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns
of documents, whatever they are beside doc_id, text and n_chars.

Stages judge rows, not ids: rows with null ids and rows that repeat an id with another
text are documents of their own. Rows that repeat id and text are judged alike, but the
third stage keeps one of them. Null and empty texts are neither toxic, repeated, near
copies nor leaks, and stay. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from waymark.llm import decontaminate, line_dedup, ngram_jaccard, packing, toxicity
from waymark.llm.common import cut, written
from waymark.llm.queries import TOXIC, table, toxicity_model, word_tokenizer


def unused(docs: DataFrame, name: str) -> str:
    """name, longer if docs has a column of that name."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier, fitted on docs' labelled rows, finds toxic."""
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    own = unused(docs, "toxicity")
    return toxicity.score(docs, model, into=own).where(F.col(own) < TOXIC).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without later occurrences of repeated lines, and of sentences and clauses in long lines; documents of which nothing is left go."""
    own = unused(docs, "removed")
    lines = line_dedup.dedup_passages(docs, into=own)
    was_cut = F.size(own) > 0
    left = lines.where(~was_cut | (F.trim("text", F.lit(line_dedup.BLANKS + "\n")) != ""))
    return left.withColumn("n_chars", F.when(was_cut, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def without_rows(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text (by th, its xxhash64) are in gone; null ids equal each other."""
    gone = gone.select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(F.col("gone_id")) & (F.xxhash64(docs.text) == F.col("gone_th")), "left_anti")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row (the smallest id, null last, then by text hash) of each group of near duplicates: five words, 80 percent.

    Of rows that repeat both id and text one stays; rows without words all stay.
    """
    groups = cut(ngram_jaccard.jaccard_groups(docs, k=5, t=80, with_kept=True))
    single = without_rows(docs, groups.where(~F.col("kept")))
    again = groups.where("kept and n_shingles > 0").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1")
    again = cut(again.select(F.col("doc_id").alias("again_id"), F.col("th").alias("again_th")))
    if again.isEmpty():
        return single
    same = single.doc_id.eqNullSafe(F.col("again_id")) & (F.xxhash64(single.text) == F.col("again_th"))
    marked = single.join(again, same, "left").select(*(single[c] for c in docs.columns), F.col("again_th").isNotNull().alias("repeated"))
    one = marked.where("repeated").withColumn("th", F.xxhash64("text")).dropDuplicates(["doc_id", "th"])
    return marked.where("not repeated").select(*docs.columns).unionByName(one.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without rows whose text holds a passage of the benchmark; other texts of the same id stay."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("key"), "text")
    return without_rows(docs, decontaminate.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="key").select("key.*"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 ids; workers that served other stages hold fewer words."""
    return packing.pack(docs, word_tokenizer(), eos=2, held=1 << 18)


STAGES = [
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what the last returns."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs


#: Fitted and similarity stages are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
