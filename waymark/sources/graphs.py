"""Graphs and automata from CSV files and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..plans.nfa import Nfa
from ..plans.query import kept

# Columns of the known files, of the preview, and of the edges that constraints see.
NODES = "id bigint, name string, label string"
SLIM = "edge_id bigint, src bigint, dst bigint, label string, weight double, color string"
WIDE = (
    "edge_id bigint, timestamp_ms bigint, hour_of_day bigint, src bigint, dst bigint, amount double, label string, "
    "location_region string, ip_prefix double, login_frequency bigint, session_duration bigint, "
    "purchase_pattern string, age_group string, risk_score double, anomaly string"
)
PREVIEW = ("edge_id", "src", "dst", "label", "amount", "risk_score", "anomaly")
JSON_COLUMNS = ("edge_id", "timestamp_ms", "src", "dst", "amount", "label", "location_region", "purchase_pattern", "age_group", "risk_score", "anomaly")


def text_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns that df has, cast; in the schema's order."""
    fields = [f.strip().split(" ") for f in schema.split(",")]
    return df.select(*(F.col(n).cast(t).alias(n) for n, t in fields if n in df.columns))


def read_nodes(spark: SparkSession, path: str, fill_label: bool = False) -> DataFrame:
    """(id, name[, label]) by header; without an id column, by position. fill_label: null labels become empty."""
    df = text_table(spark, path)
    if "id" not in df.columns:
        df = df.toDF(*(["name", "id"] if len(df.columns) == 2 else ["id", "name", "label"][: len(df.columns)]))
    df = shaped(df, NODES)
    return df.na.fill("", ["label"]) if fill_label and "label" in df.columns else df


def normalised(df: DataFrame) -> DataFrame:
    """Headers from, to as src, dst."""
    return df.withColumnsRenamed({"from": "src", "to": "dst"}) if {"from", "to"} <= set(df.columns) else df


def read_edges(spark: SparkSession, path: str, wide: bool = False, first_id: int = 0) -> DataFrame:
    """Slim or wide edges; a file's edge ids are kept, absent ones numbered from first_id in an order of all columns."""
    df = shaped(normalised(text_table(spark, path)), WIDE if wide else SLIM)
    return df if "edge_id" in df.columns else with_edge_ids(df, [c for c in df.columns], first_id)


def with_edge_ids(edges: DataFrame, order: list[str], first_id: int = 0) -> DataFrame:
    """edge_id: the row's number in the order of the given columns, dense from first_id.

    Rows are dealt by range, numbered in their partitions, and shifted by the sizes
    of those before, so that no task holds all.
    """
    dealt = kept(edges.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_shift"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(shift), "_part").withColumn("edge_id", F.col("_shift") + own - 1 + first_id).drop("_part", "_shift")


def read_nfa(spark: SparkSession, edges_path: str, states_path: str) -> Nfa:
    """An automaton from its two CSV files: from_state,to_state,label (or from,to,label, or by position) and id,type."""
    moves = text_table(spark, edges_path)
    if "from_state" not in moves.columns:
        moves = moves.toDF("from_state", "to_state", "label")
    rows = [(int(r.from_state), int(r.to_state), r.label) for r in moves.collect()]
    states = [(int(r.id), r.type) for r in shaped(text_table(spark, states_path), "id int, type string").collect()]
    return Nfa(tuple(rows), tuple(s for s, t in states if t == "initial"), tuple(s for s, t in states if t == "accepting"))


def write_nfa(spark: SparkSession, nfa: Nfa, edges_path: str, states_path: str) -> None:
    nfa.edges(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(edges_path)
    nfa.states(spark).coalesce(1).write.mode("overwrite").option("header", True).csv(states_path)


def edge_json(edges: DataFrame) -> DataFrame:
    """edges with edge_json: the known columns that are neither null nor NaN, and the names id, time and day for three of them."""
    kinds = dict(edges.dtypes)
    known = lambda c: F.when(~F.isnan(c), F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
    values = [known(c).alias(c) for c in JSON_COLUMNS if c in edges.columns]
    for alias, column in (("id", "edge_id"), ("time", "timestamp_ms"), ("day", "hour_of_day")):
        if column in edges.columns:
            values.append(F.col(column).alias(alias))
    return edges.withColumn("edge_json", F.to_json(F.struct(*values)))


def preview(edges: DataFrame, limit: int, columns: tuple[str, ...] = PREVIEW) -> DataFrame:
    """The first rows by edge id, of the preview columns that exist."""
    return edges.select(*(c for c in columns if c in edges.columns)).orderBy("edge_id").limit(limit)


def write_by_label(edges: DataFrame, path: str) -> None:
    """One folder a label, so that label filters prune files."""
    edges.repartition("label").write.mode("overwrite").partitionBy("label").parquet(path)


def read_label(spark: SparkSession, path: str, label: str) -> DataFrame:
    """The edges of one label from folders by label: no other folder is listed or read."""
    return spark.read.parquet(path).where(F.col("label") == label)


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """df, or ValueError if a key is null or repeated: the check that a primary key would make."""
    bad = df.groupBy(*keys).count().where("count > 1 or " + " or ".join(f"{k} is null" for k in keys)).limit(1).collect()
    if bad:
        raise ValueError(f"key {bad[0].asDict()} is null or repeated")
    return df


def handoff(events: DataFrame) -> DataFrame:
    """A graph of events: each hands over to the next event's user, in the order of (ts, event_id).

    The next row is found within ranges of that order; a range's last row takes the
    first of the next range, of which there is one a partition.
    """
    base = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", "props")
    dealt = kept(base.repartitionByRange("ts", "event_id").withColumn("_part", F.spark_partition_id()))
    order = Window.partitionBy("_part").orderBy("ts", "event_id")
    firsts = dealt.groupBy("_part").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("_user"))
    following = firsts.select("_part", F.lead("_user").over(Window.orderBy("_part")).alias("_next"))
    rows = dealt.withColumn("_lead", F.lead("user_id").over(order)).withColumn("_last", F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("ts"), F.desc("event_id"))) == 1)
    dst = F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead"))
    millis = F.unix_millis("ts")
    return (
        rows.join(F.broadcast(following), "_part")
        .select(
            F.col("event_id").alias("edge_id"),
            F.col("user_id").alias("src"),
            dst.alias("dst"),
            F.col("event_type").alias("label"),
            F.col("value").alias("amount"),
            F.least("value", F.lit(100.0)).alias("risk_score"),
            millis.alias("timestamp_ms"),
            F.expr("unix_millis(ts) div 1000").alias("weight"),
            F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        )
        .where("dst is not null")
        .withColumn("color", F.col("k") % 8)
        .withColumn("region", F.col("k") % 4)
    )
