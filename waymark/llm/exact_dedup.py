"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut, shuffle_partitions

#: Digests that may be broadcast, at most: 32 bytes and two numbers each.
WINNERS = 4096


def misra_gries(batches, column: str, counters: int):
    """One summary of counters digests per task: (digest, count), each count short by rows / counters at most."""
    held: Counter = Counter()
    for batch in batches:
        held.update(batch.column(column).to_pylist())
        if len(held) > counters:
            off = sorted(held.values(), reverse=True)[counters]
            held = Counter({d: n - off for d, n in held.items() if n > off})
    yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "n": pa.array(list(held.values()), pa.int64())})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int | None = None) -> DataFrame:
    """One row per row of docs, saying which row of each group of equal texts stays.

    Returns id_col, keep_id, group_size, kept, text_sha256. Null texts count as
    empty; texts are equal when identical. The row with the largest id stays
    (a null id is smaller than any); of rows that repeat text and id, exactly
    one is kept. Empty input gives no rows; further columns are not read.

    Digests are computed once and kept. Misra-Gries summaries, one per task,
    name digests that may hold more than rows / counters rows; their exact counts
    and winners are verified with partial aggregation and broadcast (WINNERS at
    most), so frequent groups never shuffle. All other groups hold at most about
    rows / counters rows (a share of a shuffle partition while there are fewer
    than WINNERS / 1.5 of these), and meet in an ordinary window, which can spill.
    Ids must cast to long.
    """
    n = shuffle_partitions(docs)
    counters = counters or min(WINNERS, max(1024, 4 * n))
    digests = cut(docs.select(F.col(id_col).cast("long").alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")).withColumn("rid", F.monotonically_increasing_id()))
    rows = digests.count()
    named = digests.select("digest").mapInArrow(lambda it: misra_gries(it, "digest", counters), "digest binary, n long")
    named = named.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > max(1, rows // (2 * counters)))
    named = named.orderBy(F.desc("n"), "digest").limit(WINNERS).select("digest")
    frequent = F.broadcast(cut(named))
    winner = [F.max(F.struct("id", "rid")).alias("w"), F.count("*").alias("group_size")]
    verified = cut(digests.join(frequent, "digest", "left_semi").groupBy("digest").agg(*winner))
    heavy = digests.join(F.broadcast(verified), "digest")
    w = Window.partitionBy("digest")
    light = digests.join(F.broadcast(verified.select("digest")), "digest", "left_anti")
    light = light.repartition(n, "digest").select("*", *(x.over(w).alias(k) for x, k in ((F.max(F.struct("id", "rid")), "w"), (F.count("*"), "group_size"))))
    columns = [F.col("id").alias(id_col), F.col("w.id").alias("keep_id"), "group_size", (F.col("rid") == F.col("w.rid")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")]
    return heavy.select(columns).unionByName(light.select(columns))
