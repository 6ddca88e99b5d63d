"""Sequence packing by shortest-pack-first over the length histogram."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import cut, lean, small_batches
from .tokens import HELD, documents

PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, chunk long, nth long"
ROWS = 4096


@lean("encoder")
def pieces(batches, tokenizer: str, eos: int | None, words: bool, size: int, held: int):
    """Each document's ids, cut every size ids; nth counts equal lengths within the task."""
    chunk, seen, rows = TaskContext.get().partitionId(), Counter(), []
    schema = pa.schema([(n, pa.int64()) for n in ("id", "start", "length", "ids_crc32", "doc_tokens", "chunk", "nth")])
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=schema)
    for name, ids in documents(batches, tokenizer, eos, words, held):
        total = len(ids) // 4
        for start in range(0, total, size):
            own = ids[4 * start : 4 * (start + size)]
            rows.append((name, start, len(own) // 4, zlib.crc32(own), total, chunk, seen[len(own) // 4]))
            seen[len(own) // 4] += 1
        if len(rows) >= ROWS:
            yield batch_of(rows)
            rows = []
    if rows:
        yield batch_of(rows)


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Packing patterns as (count, [(length, times), ...]) for all pieces of histogram.

    Lengths are placed longest first, each into the shortest pack (the one with
    most room) while one has room; otherwise new packs open, with as many pieces
    of the length as fit. Packs with the same pattern are held as one count.
    """
    room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}

    def put(count: int, pattern: list, space: int) -> None:
        if count:
            room.setdefault(space, []).append((count, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            space = max((r for r in room if r >= length), default=0)
            if not space:
                times = size // length
                put(n // times, [(length, times)], size - times * length)
                put(n % times > 0, [(length, n % times)], size - n % times * length)
                break
            count, pattern = room[space].pop()
            if not room[space]:
                del room[space]
            used = min(n, count)
            put(count - used, pattern, space)
            last = pattern[-1]
            more = [*pattern[:-1], (length, last[1] + 1)] if last[0] == length else [*pattern, (length, 1)]
            put(used, more, space - length)
            n -= used
    return [x for packs in room.values() for x in packs]


def intervals(patterns: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, times, first sequence, offset), sorted: which ranks of a length go where."""
    rows, base, rank = [], 0, Counter()
    for count, pattern in patterns:
        offset = 0
        for length, times in pattern:
            rows.append((length, rank[length], times, base, offset))
            rank[length] += count * times
            offset += length * times
        base += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(batches, table: np.ndarray, names: list[str]):
    keys = (table[:, 0] << 44) + table[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy()
        rank = batch.column("rank").to_numpy()
        own = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
        at = rank - own[:, 1]
        found = {"sequence_id": own[:, 3] + at // own[:, 2], "offset": own[:, 4] + at % own[:, 2] * length}
        yield pa.RecordBatch.from_arrays([pa.array(found[n]) if n in found else batch.column(n) for n in names], names=names)


def pack(docs: DataFrame, tokenizer: str, eos: int | None = None, size: int = 4096, id_col: str = "doc_id", text_col: str = "text", words: bool = True, held: int = HELD) -> DataFrame:
    """Packs the token ids of all rows of docs into sequences of at most size ids.

    Returns a row per piece: id_col, start, length, ids_crc32 (little-endian
    unsigned 32-bit ids), doc_tokens, sequence_id, offset. A null text is empty;
    a document is its ids and eos, cut every size ids; documents without any id
    (no eos) give no row. Repeated rows and null ids are packed like any others,
    each on its own. Empty tables give no rows. Ids must cast to long; other columns
    are not read; a text is encoded whole, in memory of some ten bytes for each of
    its own.

    tokenizer: a tokenizers file, at the same path on all executors; words and
    held: see Encoder. Texts are read once; a piece keeps its number among its task's
    pieces of the same length, and sums of counts by (task, length) make that a
    rank over all. The histogram (size numbers at most) is all the driver sees;
    the patterns' intervals go out to the tasks, fewer than 2 * size patterns of
    sqrt(2 * size) lengths each.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cuts = cut(rows.mapInArrow(lambda it: pieces(it, tokenizer, eos, words, size, held), PIECES))
    counts = cut(cuts.groupBy("chunk", "length").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = intervals(shortest_pack_first(histogram, size))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("chunk", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cuts.join(offsets, ["chunk", "length"]).select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("rank"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    placed = ranked.mapInArrow(lambda it: place(it, table, names), ", ".join(f"{n} long" for n in names))
    return placed.withColumnRenamed("id", id_col)
