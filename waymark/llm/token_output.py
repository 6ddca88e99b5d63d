"""Packed token-id matrices by best-fit-decreasing with a segment tree."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import small_batches
from .tokens import HELD, documents

SEQUENCES = "block long, sequence long, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, position_ids binary"


class Capacities:
    """Open sequences by remaining room: a segment tree over room finds the tightest that fits in O(log size)."""

    def __init__(self, size: int) -> None:
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self.change(room, 1)

    def change(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the least room of need at least."""
        count, at = self.count, self.leaves + need
        if not count[at]:
            while at > 1 and (at & 1 or not count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self.change(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Indexes of the pieces in each sequence; pieces of size at most."""
    rooms, out = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        found = rooms.take(lengths[i])
        room, sequence = found or (size, len(out))
        if not found:
            out.append([])
        out[sequence].append(i)
        if room > lengths[i]:
            rooms.add(room - lengths[i], sequence)
    return out


def block_rows(block: int, held: list[tuple], size: int, kind: np.dtype, pad: int):
    """The sequences of one block: padded ids and position resets, and where its documents' pieces lie."""
    for k, members in enumerate(best_fit_decreasing([len(p[2]) for p in held], size)):
        ids, positions = np.full(size, pad, kind), np.zeros(size, "<u4")
        ends = np.cumsum([0, *(len(held[i][2]) for i in members)]).tolist()
        for i, a, b in zip(members, ends, ends[1:]):
            ids[a:b] = held[i][2]
            positions[a:b] = np.arange(b - a)
        yield block, k, [held[i][0] for i in members], [held[i][1] for i in members], ends, ids.tobytes(), positions.tobytes()


def sequences(batches, tokenizer: str, eos: int | None, words: bool, size: int, kind: str, pad: int, block_tokens: int):
    schema = pa.schema([("block", pa.int64()), ("sequence", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("cu_seqlens", pa.list_(pa.int32())), ("ids", pa.binary()), ("position_ids", pa.binary())])
    task, blocks = TaskContext.get().partitionId(), 0
    held: list[tuple] = []
    tokens = 0

    def packed():
        rows = list(block_rows((task << 32) + blocks, held, size, np.dtype(kind), pad))
        for at in range(0, len(rows), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[at : at + 256]), schema)], schema=schema)

    for name, raw in documents(batches, tokenizer, eos, words, HELD):
        ids = np.frombuffer(raw, "<u4")
        if len(ids) and ids.max() > np.iinfo(kind).max:
            raise ValueError(f"an id above {np.iinfo(kind).max} does not fit {kind}")
        for start in range(0, len(ids), size):
            held.append((name, start, ids[start : start + size].astype(kind)))
            tokens += len(held[-1][2])
            if tokens >= block_tokens:
                yield from packed()
                held, tokens, blocks = [], 0, blocks + 1
    if held:
        yield from packed()


def packed_sequences(docs: DataFrame, tokenizer: str, eos: int | None = None, size: int = 4096, kind: str = "<u2", pad: int = 0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = 1 << 21, words: bool = True) -> DataFrame:
    """The token ids of all rows of docs as rows of packed matrices.

    Returns a row per sequence: block and sequence (its place in the block's
    matrix), doc_ids and starts (which documents' pieces lie in it, and each
    piece's first id in its document), cu_seqlens (0 and the pieces' ends), ids
    (size numbers of type kind, padded) and position_ids (size little-endian
    unsigned 32-bit numbers that restart at each piece; 0 in the padding).

    Documents longer than size are cut every size ids without loss. A null text
    is empty; a document without ids gives nothing. Repeated rows and null ids
    are packed each. Ids that kind can't hold raise ValueError.

    Tasks pack blocks of about block_tokens ids as they read, so there is no
    shuffle and memory is bounded (by the longest text beside that). A block number
    holds the task's number. Over files a task that runs again gives the same rows;
    docs whose rows can come in another order then (after a shuffle) should be
    written first, lest blocks of two runs mix. Ids must cast to long; other
    columns are not read.
    """
    from pyspark.sql import functions as F

    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: sequences(it, tokenizer, eos, words, size, kind, pad, block_tokens), SEQUENCES)


def write(packed: DataFrame, path: str) -> None:
    """Writes packed sequences as Parquet: any store that Spark can write, each block's rows in one file."""
    packed.write.parquet(path)


def matrix(packed: DataFrame, block: int, kind: str = "<u2") -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """One block read back: the id matrix, the position matrix, and cu_seqlens of each row."""
    rows = packed.where(packed.block == block).orderBy("sequence").collect()
    return np.stack([np.frombuffer(r.ids, kind) for r in rows]), np.stack([np.frombuffer(r.position_ids, "<u4") for r in rows]), [r.cu_seqlens for r in rows]
