"""Quality scores: random Fourier features, ridge regression, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, Words, chunks, cut, kept, shipped, small_batches, text_bytes

#: Random features, and the ridge penalty (of each row's unit of fit).
FEATURES = 192
RIDGE = 1e-3

#: Bins of raw scores that the isotonic fit sees, over LOW to HIGH.
BINS = 512
LOW, HIGH = -0.5, 1.5

NAMES = (
    "bytes", "words", "word_bytes", "upper", "digits", "marks", "symbols", "high_bytes", "blanks", "lines", "line_bytes",
    "distinct", "repeats", "top_line", "ends_marked", "single", "long_words", "bars", "shouts", "capitalised",
)


def byte_class(chars: str) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars.encode())] = 1
    return out


CLASSES = {
    "upper": byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "digits": byte_class("0123456789"),
    "marks": byte_class(".,;:?'\"()-"),
    "symbols": byte_class("#$%&*+/<=>@[\\]^_`{}~"),
    "blanks": byte_class(" \t\r\n"),
    "bars": byte_class("|"),
    "shouts": byte_class("!"),
}


def per_row(values: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(row, values, minlength=n)


def statistics(texts: pa.Array) -> np.ndarray:
    """len(NAMES) numbers of each text: sizes (as logarithms), shares of kinds of bytes, words and lines, and repetition."""
    n = len(texts)
    data, rows = text_bytes(texts)
    size = np.diff(rows)
    own = np.maximum(size, 1)
    row = np.repeat(np.arange(n), size)
    kinds = np.bincount(row * 256 + data, minlength=256 * n).reshape(n, 256) if len(data) else np.zeros((n, 256))
    out = {k: kinds @ v / own for k, v in CLASSES.items()}
    out["high_bytes"] = kinds[:, 128:].sum(1) / own
    words, starts, ends, first = kept("words", Words)(texts)
    count = np.diff(first)
    some = np.maximum(count, 1)
    of = np.repeat(np.arange(n), count)
    length = ends - starts
    out["bytes"], out["words"] = np.log1p(size), np.log1p(count)
    out["word_bytes"] = np.log1p(per_row(length, of, n) / some)
    out["long_words"] = per_row(length > 20, of, n) / some
    out["single"] = per_row(length == 1, of, n) / some
    same = np.concatenate([[False], (words[1:] == words[:-1]) & (of[1:] == of[:-1])]) if len(words) else np.zeros(0, bool)
    out["repeats"] = per_row(same, of, n) / some
    out["distinct"] = np.array([len(np.unique(words[a:b])) for a, b in zip(first, first[1:])]) / some
    if len(words):
        last, head = data[ends - 1], data[starts]
        out["ends_marked"] = per_row(np.isin(last, list(b".,;:!?|")), of, n) / some
        out["capitalised"] = per_row(CLASSES["upper"][head], of, n) / some
    else:
        out["ends_marked"] = out["capitalised"] = np.zeros(n)
    lines, _, _, begin = kept("lines", lambda: Words(b"\n"))(texts)
    many = np.diff(begin)
    out["lines"] = np.log1p(many)
    out["line_bytes"] = np.log1p(size / np.maximum(many, 1))
    out["top_line"] = 1 - np.array([len(np.unique(lines[a:b])) for a, b in zip(begin, begin[1:])]) / np.maximum(many, 1)
    return np.stack([out[k] for k in NAMES], 1).astype(np.float32) if n else np.zeros((0, len(NAMES)), np.float32)


def describe(batches):
    """(id, stats) of each row."""
    for batch, texts in chunks(batches, size=CHUNK_BYTES):
        values = statistics(texts)
        stats = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(NAMES)), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("id"), stats], names=["id", "stats"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    points: np.ndarray
    heights: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """cos(x . direction + phase): products approach a Gaussian kernel of the standardised statistics."""
        x = np.clip((stats - self.mean) / self.spread, -5, 5)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(stats), self.points, self.heights)


def stats_of(batch) -> np.ndarray:
    column = batch.column("stats")
    return column.flatten().to_numpy().reshape(len(column), -1).astype(np.float64)


def moments(batches):
    """Sums of the statistics and their squares, and the number of rows."""
    total = np.zeros(2 * len(NAMES) + 1)
    for batch in batches:
        x = stats_of(batch)
        total += np.concatenate([x.sum(0), (x**2).sum(0), [len(x)]])
    yield sums(total)


def sums(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array(np.arange(values.size, dtype=np.int32)), "v": pa.array(values.ravel())})


def normal_equations(batches, model: Model):
    """This task's sum of z z' and z y."""
    d = len(model.phases) + 1
    total = np.zeros((d, d + 1))
    for batch in batches:
        z = model.features(stats_of(batch))
        total += z.T @ np.hstack([z, batch.column("label").to_numpy().astype(float)[:, None]])
    yield sums(total)


def binned(batches, model: Model):
    """Rows and ones of each bin of raw scores."""
    total = np.zeros((BINS, 2))
    for batch in batches:
        at = np.clip(((model.raw(stats_of(batch)) - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
        y = batch.column("label").to_numpy().astype(float)
        total[:, 0] += np.bincount(at, minlength=BINS)
        total[:, 1] += np.bincount(at, y, minlength=BINS)
    yield sums(total)


def summed(df: DataFrame, f, size: int) -> np.ndarray:
    """f's rows (k, v) of all tasks, added up by k."""
    # each task gives size rows, so there are fewer tasks than partitions
    found = df.coalesce(max(64, df.rdd.getNumPartitions() // 16)).mapInArrow(f, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(size)
    out[found["k"].to_numpy()] = found["v"].to_numpy()
    return out


def isotonic(counts: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the bins' centres and their non-decreasing shares of ones."""
    blocks: list[list[float]] = []
    centres = LOW + (np.arange(BINS) + 0.5) * (HIGH - LOW) / BINS
    for x, n, y in zip(centres, counts, ones):
        if not n:
            continue
        blocks.append([n, y, x * n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            n, y, x = blocks.pop()
            blocks[-1] = [blocks[-1][0] + n, blocks[-1][1] + y, blocks[-1][2] + x]
    if not blocks:
        return np.array([LOW, HIGH]), np.array([0.0, 1.0])
    return np.array([b[2] / b[0] for b in blocks]), np.array([b[1] / b[0] for b in blocks])


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats) of every row, computed once and kept; a null text is empty, repeated rows and null ids are rows.

    A text is read whole, in memory of some thirty bytes for each of its own;
    other columns are not read.
    """
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return cut(rows.mapInArrow(describe, f"id {rows.schema['id'].dataType.simpleString()}, stats array<float>"))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", features: int = FEATURES, ridge: float = RIDGE, seed: int = 5) -> Model:
    """Learns from all rows of stats that labels marks 0 or 1 (of several marks of an id, the largest).

    Ids with crc32 mod 4 = 3 calibrate; the others fit the ridge scores. Sums of
    each task (numbers that don't grow with the rows) are all that moves.
    Without labels every score is 0.5.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    rows = cut(stats.join(known, "id").select("stats", "label", (F.crc32(F.col("id").cast("string")) % 4 == 3).alias("calibrates")))
    d = len(NAMES)
    total = summed(rows.select("stats"), moments, 2 * d + 1)
    n = max(1.0, total[-1])
    mean = total[:d] / n
    spread = np.sqrt(np.maximum(total[d : 2 * d] / n - mean**2, 1e-6))
    rng = np.random.default_rng(seed)
    blank = Model(mean, spread, rng.normal(size=(d, features)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, features), np.zeros(features + 1), np.array([0.0]), np.array([0.5]))
    if not total[-1]:
        return blank
    both = summed(rows.where("not calibrates").select("stats", "label"), lambda it: normal_equations(it, blank), (features + 1) * (features + 2)).reshape(features + 1, features + 2)
    weights = np.linalg.solve(both[:, :-1] + ridge * max(1.0, both[-1, -2]) / features * np.eye(features + 1), both[:, -1])
    raw = Model(**{**blank.__dict__, "weights": weights})
    bins = summed(rows.where("calibrates").select("stats", "label"), lambda it: binned(it, raw), 2 * BINS).reshape(BINS, 2)
    points, heights = isotonic(bins[:, 0], bins[:, 1])
    return Model(**{**raw.__dict__, "points": points, "heights": heights})


def rate(batches, shared):
    model = Model(**shared.value)
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(model.score(stats_of(batch)))], names=["id", "score"])


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id_col and score (0 to 1, higher: label 1 likelier) of every row of stats, repeated ones too."""
    shared = shipped(stats.sparkSession, model)
    kind = stats.schema["id"].dataType.simpleString()
    return stats.mapInArrow(lambda it: rate(it, shared), f"id {kind}, score double").withColumnRenamed("id", id_col)
