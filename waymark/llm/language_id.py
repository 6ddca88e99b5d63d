"""Language identification with bit-sliced Bloom filters of character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import U64, bounded_share, chunks, kept, mix, shipped, small_batches

#: Rows that the filters are fitted on, about, at most.
FIT_ROWS = 20_000

#: Share of a language's n-grams that one must reach to enter its filter; so a language has 1 / SHARE at most.
SHARE = 2e-6

#: Slots of the filters (a power of two) and hashes of each n-gram.
SLOTS = 1 << 22
HASHES = 4

GRAM = 4


@dataclass(frozen=True)
class Model:
    """languages by bit; slots: for each slot the languages whose filter has it set, in as many words as that takes; false_rate by language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray
    gram: int


class Letters:
    """Lower-case letter of each code point, and 0 for what is no letter."""

    def __init__(self) -> None:
        self.table = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                self.table[i] = ord(low[0])


def grams_of(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of each n-gram of the texts' letters, and whether each row has a letter.

    Runs of other characters count as one blank, also before and after a text;
    n-grams lie in a text with its blanks, and hold a letter.
    """
    table = kept("letters", Letters).table
    strings = texts.to_pylist()
    lengths = np.array([len(s) for s in strings]) + 2
    codes = table[np.frombuffer(("\0" + "\0\0".join(strings) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(len(strings)), lengths)
    first = np.zeros(len(codes), bool)
    first[np.concatenate([[0], np.cumsum(lengths)[:-1]])] = True
    keep = (codes != 0) | first | np.concatenate([[False], codes[:-1] != 0])
    codes, row = codes[keep].astype(U64), row[keep]
    has = np.bincount(row, codes != 0, minlength=len(strings)) > 0
    m = max(0, len(codes) - n + 1)
    total = np.zeros(m, U64)
    any_letter = np.zeros(m, bool)
    with np.errstate(over="ignore"):
        for j in range(n):
            total = total * U64(0x1F3D5B79A7C5E393) + codes[j : m + j] + U64(1)
            any_letter |= codes[j : m + j] != 0
    inside = any_letter & (row[:m] == row[n - 1 :])
    return mix(total[inside]), row[:m][inside], has


def slots_of(grams: np.ndarray, size: int, j: int) -> np.ndarray:
    """The j-th slot of each n-gram: two halves of its hash, combined."""
    with np.errstate(over="ignore"):
        return ((grams >> U64(32)) + U64(j) * ((grams & U64(0xFFFFFFFF)) | U64(1))) & U64(size - 1)


def count_grams(batches, n: int):
    """(lang, gram, n) of each chunk of labelled texts, summed within the chunk."""
    for batch, texts in chunks(batches):
        grams, row, _ = grams_of(texts, n)
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])[row] if len(row) else np.zeros(0, int)
        for k, name in enumerate(names):
            found, counts = np.unique(grams[code == k], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "gram": pa.array(found.astype(np.int64)), "n": pa.array(counts.astype(np.int64))})


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = FIT_ROWS, gram: int = GRAM) -> Model:
    """Filters of the n-grams that make up SHARE of a language's n-grams at least.

    Learns from about rows rows at most, chosen by a hash of the id; rows with
    null text or language are left out. The driver gets 1 / SHARE n-grams of a
    language at most. There may be any number of languages.
    """
    known = small_batches(labelled).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    known = bounded_share(known, "id", rows)
    counts = known.mapInArrow(lambda it: count_grams(it, gram), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    languages = sorted(totals)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if np.dtype(k).itemsize * 8 >= len(languages)), np.uint64)
    bits = np.dtype(kind).itemsize * 8
    slots, rate = np.zeros((SLOTS, max(1, -(-len(languages) // bits))), kind), []
    for i, name in enumerate(languages):
        enough = counts.where((F.col("lang") == name) & (F.col("n") >= F.lit(max(2, SHARE * totals[name])))).select("gram")
        grams = enough.toPandas()["gram"].to_numpy(np.int64).astype(U64)
        word, bit = slots[:, i // bits], kind(1 << i % bits)
        for j in range(HASHES):
            word[slots_of(grams, SLOTS, j)] |= bit
        rate.append(float(np.mean(word & bit != 0)) ** HASHES)
    counts.unpersist()
    return Model(languages, slots, np.array(rate), gram)


def label(batches, shared):
    """(id, lang_pred, score) of each row, from the languages that hold each n-gram."""
    model = Model(**shared.value)
    n = len(model.languages)
    kind = model.slots.dtype.type
    bits = model.slots.dtype.itemsize * 8
    for batch, texts in chunks(batches):
        grams, row, has = grams_of(texts, model.gram)
        held = model.slots[slots_of(grams, SLOTS, 0)]
        for j in range(1, HASHES):
            held &= model.slots[slots_of(grams, SLOTS, j)]
        total = np.bincount(row, minlength=len(texts))
        hits = np.stack([np.bincount(row, (held[:, i // bits] >> kind(i % bits)) & kind(1), minlength=len(texts)) for i in range(n)], 1) if n else np.zeros((len(texts), 0))
        names = np.array([*model.languages, "und"], object)
        if n:
            # of the n-grams that a language lacks, false_rate hit all the same
            true = np.maximum(0, (hits - total[:, None] * model.false_rate) / (1 - model.false_rate))
            best, sums = true.argmax(1), true.sum(1)
            known = has & (sums > 0)
            score = np.where(known, true.max(1) / np.where(sums > 0, sums, 1), 0.0)
            # letters that no language has: the first language, with score 0
            pred = np.where(has, names[best], "und")
        else:
            pred, score = np.full(len(texts), "und", object), np.zeros(len(texts))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score (0 to 1: the language's share of corrected hits) of every row of docs.

    lang_pred is und, and score 0, where text is null or has no letter, and
    everywhere for a model without languages. Ties go to the language that
    sorts first. Repeated rows and null ids are labelled each. A text is read whole,
    in memory of some fifty bytes for each of its own; other columns are not read.
    """
    shared = shipped(docs.sparkSession, model)
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: label(it, shared), f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)

