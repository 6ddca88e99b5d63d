"""Line deduplication over windows of consecutive lines."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import apart, cut, lean, small_batches

#: Blanks that are trimmed off a line before it is compared.
BLANKS = " \t\v\f\r"

#: Characters from which a line is long, and of a sentence at least ("Yes. No! So." is none, and goes with what precedes or follows).
#: A clause of CLAUSE characters or more, without a mark inside, is a piece of its own if as much as a sentence follows.
LONG = 100
SENTENCE = 10
CLAUSE = 30

#: Where texts part into lines, and long lines into sentences and clauses. Both match no character, so the pieces make up the text; Java and Python read them alike.
#: A sentence starts anew wherever the characters before say so, with no look at outer blanks or at earlier sentences.
#: The character before, which all ways of ending have in common, is looked for first: most places fail at once.
LINE_ENDS = "(?<=\n)"
MARKED = "|".join(f"(?<=[.!?]{quote}[ \t])" for quote in ("", "[\"')\\]]"))
BEFORE_END = "[ \t。！？]"
HERE = (
    f"(?:{MARKED})(?:"
    + "|".join(f"(?<=[^.!?\\n{BLANKS}][^.!?]{{{n}}}[.!?]{quote}[ \t])" for n in (SENTENCE - 1, SENTENCE) for quote in ("", "[\"')\\]]"))
    + r")|(?<=[。！？])|(?<=[,;:][ \t])(?:"
    + "|".join(f"(?<=[^.!?,;:\\n{BLANKS}][^.!?,;:\\n]{{{n}}}[,;:][ \t])" for n in (CLAUSE - 1, CLAUSE))
    + ")(?:"
    + "|".join(f"(?=[^.!?\\n]{{{n}}}[^.!?\\n{BLANKS}])" for n in (SENTENCE - 1, SENTENCE))
    + ")"
)
SENTENCE_ENDS = f"(?<={BEFORE_END})(?:{HERE})"

#: Set between pieces by regexp_replace(), whose pattern Spark compiles once and not for each line as split() does.
BETWEEN = "\0"


def full_lines(text: Column) -> Column:
    """array<struct<i, t>>: number and text of the lines that aren't blank."""
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("i"), F.trim(x, F.lit(BLANKS)).alias("t")))
    return F.filter(lines, lambda x: x["t"] != "")


def full_pieces(text: Column) -> Column:
    """array<struct<i, t>>: number and text of the lines, sentences and clauses of long lines instead, that aren't blank.

    Newlines, which end pieces in pieces_of(), are left out; the numbers are the same.
    """
    trimmed = lambda x: F.trim(x, F.lit(BLANKS + "\n"))
    parted = lambda x: F.split(F.regexp_replace(x, f"({BEFORE_END})(?:{HERE})", f"$1{BETWEEN}"), BETWEEN)
    of_line = lambda x: F.when(F.length(trimmed(x)) <= LONG, F.array(x)).when(x.contains(BETWEEN), F.split(x, SENTENCE_ENDS)).otherwise(parted(x))
    lines = F.transform(F.split(text, "\n"), of_line)
    return F.filter(F.transform(F.flatten(lines), lambda x, i: F.struct(i.alias("i"), trimmed(x).alias("t"))), lambda x: x["t"] != "")


def pieces_of(text: str) -> list[str]:
    """The pieces that full_pieces() numbers, blank ones too."""
    return [p for x in re.split(LINE_ENDS, text) for p in (re.split(SENTENCE_ENDS, x) if len(x.strip(BLANKS + "\n")) > LONG else [x])]


def windows_of(full: Column, size: int) -> Column:
    """array<struct<h1, h2, first, last>>: the windows of size consecutive full lines.

    full must be a column, not an expression, which lambdas would compute anew
    for each window. first and last are line numbers from 0. A text of fewer such
    lines has one window of all of them; a text without any has none.
    """
    n = F.size(full)

    def window(i: Column) -> Column:
        own = [F.get(full, i + j) for j in range(size)]
        texts = [x["t"] for x in own]
        last = F.coalesce(*(x["i"] for x in reversed(own)))
        return F.struct(F.xxhash64(F.least(n, F.lit(size)), *texts).alias("h1"), F.xxhash64(*texts, F.lit("second")).alias("h2"), own[0]["i"].alias("first"), last.alias("last"))

    made = F.greatest(n - F.lit(size - 1), F.least(n, F.lit(1)))
    return F.when(made > 0, F.transform(F.sequence(F.lit(0), made - 1), window))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def without(text: str, spans: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """text without the lines that spans cover, and the covered lines as merged spans."""
    lines, kept, at = text.split("\n"), [], 0
    for first, last in merged(spans):
        kept += lines[at:first]
        at = last + 1
    return "\n".join(kept + lines[at:]), merged(spans)


def without_pieces(text: str, spans: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """text without the pieces that spans cover, and the first and last characters that went.

    Whole lines go with one newline each, as in without(); the line whose end goes keeps its newline.
    """
    starts = [0]
    for piece in pieces_of(text):
        starts.append(starts[-1] + len(piece))
    kept, gone, at = [], [], 0
    for first, last in merged(spans):
        a, b = starts[first], starts[last + 1]
        line_start = a == 0 or text[a - 1] == "\n"
        if not line_start and text[b - 1] == "\n":
            b -= 1
        elif line_start and at < a and b == len(text) and text[b - 1] != "\n":
            a -= 1
        kept.append(text[at:a])
        gone.append((a, b - 1))
        at = b
    return "".join(kept) + text[at:], gone


@lean()
def remove(batches, cut_out):
    spans_of = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    for batch in batches:
        hit = batch.column("spans_found")
        texts, removed = batch.column("text_found"), [None] * batch.num_rows
        rows = [i for i in range(batch.num_rows) if hit[i].is_valid]
        if rows:
            new: list = [None] * batch.num_rows
            for i in rows:
                new[i], removed[i] = cut_out(texts[i].as_py(), hit[i].as_py())
            mask = pa.array([x is not None for x in new])
            texts = pa.compute.if_else(mask, pa.array(new, texts.type), texts)
        spans = pa.array([[{"first": a, "last": b} for a, b in x or []] for x in removed], spans_of)
        yield pa.RecordBatch.from_arrays([batch.column("row"), texts, spans], names=["row", "text", "removed"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, into: str = "removed") -> DataFrame:
    """docs with later occurrences of repeated windows of size lines taken out of their texts.

    Returns every column of docs, the text replaced, and into, an
    array<struct<first, last>> of merged line spans that went (empty: untouched);
    a column of docs of that name is replaced. Lines end at a newline and are
    compared without outer blanks; blank lines belong to no window, but go if they
    lie inside a removed one. Occurrences are ordered by (id, text hash, line);
    the first of all documents stays, all later ones go, also in one document
    (of a line repeated on end the first stays). A text with fewer lines is one
    window of its own length. Null and empty texts are returned as they are.
    Rows that repeat id and text are one document: all are cut alike. Null ids
    come first in the order.

    Windows are hashed once and kept (48 bytes each). Occurrences meet by hash (128
    bits) in a partial aggregation, so that a window found everywhere moves once
    per task; repeated ones join back to their windows (AQE splits hot ones). Only
    line spans, each once, join the texts.
    """
    return dedup(docs, id_col, text_col, full_lines, size, without, into)


def dedup_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, into: str = "removed") -> DataFrame:
    """dedup_lines() that also finds passages within lines: lines over LONG characters count as their sentences and long clauses.

    What dedup_lines() cuts this cuts too, since equal lines part alike. into holds
    the first and last character of each span that went.
    """
    return dedup(docs, id_col, text_col, full_pieces, size, without_pieces, into)


def dedup(docs: DataFrame, id_col: str, text_col: str, units, size: int, cut_out, into: str) -> DataFrame:
    """docs without later occurrences of windows of size units of their texts; cut_out takes a text's spans out."""
    schema = small_batches(docs).schema
    key = docs.select(F.struct(*[docs[f"`{c}`"] for c in schema.names if c not in (text_col, into)]).alias("row"), docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"), F.xxhash64(docs[f"`{text_col}`"]).alias("th"))
    lines = key.where("text <> ''").select("id", "th", units(F.col("text")).alias("full"))
    # explode() would filter on the array's size first, with the lines computed anew for each window
    found = lines.select("id", "th", F.explode_outer(windows_of(F.col("full"), size)).alias("w")).where("w is not null").select("id", "th", "w.*")
    found = cut(found)
    place = F.struct("id", "th", "first")
    repeated = found.groupBy("h1", "h2").agg(F.min(place).alias("stays"), F.count("*").alias("n")).where("n > 1").select(apart("h1").alias("h1"), apart("h2").alias("h2"), "stays")
    later = found.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("stays")))
    # rows that repeat id and text have the same spans
    spans = later.groupBy("id", "th").agg(F.collect_set(F.struct("first", "last")).alias("spans_found"))
    spans = spans.select(F.col("id").alias("id_found"), F.col("th").alias("th_found"), "spans_found").hint("shuffle_hash")
    both = key.join(spans, F.col("id").eqNullSafe(F.col("id_found")) & (F.col("th") == F.col("th_found")), "left")
    both = both.select("row", F.col("text").alias("text_found"), "spans_found")
    out = f"row {both.schema['row'].dataType.simpleString()}, text string, removed array<struct<first:int,last:int>>"
    cut_up = both.mapInArrow(lambda it: remove(it, cut_out), out)
    return cut_up.select(*(F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`") for c in schema.names if c != into), F.col("removed").alias(into))
