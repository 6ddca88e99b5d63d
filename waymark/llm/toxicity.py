"""Toxicity scores by a counterfactually regularised linear classifier."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import CHUNK_BYTES, U64, Words, bounded_share, chunks, cut, kept, lean, shipped, small_batches

#: Labelled rows that the classifier is fitted on, about, at most.
FIT_ROWS = 8_000

#: Features of the classifier, at most.
FEATURES = 8192

#: Weight of a pair's squared change of score beside a row's log loss.
COUNTERFACTUAL = 4.0

#: Standard errors by which a feature's log ratio must exceed 0, however many rows there are.
ERRORS = 3.0

#: Terms that name groups of people, in four languages. A term may stand for any other of its line.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("black", "white", "asian", "latino"),
    ("immigrants", "natives"),
    ("old", "young"),
    ("disabled", "abled"),
    ("femmes", "hommes"),
    ("filles", "gar\u00e7ons"),
    ("chr\u00e9tiens", "musulmans", "juifs", "hindous", "bouddhistes", "ath\u00e9es"),
    ("homosexuels", "h\u00e9t\u00e9rosexuels", "lesbiennes", "bisexuels"),
    ("noirs", "blancs", "asiatiques", "latinos"),
    ("immigr\u00e9s", "autochtones"),
    ("frauen", "m\u00e4nner"),
    ("m\u00e4dchen", "jungen"),
    ("christen", "muslime", "juden", "hinduisten", "buddhisten", "atheisten"),
    ("schwule", "heteros", "lesben", "bisexuelle"),
    ("schwarze", "wei\u00dfe", "asiaten", "latinas"),
    ("einwanderer", "einheimische"),
    ("mujeres", "hombres"),
    ("ni\u00f1as", "ni\u00f1os"),
    ("cristianos", "musulmanes", "jud\u00edos", "hind\u00faes", "budistas", "ateos"),
    ("homosexuales", "heterosexuales", "lesbianas", "bisexuales"),
    ("negros", "blancos", "asi\u00e1ticos", "mestizos"),
    ("inmigrantes", "nativos"),
)

#: Where a text parts into sentences.
SENTENCE_ENDS = re.compile(r"(?<=[.!?])\s+|\n+")

#: All ASCII but letters: what parts words here.
GAPS = bytes(b for b in range(128) if not chr(b).isalpha())


def features_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes and their rows: each word, and its first four, five and six bytes (as stems)."""
    words = kept("letter words", lambda: Words(GAPS))
    hashes, starts, ends, first = words(texts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    stems = [words.beginnings(starts, ends, n) ^ U64(n) for n in (4, 5, 6)] if len(hashes) else []
    return np.concatenate([hashes, *stems]), np.concatenate([row] * (1 + len(stems)))


def swapped(text: str, groups=IDENTITY_TERMS, by: int = 1) -> str:
    """text with each identity term replaced by the one that stands by places later in its group."""
    to = {term: group[(i + by) % len(group)] for group in groups for i, term in enumerate(group)}
    return re.sub(r"[^\W\d_]+", lambda m: to.get(m[0].lower(), m[0]), text)


class Counterfactuals:
    """Pairs of sentences that a fair score treats alike."""

    def __init__(self, groups=IDENTITY_TERMS) -> None:
        self.groups = [g for g in groups if len(g) > 1]
        self.size = {term: len(g) for g in self.groups for term in g}

    def __call__(self, text: str) -> list[tuple[str, str]]:
        """For each sentence that names a group, itself with every other member in its place; and one sentence that
        names none, beside itself with every member of one group put in, so that there are pairs in any corpus."""
        out, plain = [], None
        for own in SENTENCE_ENDS.split(text):
            sizes = [self.size[w] for w in re.findall(r"[^\W\d_]+", own.lower()) if w in self.size]
            out += [(own, swapped(own, self.groups, by)) for by in range(1, max(sizes, default=1))]
            if not sizes and own.strip():
                key = zlib.crc32(own.encode("utf-8", "surrogatepass"))
                plain = min(plain or (key, own), (key, own))
        if plain and self.groups:
            out += [(plain[1], f"{plain[1]} {term}") for term in self.groups[plain[0] % len(self.groups)]]
        return out


@lean()
def sparse_rows(batches, groups):
    """(label, x, c): the features of labelled texts (c null), and of pairs of their sentences (label null) that differ."""
    pairs_of = Counterfactuals(groups)
    schema = pa.schema([("label", pa.int32()), ("x", pa.list_(pa.int64())), ("c", pa.list_(pa.int64()))])

    def sets(texts: pa.Array) -> list[np.ndarray]:
        found, row = features_of(texts)
        return split(found, row, len(texts))

    for batch, texts in chunks(batches):
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(sets(texts), schema.field("x").type), pa.nulls(len(texts), schema.field("c").type)], schema=schema)
        for pairs in bounded(p for t in texts.to_pylist() for p in pairs_of(t)):
            x, c = (sets(pa.array(side, pa.large_string())) for side in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int32()), pa.array(x, schema.field("x").type), pa.array(c, schema.field("c").type)], schema=schema)


def bounded(pairs):
    """Lists of pairs with about CHUNK_BYTES characters, or one pair: what reads like one sentence can be a whole long text."""
    held, size = [], 0
    for p in pairs:
        held.append(p)
        size += len(p[0]) + len(p[1])
        if size >= CHUNK_BYTES or len(held) >= 4096:
            yield held
            held, size = [], 0
    if held:
        yield held


def split(found: np.ndarray, row: np.ndarray, n: int) -> list[np.ndarray]:
    order = np.argsort(row, kind="stable")
    found, ends = found[order], np.searchsorted(row[order], np.arange(n + 1))
    return [np.unique(found[a:b]).astype(np.int64) for a, b in zip(ends, ends[1:])]


@dataclass(frozen=True)
class Model:
    """weights of the sorted feature hashes, and the bias."""

    features: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -4.0


def choose(rows: DataFrame, ones: int, zeros: int, limit: int = FEATURES) -> np.ndarray:
    """The features, limit at most, that mark toxic rows most surely: by their log ratio less ERRORS standard errors.

    Counted on the executors.
    """
    counts = rows.select("label", F.explode("x").alias("f")).groupBy("f").agg(F.sum("label").alias("pos"), F.count("*").alias("n")).where("pos > 0")
    pos, neg = F.col("pos") + 0.5, F.col("n") - F.col("pos") + 0.5
    ratio = F.log(pos) - F.log(F.lit(ones + 1.0)) - F.log(neg) + F.log(F.lit(zeros + 1.0))
    sure = counts.select("f", (ratio - ERRORS * F.sqrt(1 / pos + 1 / neg)).alias("sure")).where("sure > 0")
    return np.sort(np.array([r.f for r in sure.orderBy(F.desc("sure"), "f").limit(limit).collect()], np.int64))


@lean()
def numbered(batches, names: np.ndarray):
    """(label, x, c) with the positions of the chosen features in place of features."""
    for batch in batches:
        out = [batch.column("label")]
        for k in ("x", "c"):
            rows = []
            for v in batch.column(k).to_pylist():
                at = None
                if v is not None:
                    at = np.minimum(np.searchsorted(names, v), len(names) - 1)
                    at = at[names[at] == v].astype(np.int32)
                rows.append(at)
            out.append(pa.array(rows, pa.list_(pa.int32())))
        yield pa.RecordBatch.from_arrays(out, names=["label", "x", "c"])


def fit_rows(names: np.ndarray, x: list[np.ndarray], y: np.ndarray, c: list[np.ndarray | None], l2: float = 0.02, counterfactual: float = COUNTERFACTUAL, steps: int = 300, times: np.ndarray | None = None) -> Model:
    """Logistic regression of y on the features names; x and c hold positions in names, times how often each row counts.

    Adds counterfactual * (score of x - score of its counterpart c)**2 for each
    row with one, and l2 * weights**2. Rows whose y is nan have no label. Deterministic
    gradient steps with momentum, a feature's step by the curvature that its rows can have.
    """
    times = np.ones(len(y)) if times is None else times
    known = np.flatnonzero(~np.isnan(y))
    label, weight = y[known], times[known]
    ones = float((label * weight).sum())
    base = float(np.log((ones + 0.5) / (weight.sum() - ones + 0.5)))

    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        own = np.repeat(np.arange(len(rows)), [len(v) for v in rows])
        return own, np.concatenate([np.zeros(0, np.int64), *rows]).astype(np.int64)

    with_c = np.array([i for i, v in enumerate(c) if v is not None], np.int64)
    pair = counterfactual * times[with_c]
    (r, f), (rs, fs), (rc, fc) = flat([x[i] for i in known]), flat([x[i] for i in with_c]), flat([c[i] for i in with_c])
    sums = lambda at, values: np.bincount(at, values, minlength=len(names))
    # sums over a row of several features move together
    longest = max([1, *(len(v) for v in x), *(len(c[i]) for i in with_c)])
    rate = 1 / (longest * (l2 + sums(f, weight[r]) / 4 + (sums(fs, pair[rs]) + sums(fc, pair[rc])) / 4))
    rate_b = 1 / (longest * (weight.sum() / 4 + pair.sum() / 4))
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    w, b = np.zeros(len(names)), base
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        d = (sig(b + np.bincount(r, w[f], minlength=len(known))) - label) * weight
        gw, gb = sums(f, d[r]) + l2 * w, d.sum()
        if len(with_c):
            own, other = sig(b + np.bincount(rs, w[fs], minlength=len(with_c))), sig(b + np.bincount(rc, w[fc], minlength=len(with_c)))
            e = 2 * pair * (own - other)
            do, dc = e * own * (1 - own), e * other * (1 - other)
            gw += sums(fs, do[rs]) - sums(fc, dc[rc])
            gb += (do - dc).sum()
        vw, vb = 0.95 * vw - rate * gw, 0.95 * vb - rate_b * gb
        w, b = w + vw, b + vb
    order = np.argsort(names.astype(U64))
    return Model(names.astype(U64)[order], w[order], float(b))


def training_rows(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", groups=IDENTITY_TERMS) -> tuple[np.ndarray, list, np.ndarray, list, np.ndarray] | Model:
    """(names, x, y, c, times) for fit_rows(), equal rows merged on the executors; a Model where there is nothing to learn.

    The features are those that mark toxic rows, and the identity terms as whole words.
    """
    known = labelled.select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label")).where("text is not null and label in (0, 1)")
    rows = cut(small_batches(known).mapInArrow(lambda it: sparse_rows(it, groups), "label int, x array<long>, c array<long>"))
    texts = rows.where("c is null")
    seen = {r.label: r.n for r in texts.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ones, zeros = seen.get(1, 0), seen.get(0, 0)
    if not ones or not zeros:
        return Model(bias=4.0 if ones else -4.0)
    names = choose(texts, ones, zeros)
    if not len(names):
        return Model(bias=float(np.log((ones + 0.5) / (zeros + 0.5))))
    terms = kept("letter words", lambda: Words(GAPS))(pa.array([t for g in groups for t in g], pa.large_string()))[0]
    names = np.unique(np.concatenate([names, terms.astype(np.int64)]))
    found = rows.mapInArrow(lambda it: numbered(it, names), "label int, x array<int>, c array<int>").where("c is null or x <> c")
    found = sorted(((-1 if r.label is None else r.label, r.x, r.c or [], r.c is not None, r.times) for r in found.groupBy("label", "x", "c").agg(F.count("*").alias("times")).collect()))
    y = np.array([np.nan if r[0] < 0 else r[0] for r in found], float)
    return names, [np.array(r[1], np.int64) for r in found], y, [np.array(r[2], np.int64) if r[3] else None for r in found], np.array([r[4] for r in found], float)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", groups=IDENTITY_TERMS, counterfactual: float = COUNTERFACTUAL) -> Model:
    """Learns from all rows of labelled (see labelled_sample for the bound); null labels and texts are left out.

    Identity terms are swapped for every other of their group in the sentences of
    labelled texts, and put into one sentence of each text; changes of the score
    between such sentences are penalised (counterfactual), so that a neutral
    mention of a group doesn't count as toxic because toxic rows name it often.
    The driver gets the chosen features and which of them rows and pairs have.
    """
    found = training_rows(labelled, text_col, label_col, groups)
    if isinstance(found, Model):
        return found
    names, x, y, c, times = found
    return fit_rows(names, x, y, c, counterfactual=counterfactual, times=times)


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", rows: int = FIT_ROWS) -> DataFrame:
    """(id, text, label) of about rows labelled documents at most; only their labels, as few, go out to docs."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).alias(label_col))
    return docs.select(id_col, text_col).join(F.broadcast(bounded_share(known, id_col, rows)), id_col)


@lean()
def rate(batches, shared, text_col: str, names: list[str]):
    """The named columns of each row, score among them."""
    model = Model(**shared.value)
    near = np.zeros(1 << 20, bool)
    near[(model.features & U64((1 << 20) - 1)).astype(np.int64)] = True
    for batch, texts in chunks(batches, text_col):
        found, row = features_of(texts)
        maybe = np.flatnonzero(near[(found & U64((1 << 20) - 1)).astype(np.int64)])
        found, row = found[maybe], row[maybe]
        z = np.full(len(texts), model.bias)
        if len(found):
            at = np.minimum(np.searchsorted(model.features, found), len(model.features) - 1)
            hit = model.features[at] == found
            pair = np.unique(row[hit] * len(model.features) + at[hit])
            z += np.bincount(pair // len(model.features), model.weights[pair % len(model.features)], minlength=len(texts))
        scores = pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        yield pa.RecordBatch.from_arrays([scores if c is None else batch.column(c) for c in [*names[:-1], None]], names=names)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """Every row and column of docs, and into (0 to 1, higher: toxic likelier); a column of that name is replaced.

    A-Z count as a-z; a null or empty text gets the bias alone. Repeated rows and
    null ids are scored each. An empty training set gives a model of low scores;
    one of a single class, of that class. A text is read whole, in memory of some
    twenty bytes for each of its own.
    """
    shared = shipped(docs.sparkSession, model)
    kept_columns = [f for f in small_batches(docs).schema if f.name != into]
    names = [*(f.name for f in kept_columns), into]
    schema = StructType([*kept_columns, StructField(into, DoubleType())])
    return docs.select(*(docs[f"`{f.name}`"] for f in kept_columns)).mapInArrow(lambda it: rate(it, shared, text_col, names), schema)
