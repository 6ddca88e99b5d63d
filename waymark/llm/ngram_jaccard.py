"""Exact Jaccard join of word n-gram sets with prefix filters under several global orders."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import U64, Words, apart, chunks, cut, kept, lean, mix, shuffle_partitions, small_batches, star

#: A token in more documents is frequent: the orders put it last, and no pairs are made from it.
LIGHT = 48

#: Frequent tokens are told apart by so many bits of their hashes; others that share these count as frequent too.
SLOT_BITS = 26

#: Sets of a block that verification holds at a time; in clusters of over 16 such blocks up to PAIRED.
BLOCK = 64
PAIRED = 1024

#: Tokens of a block, about (8 bytes each).
BLOCK_TOKENS = 1 << 20

#: Rows of candidates up to which they are broadcast to the texts; beyond, both shuffle.
BROADCAST = 1 << 17

#: What one task buffers before it writes, in tokens.
FLUSH = 1 << 18

ORDERS = 2
#: token: 32 bits below the bucket's; light: length of the prefix without frequent tokens; last: its last key.
POSTING = np.dtype([("token", "<u4"), ("flags", "<u4"), ("cls", "<u8"), ("n", "<u4"), ("light", "<u4"), ("last", "<u4")])
EDGE = np.dtype([("token", "<u8"), ("cls", "<u8")])


def sets_of(batches, k: int):
    """(batch, list of sorted distinct shingle hashes) of each chunk of texts."""
    words = kept("words", Words)
    for batch, texts in chunks(batches):
        hashes, rows = words.shingles(texts, k)
        yield batch, [np.unique(hashes[a:b]) for a, b in zip(rows, rows[1:])]


def class_of(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share: sums of mixed hashes."""
    with np.errstate(over="ignore"):
        return int(mix(tokens + U64(0x5851F42D4C957F2D)).sum()), int(mix(tokens ^ U64(0x14057B7EF767814F)).sum())


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


class Levels:
    """Ranges of set sizes such that similar sets are of one level or of neighbours, and signatures by level.

    Two sets whose similarity is t percent differ in few tokens, d at most for
    their sizes. Hashed into d + 1 + spare parts, their tokens agree in over spare
    parts, one of which isn't empty if a set has no more than spare empty parts.
    So similar sets share the signature of a part: of all its tokens, about
    (100 + t) / (200 - 2 t) of them, which sets that only share passages rarely do.
    """

    def __init__(self, t: int) -> None:
        self.t, self.tops = t, [100 // t]

    def of(self, n: int) -> int:
        while self.tops[-1] < n:
            self.tops.append(100 * (self.tops[-1] + 1) // self.t)
        return bisect.bisect_left(self.tops, n)

    def signatures(self, tokens: np.ndarray) -> np.ndarray:
        own, out = self.of(len(tokens)), []
        for level in (own, own + 1):
            while len(self.tops) <= level:
                self.tops.append(100 * (self.tops[-1] + 1) // self.t)
            d = 2 * self.tops[level] * (100 - self.t) // (100 + self.t)
            spare = 1 + d // 32
            parts = d + 1 + spare
            with np.errstate(over="ignore"):
                salted = mix(tokens + U64(level + 1) * U64(0x9E3779B97F4A7C15))
                part = (salted % U64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                counts = np.bincount(part, minlength=parts)
                full = np.flatnonzero(counts)
                sums = np.add.reduceat(mix(salted[order] ^ U64(0xA0761D6478BD642F)), np.concatenate([[0], np.cumsum(counts[full])[:-1]]))
                out.append(mix(sums + mix(full.astype(U64) << U64(20) | U64(level))))
                empty = np.flatnonzero(counts == 0)
                if len(empty) > spare:
                    out.append(mix(mix(empty.astype(U64) << U64(20) | U64(level)) ^ U64(0xE7037ED1A0B428DB)))
        return np.concatenate(out)


@lean()
def profile(batches, k: int, universe: int, shift: int):
    """Rows (id, th, n, c1, c2) of documents, and blobs of token counts by the tokens' top bits.

    Only tokens below universe are counted, by 32 bits beside the bucket's.
    """
    schema = pa.schema([("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])
    held: list[np.ndarray] = []
    size = 0

    def flush():
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        bucket = (tokens >> U64(shift)).astype(np.int64)
        low = ((tokens >> U64(shift - 32)) & U64(0xFFFFFFFF)).astype("<u4")
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        blobs = [low[a:b].tobytes() + np.minimum(counts[a:b], 65535).astype("<u2").tobytes() for a, b in zip(starts, [*starts[1:], len(low)])]
        none = pa.nulls(len(blobs), pa.int64())
        yield pa.RecordBatch.from_arrays([none] * 5 + [pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    for batch, sets in sets_of(batches, k):
        keys = [class_of(s) if len(s) else (None, None) for s in sets]
        columns = [pa.array([c and signed(c) if c is not None else None for c in x], pa.int64()) for x in zip(*keys)]
        none = [pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array([len(s) for s in sets], pa.int64()), *columns, *none], schema=schema)
        for s in sets:
            held.append(s[: np.searchsorted(s, U64(universe))])
            size += len(held[-1])
        if size >= FLUSH:
            yield from flush()
            held, size = [], 0
    if size:
        yield from flush()


def by_bucket(batches):
    """(bucket, its blobs) of rows sorted by bucket."""
    at, held = None, []
    for batch in batches:
        for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
            if bucket != at and held:
                yield at, held
                held = []
            at = bucket
            held.append(blob)
    if held:
        yield at, held


@lean()
def frequent(batches, least: int, bits: int):
    """(bucket, its part of the map of frequent tokens) of buckets that have some; a token is known by SLOT_BITS bits.

    Frequent are the tokens in more than least documents.
    """
    for bucket, blobs in by_bucket(batches):
        cuts = [len(b) // 6 for b in blobs]
        low = np.concatenate([np.frombuffer(b, "<u4", c) for b, c in zip(blobs, cuts)])
        counts = np.concatenate([np.frombuffer(b, "<u2", c, 4 * c) for b, c in zip(blobs, cuts)])
        tokens, inverse = np.unique(low, return_inverse=True)
        hot = tokens[np.bincount(inverse, counts) > least]
        if len(hot):
            marks = np.zeros(1 << SLOT_BITS - bits, bool)
            marks[hot >> np.uint32(32 - (SLOT_BITS - bits))] = True
            yield pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})


@lean()
def prefixes(batches, k: int, t: int, universe: int, shift: int, shared, aliases: dict):
    """Blobs of postings by token bucket: each set's prefix under each order; sets too small for any link have none.

    Order o sorts by (frequent or outside universe, o-th hash). A set that has such
    tokens in all its prefixes also gives its signatures; flags say under which
    orders it has some. Signatures that several sets of a blob share go out once,
    and the sets' links (kind 2) beside them.
    """
    schema = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])
    lists: list[list[np.ndarray]] = [[], []]
    size, seen, levels = 0, set(), Levels(t)
    salts = [U64(0), *(U64(0xA0761D6478BD642F + o) for o in range(1, ORDERS))]
    marks = np.frombuffer(shared.value, np.uint8)

    def rows_of(kind: int, keys: np.ndarray, rows: np.ndarray):
        bucket = (keys >> U64(shift)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        blobs = [rows[a:b].tobytes() for a, b in zip(starts, [*starts[1:], len(rows)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(np.full(len(blobs), kind), pa.int32()), pa.array(blobs, pa.binary())], schema=schema)

    def flush():
        if lists[0]:
            yield rows_of(0, np.concatenate([k for k, _ in lists[0]]), np.concatenate([r for _, r in lists[0]]))
        if lists[1]:
            rows = np.concatenate(lists[1])
            first, a, b = linked(rows)
            yield rows_of(1, first["token"], first)
            if len(a):
                links = np.unique(np.stack([a, b], 1), axis=0)
                yield rows_of(2, mix(links[:, 0]), links)

    for _, sets in sets_of(batches, k):
        sets = [s for s in sets if len(s) * (100 - t) >= t]
        if not sets:
            continue
        flat = np.concatenate(sets)
        ends = np.cumsum([len(s) for s in sets])
        is_hot = flat >= U64(universe)
        slots = (flat[~is_hot] >> U64(64 - SLOT_BITS)).astype(np.int64)
        is_hot[~is_hot] = marks[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8) & 1
        rank = is_hot.astype(U64) << U64(63)
        mixed = [mix(flat ^ s) for s in salts]
        keys = [rank | (m >> U64(2)) for m in mixed]
        for s, end in zip(sets, ends):
            key = class_of(s)
            if key in seen:
                continue
            if len(seen) < 1 << 18:
                seen.add(key)
            node = aliases.get(key, key[0])
            a, n = end - len(s), len(s)
            need = n - -(-t * n // 100) + 1
            first = [a + np.argsort(own[a:end])[:need] for own in keys]
            any_hot = [bool(is_hot[f[-1]]) for f in first]
            flags = sum(1 << o for o in range(ORDERS) if any_hot[o])
            for o, f in enumerate(first):
                light = f[~is_hot[f]]
                if not len(light):
                    continue
                rows = np.zeros(len(light), POSTING)
                rows["token"] = (mixed[o][light] >> U64(shift - 32)) & U64(0xFFFFFFFF)
                rows["flags"] = flags << 1 | o
                rows["cls"], rows["n"], rows["light"], rows["last"] = node, n, len(light), keys[o][light[-1]] >> U64(32)
                lists[0].append((mixed[o][light], rows))
                size += len(rows)
            if all(any_hot):
                own = levels.signatures(s)
                rows = np.zeros(len(own), EDGE)
                rows["token"], rows["cls"] = own, node
                lists[1].append(rows)
                size += len(rows)
        if size >= FLUSH:
            yield from flush()
            lists, size = [[], []], 0
    yield from flush()


def linked(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each signature the least set's row, and its links (a, b) to the others."""
    rows = rows[np.lexsort((rows["cls"], rows["token"]))]
    new = np.concatenate([[True], rows["token"][1:] != rows["token"][:-1]])
    a, b = rows["cls"][np.flatnonzero(new)][np.cumsum(new) - 1], rows["cls"]
    return rows[new], a[a != b], b[a != b]


PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("o", pa.int32()), ("shared", pa.int32()), ("needed", pa.int32()), ("frequent", pa.int32())])


@lean()
def candidates(batches, t: int):
    """Rows (a, b, o, shared, needed, frequent) of pairs of classes that share light prefix tokens under order o.

    shared counts the tokens of this bucket; needed is what a similar pair shares
    at least; frequent has a bit for each order under which both sets have
    frequent tokens in their prefixes too. Pairs whose sizes differ too much are
    left out. Sets that share a signature are linked to the least, as o = -1.
    """
    for kind, blobs in buckets(batches):
        if kind:
            a, b = linked(np.frombuffer(b"".join(blobs), EDGE))[1:] if kind == 1 else np.frombuffer(b"".join(blobs), "<u8").reshape(-1, 2).T
            if len(a):
                yield link_batch(*np.unique(np.stack([a, b], 1), axis=0).T)
            continue
        rows = np.frombuffer(b"".join(blobs), POSTING)
        key = (rows["flags"].astype(U64) & U64(1)) << U64(32) | rows["token"]
        order = np.lexsort((rows["cls"], key))
        rows, key = rows[order], key[order]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (rows["cls"][1:] != rows["cls"][:-1])])
        rows, key = rows[fresh], key[fresh]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff([*starts, len(rows)])
        found = []
        for size in np.unique(sizes[sizes > 1]):
            at = starts[sizes == size][:, None]
            left, right = np.triu_indices(size, 1)
            step = 1 + 200_000 // len(left)
            for lot in range(0, len(at), step):
                found.append(filtered(rows[(at[lot : lot + step] + left).ravel()], rows[(at[lot : lot + step] + right).ravel()], t))
        if found:
            every = np.concatenate(found)
            every = every[np.lexsort((every["o"], every["b"], every["a"]))]
            if len(every):
                new = np.concatenate([[True], (every["a"][1:] != every["a"][:-1]) | (every["b"][1:] != every["b"][:-1]) | (every["o"][1:] != every["o"][:-1])])
                at = np.flatnonzero(new)
                pairs = every[at]
                shared = np.diff([*at, len(every)])
                columns = [pairs["a"].astype(np.int64), pairs["b"].astype(np.int64), pairs["o"], shared, pairs["needed"], pairs["frequent"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR)], schema=PAIR)


def link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [a.astype(np.int64), b.astype(np.int64), np.full(len(a), -1), *[np.zeros(len(a), int)] * 3]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PAIR)], schema=PAIR)


def buckets(batches):
    """(kind, blobs) a bucket at a time, of rows sorted by kind and bucket."""
    at, held = None, []
    for batch in batches:
        for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "blob"))):
            if (kind, bucket) != at and held:
                yield at[0], held
                held = []
            at = kind, bucket
            held.append(blob)
    if held:
        yield at[0], held


def filtered(x: np.ndarray, y: np.ndarray, t: int) -> np.ndarray:
    """(a, b, o, needed, frequent) of the pairs whose sizes allow the similarity.

    A similar pair has at least ceil(t (nx + ny) / (100 + t)) tokens in common, so
    each set has few others. The set whose light prefix ends first in the order
    has all of that prefix, but those few, in the other's light prefix.
    """
    nx, ny = x["n"].astype(np.int64), y["n"].astype(np.int64)
    ok = 100 * np.minimum(nx, ny) >= t * np.maximum(nx, ny)
    x, y, nx, ny = x[ok], y[ok], nx[ok], ny[ok]
    least = -(-t * (nx + ny) // (100 + t))
    out = np.zeros(len(x), [("a", "<u8"), ("b", "<u8"), ("o", "<i4"), ("needed", "<i4"), ("frequent", "<i4")])
    by_x, by_y = x["light"] - (nx - least), y["light"] - (ny - least)
    out["needed"] = np.where(x["last"] < y["last"], by_x, np.where(x["last"] > y["last"], by_y, 1))
    out["a"], out["b"], out["o"] = x["cls"], y["cls"], x["flags"] & 1
    out["frequent"] = (x["flags"] & y["flags"]) >> 1
    return out


@lean()
def members(batches, k: int):
    """The set of each wanted class, once a task: rows whose text turned out to be of another class are left out."""
    seen: set[int] = set()
    for batch, sets in sets_of(batches, k):
        columns = (batch.column(c).to_pylist() for c in ("node", "c1", "c2"))
        keep = []
        for i, (node, *want) in enumerate(zip(*columns)):
            if node not in seen and len(sets[i]) and [signed(c) for c in class_of(sets[i])] == want:
                seen.add(node)
                keep.append(i)
        batch = batch.take(pa.array(keep, pa.int64()))
        names = ["cluster", "block", "blocks", "up", "down", "node"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([sets[i].tobytes() for i in keep], pa.binary())], names=[*names, "tokens"])


@lean()
def links_of(batches, t: int):
    """Verified links of each pair of blocks: (u, v, n) with a spanning forest (n 0) and each class's number (u = v).

    Rows come sorted by cluster and blocks i <= j. Intersections are counted
    exactly through an inverted index of the two blocks.
    """
    at, held = None, {}
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("cluster", "i", "j", "block", "node", "tokens"))
        for cluster, i, j, block, node, tokens in zip(*columns):
            if (cluster, i, j) != at:
                if len(held) > 1:
                    yield verify(held, at[1] == at[2], at[1], t)
                at, held = (cluster, i, j), {}
            held[node] = (block, tokens)
    if len(held) > 1:
        yield verify(held, at[1] == at[2], at[1], t)


def verify(held: dict, same: bool, first: int, t: int) -> pa.RecordBatch:
    names = list(held)
    sets = [np.frombuffer(held[c][1], "<u8") for c in names]
    block = np.array([held[c][0] for c in names])
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    sizes = np.diff([*starts, len(tokens)])
    # the runs of each set's shared tokens
    run = np.repeat(np.arange(len(starts)), sizes)
    back = np.argsort(owner, kind="stable")
    runs, ends = run[back], np.cumsum(n)
    root, links = list(range(len(names))), np.zeros(len(names), np.int64)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(names)):
        if not same and block[a] != first:
            continue
        own = runs[ends[a] - n[a] : ends[a]]
        own = own[sizes[own] > 1]
        if not len(own):
            continue
        size, begin = sizes[own], starts[own]
        at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        inter = np.bincount(owner[at], minlength=len(names))
        linked = 100 * inter >= t * (n[a] + n - inter)
        linked[a] = False
        if not same:
            linked &= block != first
        others = np.flatnonzero(linked)
        links[a] += len(others)
        if not same:
            links[others] += 1
        for b in others[others > a] if same else others:
            x, y = find(a), find(int(b))
            if x != y:
                root[max(x, y)] = min(x, y)
    top = [find(x) for x in range(len(names))]
    tree = [(names[x], names[r], 0) for x, r in enumerate(top) if x != r]
    rows = tree + [(names[x], names[x], int(links[x])) for x in np.flatnonzero(links)]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], names=["u", "v", "n"])


def jaccard_groups(docs: DataFrame, k: int = 3, t: int = 90, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """Groups of documents joined by links: Jaccard similarity of the sets of k-word shingles of t percent or more.

    Returns id_col, n_shingles, component_id (smallest id reachable by links),
    n_links (other texts, as sets, that the document's set links to). A-Z count
    as a-z; words are [^\x20\x09-\x0D]+; with fewer than k words the whole
    sequence is one shingle; texts without words (null, empty) have n_shingles 0
    and link with nothing. Null ids are never a component_id unless a component
    has no other. Each row is judged, repeated rows like exact copies. with_kept
    adds th, the row's text hash (xxhash64), and kept, whether the row is the
    component's least by (id, th), null ids last; rows without words are kept, and
    of rows that repeat id and text all are or none.

    1. Documents with equal sets are one class, known by 128 bits; classes are
       numbered by 64 of these, those few that share them by others (aliases()). A
       class is carried by its smallest id. No copies are compared.
    2. Document frequencies (exact, over all documents, for the share of the token
       space that orders put first) name frequent tokens, marked in a map of
       2**SLOT_BITS bits that all tasks get.
    3. Each set's prefix under ORDERS global orders (frequent tokens last, then by
       another hash each) goes out as postings. Classes that share enough light
       prefix tokens under every order (all but what the similarity lets a set
       have alone), and sizes, are candidates; no light token is in more than LIGHT
       documents. Sets with frequent tokens in all their prefixes, such as large
       groups of near copies, meet by the signatures of parts of their sets
       instead (Levels), which similar sets can't miss either.
    4. Clusters of candidates are verified exactly by an inverted index, a large
       one in pairs of blocks of like sizes; only spanning forests come out.
    5. The forests' components are the groups.

    Sets that can't be similar to any other for their size (under nine shingles at
    90 percent) give no postings. Ids must cast to long. A text is read whole, in
    memory of some forty bytes for each of its words; other columns are not read.
    """
    n = shuffle_partitions(small_batches(docs))
    spark = docs.sparkSession
    bits = max(10, min(18, (16 * n - 1).bit_length()))
    shift = 64 - bits
    universe = min((1 << 64) - 1, int((1 << 64) * 3 * (100 - t) / 100))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    first = cut(rows.mapInArrow(lambda it: profile(it, k, universe, shift), "id long, th long, n long, c1 long, c2 long, bucket int, blob binary"))
    counts = first.where("bucket is not null").select("bucket", "blob").repartition(n, "bucket").sortWithinPartitions("bucket")
    light, slot_bytes = LIGHT, 1 << SLOT_BITS - bits - 3
    marks = bytearray(slot_bytes * (1 + (universe >> shift)))
    for r in counts.mapInArrow(lambda it: frequent(it, light, bits), "bucket int, marks binary").collect():
        marks[r.bucket * slot_bytes : (r.bucket + 1) * slot_bytes] = r.marks
    shared = spark.sparkContext.broadcast(bytes(marks))

    profiles = first.where("bucket is null").select("id", "th", "n", "c1", "c2")
    classes = cut(profiles.where("n > 0").groupBy("c1", "c2").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("id", "th"))).alias("named"), F.min("th").alias("th"), F.min("id").alias("least"), F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("first"), F.max("n").alias("n")))
    others = aliases(classes)
    node = F.col("c1")
    for (c1, c2), other in others.items():
        node = F.when((F.col("c1") == signed(c1)) & (F.col("c2") == signed(c2)), F.lit(signed(other))).otherwise(node)
    classes = classes.withColumn("node", node)

    postings = rows.mapInArrow(lambda it: prefixes(it, k, t, universe, shift, shared, others), "bucket int, kind int, blob binary")
    pairs = postings.repartition(n, "bucket").sortWithinPartitions("kind", "bucket")
    pairs = pairs.mapInArrow(lambda it: candidates(it, t), "a long, b long, o int, shared int, needed int, frequent int")
    sums = [F.max(F.when(F.col("o") == -1, True)).alias("linked"), F.max("frequent").alias("frequent")]
    for o in range(ORDERS):
        own = F.col("o") == o
        sums += [F.sum(F.when(own, F.col("shared"))).alias(f"shared{o}"), F.max(F.when(own, F.col("needed"))).alias(f"needed{o}")]
    both = pairs.groupBy("a", "b").agg(*sums)
    for o in range(ORDERS):
        # what meets in frequent tokens alone may share no light one under this order
        may = F.col("frequent").bitwiseAND(F.lit(1 << o)) != 0
        enough = F.col(f"shared{o}") >= F.col(f"needed{o}")
        both = both.where(F.col("linked") | F.coalesce(enough, may))
    clusters = star(both.select(F.col("a").alias("u"), F.col("b").alias("v")))

    wanted = classes.join(clusters, "node").select("node", "c1", "c2", "n", F.col("named.id").alias("wid"), F.coalesce("named.th", "th").alias("wth"), F.col("root").alias("cluster"))
    wanted = cut(blocked(wanted, t))
    few = wanted.count() <= BROADCAST
    texts = rows.join(wanted.hint("broadcast" if few else "shuffle_hash"), rows.id.eqNullSafe(F.col("wid")) & (F.col("th") == F.col("wth")))
    own = ["cluster", "block", "blocks", "up", "down", "node", "c1", "c2"]
    sets = texts.select(*own, "text").mapInArrow(lambda it: members(it, k), "cluster long, block long, blocks long, up long, down long, node long, tokens binary")
    # each set goes to the pairs of its block with those of its level and of the next ones
    level, step = F.shiftright("block", 32), F.lit(1 << 32).cast("long")
    rest = lambda at, many: F.when(many > 0, F.transform(F.sequence(F.lit(0).cast("long"), many - 1), lambda b: at * step + b)).otherwise(F.array().cast("array<bigint>"))
    others_of = F.concat(rest(level, F.col("blocks")), rest(level + 1, F.col("up")), rest(level - 1, F.col("down")))
    spread = sets.withColumn("other", F.explode_outer(others_of)).select("cluster", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "tokens")
    spread = spread.repartition(n, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")
    links = cut(spread.mapInArrow(lambda it: links_of(it, t), "u long, v long, n long"))

    groups = star(links.where("n = 0").select("u", "v"))
    numbers = links.where("n > 0").groupBy("u").agg(F.sum("n").alias("n_links")).withColumnRenamed("u", "node")
    found = classes.drop("n").join(groups, "node", "left").join(numbers, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = found.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first")).select(apart("root").alias("root"), "component_id", "first")
    found = found.drop("first").join(least, "root").select("c1", "c2", "component_id", "first", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.col("n").eqNullSafe(0) | (F.col("id").eqNullSafe(F.col("first.id")) & (F.col("th") == F.col("first.th")))
    more = [F.col("th"), kept.alias("kept")] if with_kept else []
    return profiles.join(found, ["c1", "c2"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), own.alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), *more)


def aliases(classes: DataFrame) -> dict[tuple[int, int], int]:
    """Other numbers for all but one of the classes (c1, c2) that share c1: of N classes about N**2 / 2**65, so few."""
    again = classes.groupBy("c1").agg(F.count("*").alias("k")).where("k > 1").select("c1")
    out: dict[tuple[int, int], int] = {}
    last = None
    if again.isEmpty():
        return out
    for r in classes.join(again, "c1").select("c1", "c2").orderBy("c1", "c2").collect():
        key = r.c1 % (1 << 64), r.c2 % (1 << 64)
        if r.c1 == last:
            other = key[1]
            while other in out.values() or not classes.where(F.col("c1") == signed(other)).isEmpty():
                other = (other * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            out[key] = other
        last = r.c1
    return out


def blocked(wanted: DataFrame, t: int) -> DataFrame:
    """wanted with block (level and number in one) and how many blocks its level, the next (up) and the last (down) have.

    A cluster of one block has level 0. Else similar sets are of one level or of
    neighbours, by the logarithm of their sizes; the base is a little wide, so that
    rounding can't part them.
    """
    by_cluster = wanted.groupBy("cluster").agg(F.count("*").alias("k"), F.sum("n").alias("tokens"))
    large = by_cluster.where((F.col("k") > BLOCK) | (F.col("tokens") > BLOCK_TOKENS)).select("cluster", F.lit(True).alias("large"))
    level = F.when(F.col("large"), F.floor(F.log(F.col("n")) / F.lit(math.log(100 / t) * 1.0001 if t < 100 else 1.0)).cast("long") + 1).otherwise(F.lit(0).cast("long"))
    levelled = wanted.join(large, "cluster", "left").withColumn("level", level).drop("large")
    many = F.greatest(F.least(F.lit(16), F.ceil(F.count("*") / BLOCK)), F.ceil(F.count("*") / PAIRED), F.ceil(F.sum("n") / BLOCK_TOKENS)).cast("long")
    # by a key of its own: else the sums would follow the join's dealing, a cluster to a task
    counts = levelled.where("level > 0").groupBy(apart("cluster").alias("cluster"), "level").agg(many.alias("blocks"))
    order = Window.partitionBy("cluster").orderBy("level")
    near = lambda f, by: F.when(f("level").over(order) == F.col("level") + by, f("blocks").over(order)).otherwise(F.lit(0)).cast("long")
    counts = counts.select("cluster", "level", "blocks", near(F.lead, 1).alias("up"), near(F.lag, -1).alias("down"))
    out = levelled.join(counts, ["cluster", "level"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.col("level") * F.lit(1 << 32).cast("long") + F.pmod(F.xxhash64("node"), F.col("blocks"))
    return out.withColumn("block", block).fillna(0, ["up", "down"]).drop("level")
