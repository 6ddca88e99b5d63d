"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, weighted shingles.

Only DataFrame expressions: nothing here runs Python on the executors.
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from .common import broadcast_sized, cut

#: Words of a shingle, and the similarity that counts as a leak, in percent.
SHINGLE = 5
SIMILAR = 80

#: Fingerprints this many bits apart are candidates; two sets 80 % alike are 10 bits apart on average.
RADIUS = 16

#: Bits of the fingerprint's blocks.
BLOCKS = (13, 13, 13, 13, 12)

#: Rows up to which a table made from the benchmark is broadcast; beyond, joins shuffle.
BROADCAST = 1 << 16

#: Window starts that a row of a document's hashes is for.
SEGMENT = 4096

#: Bits of the filter that marks documents which may hold an anchor, and where its hashes lie in a shingle's.
FILTER_BITS = 1 << 18
FILTER_SHIFTS = (0, 18, 36, 46)

#: What parts words: blanks and ASCII punctuation.
GAPS = r"[\s\p{Punct}]+"

WINDOW = ["seg", "m", "start"]

# Arrays are exploded by the outer functions: for the others the optimiser filters
# on the array's size first, and computes its expression anew, inside lambdas too.


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), "")


def shingles_of(words: Column, size: int) -> Column:
    """Hash of each run of size words. words must be a column, which lambdas would else compute anew."""
    made = F.size(words) - F.lit(size - 1)
    return F.when(made > 0, F.transform(F.slice(words, 1, made), lambda w, i: F.xxhash64(w, *(F.get(words, i + j) for j in range(1, size))))).otherwise(F.array().cast("array<bigint>"))


def fingerprint() -> list[Column]:
    """64-bit SimHash as aggregates over rows (g: hash, weight: whole number); each sum holds the weights of two bits."""
    pairs = [F.sum(F.shiftright("g", b).bitwiseAND(F.lit(0x100000001)) * F.col("weight")).alias(f"s{b}") for b in range(32)]
    return [*pairs, F.sum("weight").alias("all")]


def bits_of_sums() -> Column:
    """The fingerprint: a bit is set where the rows that have it weigh more than half of all."""
    out = F.lit(0).cast("long")
    for b in range(32):
        for at, own in ((b, F.col(f"s{b}").bitwiseAND(F.lit(0xFFFFFFFF))), (b + 32, F.shiftrightunsigned(f"s{b}", 32))):
            out = out.bitwiseOR(F.when(2 * own > F.col("all"), F.lit((1 << at) - ((1 << 64) if at == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def longs(values: list[int]) -> Column:
    """A constant array, as one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def flips(radius: int) -> list[list[int]]:
    """For each block the patterns of bits to flip, such that two fingerprints within the radius meet in some block.

    A block is searched up to a distance of its own. These are chosen so that, were
    two fingerprints further apart than that in every block, they would be more
    than radius apart in all.
    """
    n = len(BLOCKS)
    own = [(radius + 1) // n - 1 + (i < (radius + 1) % n) for i in range(n)]
    return [[sum(1 << x for x in at) for t in range(r + 1) for at in itertools.combinations(range(size), t)] for size, r in zip(BLOCKS, own)]


def blocks(fp: Column, radius: int | None = None) -> Column:
    """Join keys of a fingerprint, number and value of each block in a long; with a radius, of all values so near."""
    patterns = flips(radius) if radius is not None else [[0]] * len(BLOCKS)
    out = []
    for i, (size, own) in enumerate(zip(BLOCKS, patterns)):
        value = F.shiftrightunsigned(fp, sum(BLOCKS[:i])).bitwiseAND(F.lit((1 << size) - 1)).bitwiseOR(F.lit(i << 32).cast("long"))
        out.append(F.transform(longs(own), lambda p, v=value: v.bitwiseXOR(p)) if own else F.array().cast("array<bigint>"))
    return F.flatten(F.array(*out))


def items_of(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, item_id, m, width, g): the shingles of each item; width words each, fewer in shorter items.

    item stands for the id and the words.
    """
    words = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0").dropDuplicates()
    words = words.withColumn("item", F.xxhash64("item_id", "words")).withColumn("m", F.size("words")).withColumn("width", F.least("m", F.lit(size)))
    short = reduce(lambda x, s: x.when(F.col("width") == s, shingles_of(F.col("words"), s)), range(1, size), F.when(F.col("width") == size, shingles_of(F.col("words"), size)))
    return words.select("item", "item_id", "m", "width", F.explode_outer(short).alias("g")).where("g is not null")


def slot(g: Column, shift: int) -> Column:
    return F.shiftrightunsigned(g, shift).bitwiseAND(F.lit(FILTER_BITS - 1)).cast("int")


def filter_of(anchors: DataFrame) -> Column:
    """A Bloom filter of the anchors' shingles as a constant array of FILTER_BITS bits, however many they are."""
    slots = anchors.select(F.explode(F.array(*(slot(F.col("g"), s) for s in FILTER_SHIFTS))).alias("s"))
    rows = slots.groupBy(F.shiftright("s", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, s & 63)")).alias("bits")).collect()
    held = {r["at"]: r["bits"] for r in rows}
    return longs([held.get(i, 0) for i in range(FILTER_BITS // 64)])


def may_hold(g: Column, marks: Column) -> Column:
    tests = (F.getbit(F.get(marks, F.shiftright(slot(g, s), 6)), slot(g, s).bitwiseAND(F.lit(63))) == 1 for s in FILTER_SHIFTS)
    return reduce(lambda a, b: a & b, tests)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", size: int = SHINGLE, similar: int = SIMILAR, radius: int = RADIUS) -> DataFrame:
    """Which documents hold a passage as long as a benchmark item and similar percent like it or more.

    Returns a row per document and item: id_col, item_id, similarity (of the best
    window), start and length (its words; of equal ones the first). Words are
    lower-cased and lie between blanks and ASCII punctuation; similarity is the
    weighted Jaccard similarity of size-word shingles with their numbers, a shingle
    weighing more the fewer items hold it. An item of fewer words is one shingle; a
    document of fewer words than an item is one window; items and documents
    without words match nothing. Repeated documents (id and text) and repeated
    items count once; items of one id and other texts are compared each, and the
    best counts. Null ids are ids; documents of one id and other texts, or without
    ids, have rows of their own. Other columns are not read. Empty tables give no
    rows. A document is split and hashed whole, some fifty bytes for each word;
    from then on SEGMENT words at a time.

    1. A similar window shares one at least of an item's rarest shingles (those of
       more than 100 - similar percent of its weight), its anchors. A filter of all
       anchors drops most documents in the only scan of the texts; of the others
       the shingles' hashes go on.
    2. Every window of an item's length that holds an anchor of such an item, at
       each of the anchor's places, gets a weighted SimHash of 64 bits. No other
       window of that length can be similar.
    3. The fingerprints' blocks are join keys, with the length. Items are listed
       under all values so near to their own that every pair within the radius
       meets (flips()), but of chance pairs one in eight; the distance is then tested.
    4. The weighted similarity of these candidates is computed exactly.

    A window of exactly 80 % lies beyond 16 bits in about 1 of 70 cases; verbatim
    copies never do.
    """
    items = cut(items_of(benchmark, item_id_col, item_text_col, size))
    n_rows = items.count()
    n_items = items.select("item").distinct().count()
    df = items.groupBy("g").agg(F.countDistinct("item").alias("df"))
    weights = cut(df.select("g", "df", F.round(100 * (1 + F.log(F.lit(n_items) / F.col("df")))).cast("long").alias("weight")))
    most = round(100 * (1 + math.log(max(1, n_items))))
    parts = cut(items.groupBy("item", "item_id", "m", "width", "g").agg(F.count("*").alias("n")).join(weights, "g"))
    total = F.sum(F.col("n") * F.col("weight"))
    whole = Window.partitionBy("item")
    rarest = whole.orderBy("df", "g").rowsBetween(Window.unboundedPreceding, -1)
    anchors = parts.withColumn("before", F.coalesce(total.over(rarest), F.lit(0))).withColumn("all", total.over(whole))
    anchors = cut(anchors.where(100 * F.col("before") <= (100 - similar) * F.col("all")).select("g", "m", "width").distinct())
    longest = {r.width: r.m for r in anchors.groupBy("width").agg(F.max("m").alias("m")).collect()}

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text")).where("text <> ''")
    if not longest:
        return rows.limit(0).select(F.col("id").alias(id_col), F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("start"), F.lit(0).alias("length"))
    words = rows.select("id", "th", words_of(F.col("text")).alias("words"))
    hashed = words.select("id", "th", F.size("words").alias("n_words"), F.explode_outer(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(m).alias("longest"), shingles_of(F.col("words"), w).alias("h")) for w, m in longest.items()))).alias("x"))
    hashed = hashed.select("id", "th", "n_words", "x.*")
    marks = filter_of(anchors)
    hashed = hashed.where(F.exists("h", lambda g: may_hold(g, marks)))
    # rows overlap by the longest item, so that each holds the windows that start in it
    bases = F.sequence(F.lit(0), F.size("h") - 1, F.lit(SEGMENT))
    segments = F.transform(bases, lambda a: F.struct(a.alias("base"), F.slice("h", a + 1, F.lit(SEGMENT) + F.col("longest")).alias("h")))
    segments = hashed.select("id", "th", "n_words", "width", F.explode_outer(segments).alias("x")).select("id", "th", "n_words", "width", "x.*").dropDuplicates(["id", "th", "width", "base"])
    segments = cut(segments.withColumn("seg", F.monotonically_increasing_id()))

    places = segments.select("seg", "base", "n_words", "width", F.posexplode_outer("h").alias("at", "g"))
    hits = places.join(broadcast_sized(anchors, n_rows, BROADCAST), ["width", "g"]).withColumn("pos", F.col("base") + F.col("at"))
    low = F.greatest(F.col("base"), F.col("pos") - F.col("m") + F.col("width"))
    high = F.least(F.col("pos"), F.col("base") + SEGMENT - 1, F.greatest(F.col("n_words") - F.col("m"), F.lit(0)))
    windows = hits.select("seg", "m", F.explode_outer(F.when(low <= high, F.sequence(low, high))).alias("start")).where("start is not null").distinct()

    def shingles(of: DataFrame) -> DataFrame:
        """Each window's shingles as rows (g)."""
        held = of.join(segments.select("seg", "base", "n_words", "width", "h"), "seg")
        own = F.slice("h", F.col("start") - F.col("base") + 1, F.least("m", "n_words") - F.col("width") + 1)
        return held.select(*of.columns, F.explode_outer(own).alias("g"))

    weighed = shingles(windows).join(broadcast_sized(weights.select("g", "weight"), n_rows, BROADCAST), "g", "left").withColumn("weight", F.coalesce("weight", F.lit(most)))
    prints = weighed.groupBy(*WINDOW).agg(*fingerprint()).select(*WINDOW, "all", bits_of_sums().alias("fp"))
    item_prints = parts.withColumn("weight", F.col("n") * F.col("weight")).groupBy("item", "item_id", "m").agg(*fingerprint())
    item_prints = cut(item_prints.select("item", "item_id", "m", F.col("all").alias("item_all"), bits_of_sums().alias("item_fp")))
    listed = item_prints.select("item", "m", "item_fp", F.explode(blocks(F.col("item_fp"), radius)).alias("key"))
    met = prints.select("*", F.explode(blocks(F.col("fp"))).alias("key")).join(broadcast_sized(listed, n_items * sum(map(len, flips(radius))), BROADCAST), ["m", "key"])
    near = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).drop("key", "fp", "item_fp").distinct()
    near = cut(near.join(broadcast_sized(item_prints.select("item", "item_id", "item_all"), n_items, BROADCAST), "item"))

    theirs = broadcast_sized(parts.select("item", "g", F.col("n").alias("item_n"), "weight"), n_rows, BROADCAST)
    common = shingles(near).join(theirs, ["item", "g"]).groupBy(*near.columns, "g", "item_n", "weight").agg(F.count("*").alias("n"))
    alike = common.groupBy(*near.columns).agg(F.sum(F.least("n", "item_n") * F.col("weight")).alias("inter"))
    alike = alike.withColumn("union", F.col("all") + F.col("item_all") - F.col("inter")).where(100 * F.col("inter") >= similar * F.col("union"))
    alike = alike.withColumn("similarity", F.col("inter") / F.col("union")).join(segments.select("seg", "id", "th", "n_words"), "seg")
    best = alike.groupBy("id", "th", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), F.least("m", "n_words").alias("length"))).alias("b"))
    return best.select(F.col("id").alias(id_col), "item_id", "b.similarity", (-F.col("b.back")).alias("start"), "b.length")
