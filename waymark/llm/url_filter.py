"""URL allow and block rules as a sort-merge range join."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import shuffle_partitions

#: Above every character of a key, so key + TOP ends the interval of what lies under key.
TOP = "\U0010ffff"

#: Urls sampled for each interval when cut points are chosen, and their characters that count.
SAMPLE_PER_PART = 20
PLACE = 256


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without :// or url."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column) -> Column:
    """Labels from the last to the first, each ended by a dot: subdomains share their parent's prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def below(cuts: list[str], at: Column) -> Column:
    """How many of the sorted cuts are not above at, by halving steps."""
    bounds = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<string>")
    steps = F.array(*(F.lit(1 << b) for b in reversed(range(max(1, len(cuts).bit_length())))))
    # get() is null beyond the end
    return F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get(bounds, n + step - 1) <= at, n + step).otherwise(n))


def sweep(batches, default: str):
    """Judges sorted rows with a stack of the rules whose host interval is open.

    Rows come by part, key and kind (rules before urls), so that the stack's
    hosts are always ancestors of the current key. An entry holds its host's
    paths by length; the longest fitting rule string wins, then the longer host.
    """
    part, stack = None, []
    for batch in batches:
        out = {"row": [], "rule": [], "verdict": []}
        columns = (batch.column(c).to_pylist() for c in ("part", "key", "is_url", "path", "row", "name", "verdict"))
        for p, key, is_url, path, row, name, verdict in zip(*columns):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if not is_url:
                if not stack or stack[-1][0] != key:
                    stack.append((key, {}))
                stack[-1][1].setdefault(len(path), {})[path] = (name, verdict)
                continue
            best = None
            for host, paths in stack:
                for n, rules in paths.items():
                    found = rules.get(path[:n])
                    if found and (best is None or (len(found[0]), len(host)) > best[0]):
                        best = (len(found[0]), len(host)), found
            out["row"].append(row)
            out["rule"].append(best[1][0] if best else None)
            out["verdict"].append(best[1][1] if best else default)
        yield pa.RecordBatch.from_pydict({"row": pa.array(out["row"], batch.schema.field("row").type), "rule": pa.array(out["rule"], pa.string()), "verdict": pa.array(out["verdict"], pa.string())})


def filter_urls(pages: DataFrame, rules: DataFrame | list[Rule], url_col: str = "url", id_col: str = "page_id", default: str = "allow", parts: int | None = None) -> DataFrame:
    """Judges every row of pages: id_col, host, path, rule, verdict.

    rules: Rule objects, or a DataFrame (host, path, verdict) of any size. A rule
    fits its host and all subdomains where the path starts with the rule's; the
    longest rule string wins; where none fits, rule is null and verdict default.
    Null urls and urls without :// have an empty host and path, and no rule.
    Equal rules given twice count once, with the verdict that sorts last (block
    wins over allow). Repeated pages and null ids are judged each; empty
    tables give none. Other columns are not read; urls may have any length.

    Reversed hosts make a rule an interval of keys. Cut points (one per shuffle
    partition, from a sample; they steer balance only) lie between (key, path, id),
    so a hot host spreads over parts; a row's part is found by binary search, and
    parts are shuffle partitions. A rule goes to each part that its interval
    meets: parts are cut inside at most one chain of nested hosts, so copies stay
    below rules + parts * depth. Each part is then swept in order.
    """
    spark = pages.sparkSession
    if isinstance(rules, list):
        rules = spark.createDataFrame([(r.host, r.path, r.verdict) for r in rules], "host string, path string, verdict string")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).where("host is not null and path is not null and host <> ''")
    rules = rules.select(key_of(F.col("host")).alias("key"), "path", "verdict", F.concat("host", "path").alias("name"))
    host = host_of(F.coalesce(F.col(url_col), F.lit("")))
    urls = pages.select(F.col(id_col).alias("id"), host.alias("host"), path_of(F.coalesce(F.col(url_col), F.lit(""))).alias("path"))
    urls = urls.withColumn("key", key_of(F.col("host")))
    n = parts or shuffle_partitions(pages)
    place = F.substring(F.concat_ws("\0", F.col("key"), F.col("path"), F.lpad(F.hex(F.xxhash64("id")), 16, "0")), 1, PLACE)
    total = pages.count()
    share = min(1.0, SAMPLE_PER_PART * n / max(1, total))
    sample = sorted(r[0] for r in urls.select(place.alias("place")).sample(share, seed=11).limit(4 * SAMPLE_PER_PART * n).collect())
    cuts = sorted({sample[i * len(sample) // n] for i in range(1, n)}) if sample else []
    part = lambda at: below(cuts, at)
    urls = urls.select(part(place).alias("part"), "key", F.lit(True).alias("is_url"), "path", F.struct("id", "host", "path").alias("row"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("verdict"))
    first, last = part(F.col("key")), part(F.concat(F.col("key"), F.lit(TOP)))
    rules = rules.withColumn("part", F.explode(F.sequence(first, last)))
    rules = rules.select("part", "key", F.lit(False).alias("is_url"), "path", F.lit(None).cast(urls.schema["row"].dataType).alias("row"), "name", "verdict")
    rows = urls.unionByName(rules).repartitionById(n, "part").sortWithinPartitions("part", "key", "is_url")
    kind = urls.schema["row"].dataType.simpleString()
    judged = rows.mapInArrow(lambda it: sweep(it, default), f"row {kind}, rule string, verdict string")
    return judged.select(F.col("row.id").alias(id_col), "row.host", "row.path", "rule", "verdict")
