"""The registered path queries over the handoff graph of events, and their SQL."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from .functions import paths as L
from .operators.expand import product_edges
from .plans.constraints import PyConstraint, adjacent_equal, all_of, monotonic, naive, py_trail, range_bound, risk_then_fraud, same_value, sum_at_least
from .plans.nfa import Nfa, compile_regex, simple
from .plans.query import PathQuery, counted, recursive_sql, shared_folder
from .sources.graphs import edge_json, handoff, preview, read_edges, read_label, read_nfa, read_nodes, with_edge_ids, write_by_label, write_nfa

START, MIN, MAX = 1, 2, 3

#: Half of 30 days in seconds.
BOUND = 2592000 / 2

VIEW_CLICK = compile_regex("(view|click)+")

GENERAL = Nfa(
    tuple((f, t, x) for x in ("view", "click", "purchase") for f, t in ((0, 1), (1, 1))) + tuple((f, t, x) for x in ("error", "signup") for f, t in ((1, 2), (2, 2))),
    (0,),
    (2,),
)


#: Where the session's graphs lie, by table folder.
LOADED: dict[tuple[str, str], str] = {}


def load(spark: SparkSession, sf_dir: str) -> str:
    """Writes the handoff graph to the session's shared folder; queries of the session read it there."""
    path = f"{shared_folder(spark)}/graph-{uuid.uuid4().hex}"
    handoff(spark.read.parquet(f"{sf_dir}/events.parquet")).write.parquet(path)
    LOADED[spark.sparkContext.applicationId, sf_dir] = path
    return path


def graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = LOADED.get((spark.sparkContext.applicationId, sf_dir))
    if path is not None:
        there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path = path if there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there) else None
    return spark.read.parquet(path or load(spark, sf_dir))


def query(spark, sf_dir, constraint=None, nfa=VIEW_CLICK, max_len=MAX, starts=(START,), **more) -> PathQuery:
    return PathQuery(graph(spark, sf_dir), nfa, list(starts), max_len, MIN, constraint, **more)


def general():
    return all_of(same_value("region", "bigint"), monotonic("timestamp_ms", "bigint"), risk_then_fraud("risk_score", 20, 40), sum_at_least("amount", 100))


def late(spark, sf_dir, columns: tuple[str, ...], keep, nfa=VIEW_CLICK) -> DataFrame:
    """The query that collects lists and judges complete paths only."""
    found = query(spark, sf_dir, nfa=nfa).with_walks("edge_id", *columns).paths()
    return counted(found.where(L.is_trail(F.col("edge_ids")) & keep), "path_length")


# ---- Python constraints: state is JSON-like; nulls come as None

MONOTONIC_PY = PyConstraint(
    lambda: {"last": None},
    lambda D, f, t, e: {"last": e["weight"]},
    lambda D, f, t, e: D["last"] is None or e["weight"] is not None and e["weight"] > D["last"],
    columns=("weight",),
    state="last bigint",
)

TWO_COLOR_PY = PyConstraint(
    lambda: {"color": None, "seen": False},
    lambda D, f, t, e: {"color": e["color"], "seen": D["seen"] or (D["color"] is not None and D["color"] == e["color"])},
    is_valid_final=lambda D: D["seen"],
    columns=("color",),
    state="color bigint, seen boolean",
)


def spread_py(inclusive: bool) -> PyConstraint:
    def after(D, e):
        known = [x for x in (D["low"], D["high"], e["weight"]) if x is not None]
        return min(known), max(known)

    def valid(D, f, t, e):
        if e["weight"] is None and D["low"] is None:
            return False
        low, high = after(D, e)
        return high - low <= BOUND if inclusive else high - low < BOUND

    def update(D, f, t, e):
        low, high = after(D, e)
        return {"low": low, "high": high}

    return PyConstraint(lambda: {"low": None, "high": None}, update, valid, columns=("weight",), state="low bigint, high bigint")


def general_update(D, f, t, e):
    risks = [x for x in (D["low"], D["high"], e["risk_score"]) if x is not None]
    return {"low": min(risks, default=None), "high": max(risks, default=None), "last": e["risk_score"], "time": e["timestamp_ms"], "region": e["region"], "amount": D["amount"] + e["amount"]}


def general_valid(D, f, t, e):
    if D["region"] is not None and D["region"] != e["region"] or D["time"] is not None and e["timestamp_ms"] <= D["time"]:
        return False
    after = general_update(D, f, t, e)
    if t == 1:
        return D["high"] is None or after["high"] - after["low"] <= 20
    return f == 2 or f == 1 and D["last"] is not None and D["last"] >= 40


GENERAL_PY = PyConstraint(
    lambda: {"low": None, "high": None, "last": None, "time": None, "region": None, "amount": 0.0},
    general_update,
    general_valid,
    lambda D: D["amount"] >= 100,
    columns=("risk_score", "timestamp_ms", "region", "amount"),
    state="low double, high double, last double, time bigint, region bigint, amount double",
)

NAIVE_PY = naive(lambda D: len({e["edge_id"] for e in D}) == len(D) and all(a["weight"] < b["weight"] for a, b in zip(D, D[1:])), ("edge_id", "weight"))


# ---- queries

QUERIES = {}
SQL = {}


def register(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


EDGES = """e AS (
  SELECT *, k % 8 AS color, k % 4 AS region FROM (
    SELECT event_id AS edge_id, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, event_type AS label, value AS amount,
           least(value, 100.0) AS risk_score, epoch_us(ts) // 1000 AS timestamp_ms, epoch_us(ts) // 1000000 AS weight, CAST(json_extract(props, '$.k') AS BIGINT) AS k
    FROM events) WHERE dst IS NOT NULL)"""
PLAIN = [(0, 0, "view"), (0, 0, "click")]
TRAIL = {"ids": ("[]::BIGINT[]", "list_append(ids, edge_id)")}
NEW = "NOT list_contains(ids, edge_id)"
MONO = {"w": ("NULL::BIGINT", "e.weight")}
LATER = "(w IS NULL OR e.weight > w)"
SPREAD = {"mn": ("NULL::BIGINT", "least(mn, weight)"), "mx": ("NULL::BIGINT", "greatest(mx, weight)")}
NEAR = "greatest(mx, weight) - least(mn, weight) <= 1296000"
COLORS = {"lc": ("NULL::BIGINT", "color"), "ok": ("false", "(ok OR coalesce(lc = color, false))")}
RISK = {
    "mx": ("NULL::DOUBLE", "greatest(mx, risk_score)"), "mn": ("NULL::DOUBLE", "least(mn, risk_score)"), "lr": ("NULL::DOUBLE", "risk_score"),
    "lt": ("NULL::BIGINT", "timestamp_ms"), "rg": ("NULL::BIGINT", "region"), "am": ("0::DOUBLE", "am + amount"),
}
RISKY = """(rg IS NULL OR rg = region) AND (lt IS NULL OR timestamp_ms > lt) AND
  (CASE WHEN n.t = 1 THEN mx IS NULL OR greatest(mx, risk_score) - least(mn, risk_score) <= 20 WHEN s = 1 AND n.t = 2 THEN lr >= 40 ELSE true END)"""
BY_LENGTH = "SELECT d AS path_length, count(*) AS n_paths"


def oracle(state=None, valid="true", where="true", select=BY_LENGTH, group="GROUP BY d", moves=PLAIN, accept=(0,), initial=(0,), starts=(START,), max_len=MAX) -> str:
    state = state or {}
    values = ", ".join(f"({f}, {t}, '{x}')" for f, t, x in moves)
    base = " UNION ALL ".join(f"SELECT {x}::BIGINT AS start, {x}::BIGINT AS v, {i} AS s, 0 AS d" + "".join(f", {a} AS {c}" for c, (a, _) in state.items()) for x in starts for i in initial)
    after = "".join(f", {b}" for _, b in state.values())
    return f"""WITH RECURSIVE {EDGES}, n(f, t, label) AS (VALUES {values}), base AS ({base}),
p AS (SELECT * FROM base UNION ALL SELECT start, e.dst, n.t, d + 1{after}
 FROM p JOIN e ON e.src = p.v JOIN n ON n.f = p.s AND n.label = e.label WHERE d < {max_len} AND {valid})
{select} FROM p WHERE d >= {MIN} AND s IN ({", ".join(map(str, accept))}) AND {where} {group}"""


Q1_SQL = oracle(RISK | TRAIL, f"{RISKY} AND {NEW}", "am >= 100", moves=GENERAL.transitions, accept=(2,))
Q2_SQL = oracle(COLORS | TRAIL, NEW, "ok")
Q3_SQL = oracle(MONO | TRAIL, f"{LATER} AND {NEW}")
Q4_SQL = oracle(SPREAD | TRAIL, f"{NEAR} AND {NEW}")
WALK_SQL = oracle()


@register(WALK_SQL)
def walk_count(spark, sf_dir):
    return query(spark, sf_dir, semantics="walk", grouped=True).by_length()


@register(Q1_SQL)
def q1_base(spark, sf_dir):
    times, risks, amounts = F.col("timestamp_mss"), F.col("risk_scores"), F.col("amounts")
    states = F.col("labels")
    fraud = F.filter(L.positions(states), lambda i: F.get(states, i).isin("error", "signup"))
    cut = F.array_min(fraud)
    normal = F.slice(risks, 1, cut)
    keep = L.all_same(F.col("regions")) & L.strictly_increasing(times) & L.spread_at_most(normal, 20) & (L.last(normal) >= 40) & (L.total(amounts) >= 100)
    return late(spark, sf_dir, ("timestamp_ms", "risk_score", "amount", "region", "label"), keep, GENERAL)


@register(Q1_SQL)
def q1_inline(spark, sf_dir):
    return query(spark, sf_dir, general(), GENERAL).by_length()


@register(Q1_SQL)
def q1_udf(spark, sf_dir):
    return query(spark, sf_dir, (GENERAL_PY, py_trail()), GENERAL, semantics="walk").by_length()


@register(oracle(RISK | TRAIL, f"{RISKY} AND {NEW}", "am >= 100", moves=GENERAL.transitions, accept=(2,), max_len=4))
def q1_grouped(spark, sf_dir):
    return query(spark, sf_dir, general(), GENERAL, 4, grouped=True).by_length()


@register(Q2_SQL)
def q2_base(spark, sf_dir):
    return late(spark, sf_dir, ("color",), L.any_adjacent_equal(F.col("colors")))


@register(Q2_SQL)
def q2_inline(spark, sf_dir):
    return query(spark, sf_dir, adjacent_equal("color", "bigint")).by_length()


@register(Q2_SQL)
def q2_udf(spark, sf_dir):
    return query(spark, sf_dir, (TWO_COLOR_PY, py_trail()), semantics="walk").by_length()


@register(oracle(COLORS, where="ok"))
def q2_walk(spark, sf_dir):
    """Two-colour walks: edges may repeat."""
    return query(spark, sf_dir, adjacent_equal("color", "bigint"), semantics="walk", grouped=True).by_length()


@register(WALK_SQL)
def q3_base(spark, sf_dir):
    """What the unpruned variant counts: all walks, with their lists gathered."""
    return query(spark, sf_dir).with_walks("weight", "edge_id").by_length()


@register(Q3_SQL)
def q3_late(spark, sf_dir):
    return late(spark, sf_dir, ("weight",), L.strictly_increasing(F.col("weights")))


@register(Q3_SQL)
def q3_inline(spark, sf_dir):
    return query(spark, sf_dir, monotonic("weight", "bigint")).by_length()


@register(Q3_SQL)
def q3_udf(spark, sf_dir):
    return query(spark, sf_dir, (MONOTONIC_PY, py_trail()), semantics="walk").by_length()


@register(oracle(MONO, LATER, max_len=4))
def q3_grouped(spark, sf_dir):
    return query(spark, sf_dir, monotonic("weight", "bigint"), max_len=4, grouped=True).by_length()


@register(Q3_SQL)
def q3_pruned(spark, sf_dir):
    """With frontier rows dropped that can't reach acceptance in the steps that are left."""
    return query(spark, sf_dir, monotonic("weight", "bigint"), pruned=True).by_length()


@register(WALK_SQL)
def q4_base(spark, sf_dir):
    return query(spark, sf_dir).with_walks("weight").by_length()


@register(Q4_SQL)
def q4_late(spark, sf_dir):
    return late(spark, sf_dir, ("weight",), L.spread_at_most(F.col("weights"), BOUND))


@register(Q4_SQL)
def q4_inline(spark, sf_dir):
    return query(spark, sf_dir, range_bound("weight", BOUND, kind="bigint")).by_length()


@register(Q4_SQL)
def q4_udf(spark, sf_dir):
    return query(spark, sf_dir, (spread_py(True), py_trail()), semantics="walk").by_length()


@register(oracle(SPREAD | TRAIL, f"{NEAR.replace('<=', '<')} AND {NEW}"))
def q4_exclusive(spark, sf_dir):
    return query(spark, sf_dir, range_bound("weight", BOUND, False, "bigint")).by_length()


@register(Q4_SQL)
def q4_reduce(spark, sf_dir):
    """The spread by folds over the list, seeded with its first element."""
    xs = F.col("weights")
    spread = L.reduce_first(xs, lambda a, x: F.greatest(a, x)) - L.reduce_first(xs, lambda a, x: F.least(a, x))
    return late(spark, sf_dir, ("weight",), spread <= BOUND)


# the same questions as quantifiers and folds over gathered lists


@register(Q1_SQL)
def cypher_general(spark, sf_dir):
    """The general path by quantifiers over the list of edges, gathered as one struct list."""
    found = query(spark, sf_dir, nfa=GENERAL).with_walks("edge_id", "timestamp_ms", "risk_score", "amount", "region", "label").paths()
    xs = F.arrays_zip("edge_ids", "timestamp_mss", "risk_scores", "amounts", "regions", "labels")
    bad = lambda e: e["labels"].isin("error", "signup")
    normal = F.filter(xs, lambda e: ~bad(e))
    risks = F.transform(normal, lambda e: e["risk_scores"])
    apart = lambda i: F.forall(L.positions(xs), lambda j: (j <= i) | (F.get(xs, i)["edge_ids"] != F.get(xs, j)["edge_ids"]))
    places = F.sequence(F.lit(0), F.size(xs) - 1)
    keep = F.forall(places, apart) & F.forall(xs, lambda e: e["regions"] == F.get(xs, F.lit(0))["regions"])
    keep &= F.forall(L.positions(xs), lambda i: F.get(xs, i)["timestamp_mss"] > F.get(xs, i - 1)["timestamp_mss"])
    keep &= (F.array_max(risks) - F.array_min(risks) <= 20) & (L.last(risks) >= 40)
    keep &= F.aggregate(xs, F.lit(0.0), lambda a, e: a + e["amounts"]) >= 100
    return counted(found.where(keep), "path_length")


@register(Q2_SQL)
def cypher_two_color(spark, sf_dir):
    xs = F.col("colors")
    return late(spark, sf_dir, ("color",), F.exists(F.arrays_zip(xs, F.slice(xs, 2, F.size(xs)).alias("next")), lambda p: F.coalesce(p["colors"] == p["next"], F.lit(False))))


@register(oracle(COLORS, where="ok"))
def cypher_two_color_walk(spark, sf_dir):
    found = query(spark, sf_dir).with_walks("color").paths()
    return counted(found.where(L.any_adjacent_equal(F.col("colors"))), "path_length")


@register(Q3_SQL)
def cypher_monotonic(spark, sf_dir):
    xs = F.col("weights")
    rising = F.aggregate(xs, F.struct(F.lit(True).alias("ok"), F.lit(None).cast("bigint").alias("w")), lambda a, x: F.struct((a["ok"] & F.coalesce(x > a["w"], F.lit(True))).alias("ok"), x.alias("w")))
    return late(spark, sf_dir, ("weight",), rising["ok"])


@register(Q4_SQL)
def cypher_max_min(spark, sf_dir):
    """Largest minus smallest as: no two edges lie further apart."""
    xs = F.col("weights")
    near = F.forall(xs, lambda a: F.forall(xs, lambda b: a - b <= BOUND))
    return late(spark, sf_dir, ("weight",), near)


@register(oracle(TRAIL, NEW, moves=[(0, 1, "purchase"), (1, 1, "purchase")], accept=(1,)))
def regex_plus(spark, sf_dir):
    return query(spark, sf_dir, nfa=simple("purchase+")).by_length()


@register(oracle(TRAIL, NEW, moves=[(0, 1, "view"), (0, 1, "click"), (1, 2, "error"), (1, 1, "view"), (1, 1, "click")], accept=(2,)))
def regex_alternation(spark, sf_dir):
    return query(spark, sf_dir, nfa=compile_regex("(view | click)+ error")).by_length()


@register(oracle(moves=[(0, 1, "view"), (1, 2, "click"), (2, 2, "click")], accept=(1, 2), select="SELECT s AS nfa_state, d AS path_length, count(*) AS n_paths", group="GROUP BY s, d"))
def multi_accepting(spark, sf_dir):
    nfa = Nfa(((0, 1, "view"), (1, 2, "click"), (2, 2, "click")), (0,), (1, 2))
    return counted(query(spark, sf_dir, nfa=nfa, semantics="walk", grouped=True).paths(), "nfa_state", "path_length")


@register(oracle(moves=[(0, 1, "view"), (5, 1, "click"), (1, 1, "view")], accept=(1,), initial=(0, 5)))
def multi_initial(spark, sf_dir):
    nfa = Nfa(((0, 1, "view"), (5, 1, "click"), (1, 1, "view")), (0, 5), (1,))
    return query(spark, sf_dir, nfa=nfa, semantics="walk", grouped=True).by_length()


@register(oracle(MONO, LATER, starts=(1, 2, 3, 5, 8), select="SELECT start, count(*) AS n_paths", group="GROUP BY start"))
def multi_start(spark, sf_dir):
    return counted(query(spark, sf_dir, monotonic("weight", "bigint"), starts=(1, 2, 3, 5, 8), grouped=True).paths(), "start")


@register(oracle(moves=[(0, 1, "view"), (0, 2, "view"), (1, 1, "view"), (2, 2, "view")], accept=(1, 2)))
def ambiguous_runs(spark, sf_dir):
    """An ambiguous automaton counts each run."""
    nfa = Nfa(((0, 1, "view"), (0, 2, "view"), (1, 1, "view"), (2, 2, "view")), (0,), (1, 2))
    return query(spark, sf_dir, nfa=nfa, semantics="walk", grouped=True).by_length()


@register(oracle(moves=[(0, 0, "view")]))
def determinised_paths(spark, sf_dir):
    """The same automaton, determinised, counts each path once."""
    nfa = Nfa(((0, 1, "view"), (0, 2, "view"), (1, 1, "view"), (2, 2, "view")), (0,), (1, 2)).determinised()
    return query(spark, sf_dir, nfa=nfa, semantics="walk", grouped=True).by_length()


@register(oracle(MONO | TRAIL, f"{LATER} AND {NEW}", max_len=2))
def naive_python(spark, sf_dir):
    return query(spark, sf_dir, NAIVE_PY, max_len=2, semantics="walk").by_length()


@register(oracle(MONO | TRAIL, f"{LATER} AND {NEW}", select="SELECT v AS end_node, count(*) AS n_paths", group="GROUP BY v"))
def paths_by_end_node(spark, sf_dir):
    return query(spark, sf_dir, monotonic("weight", "bigint"), grouped=True).by_end_node()


@register(oracle(MONO | TRAIL, f"{LATER} AND {NEW}", select="SELECT count(*) AS n_paths", group=""))
def path_count(spark, sf_dir):
    return query(spark, sf_dir, monotonic("weight", "bigint"), grouped=True).count()


@register(oracle(MONO | TRAIL, f"{LATER} AND {NEW}", select="SELECT start, v AS end_node, d AS path_length, array_to_string(ids, ',') AS edge_ids", group=""))
def trail_listing(spark, sf_dir):
    found = replace(query(spark, sf_dir, monotonic("weight", "bigint")), collect=("edge_id",)).paths()
    return found.select("start", "end_node", "path_length", F.array_join(F.col("edge_ids").cast("array<string>"), ",").alias("edge_ids"))


@register(f"WITH {EDGES} SELECT edge_id, src, dst, label, amount, risk_score, timestamp_ms, weight, k, color, region FROM e")
def handoff_graph(spark, sf_dir):
    return handoff(spark.read.parquet(f"{sf_dir}/events.parquet"))


@register(f"WITH {EDGES} SELECT src, dst, label, weight, row_number() OVER (ORDER BY src, dst, label, weight) - 1 AS edge_id FROM e")
def edge_surrogate_id(spark, sf_dir):
    edges = graph(spark, sf_dir).select("src", "dst", "label", "weight")
    return with_edge_ids(edges, ["src", "dst", "label", "weight"])


@register(f"WITH {EDGES}, n(f, t, label) AS (VALUES {', '.join(str(x) for x in GENERAL.transitions)}) SELECT src, f AS from_state, dst, t AS to_state, edge_id FROM e JOIN n USING (label)")
def general_product_edges(spark, sf_dir):
    return product_edges(graph(spark, sf_dir), GENERAL, ("edge_id",))


@register(f"WITH {EDGES} SELECT edge_id, src, dst, label, amount, risk_score FROM e ORDER BY edge_id LIMIT 20")
def dataset_preview(spark, sf_dir):
    return preview(graph(spark, sf_dir), 20)


@register(f"""WITH {EDGES} SELECT edge_id, '{{"edge_id":' || edge_id || ',"timestamp_ms":' || timestamp_ms || ',"src":' || src || ',"dst":' || dst || ',"label":"' || label || '","id":' || edge_id || ',"time":' || timestamp_ms || '}}' AS edge_json FROM e""")
def edges_as_json(spark, sf_dir):
    return edge_json(graph(spark, sf_dir).select("edge_id", "timestamp_ms", "src", "dst", "label")).select("edge_id", "edge_json")


@register(f"WITH {EDGES} SELECT label, count(*) AS n_edges, min(amount) AS least, max(amount) AS most, avg(k) AS mean_k, median(weight) AS middle FROM e GROUP BY label")
def edges_by_label(spark, sf_dir):
    return graph(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n_edges"), F.min("amount").alias("least"), F.max("amount").alias("most"), F.avg("k").alias("mean_k"), F.median("weight").alias("middle"))


@register(Q3_SQL)
def recursive_sql_q3(spark, sf_dir):
    """The monotonic trail as one recursive statement, with bound parameters."""
    state = {"w": ("CAST(NULL AS BIGINT)", "e.weight"), "ids": ("CAST(array() AS ARRAY<BIGINT>)", "array_append(p.ids, e.edge_id)")}
    text = recursive_sql("{edges}", "{nfa}", 0, MAX, state, "(p.w IS NULL OR e.weight > p.w) AND NOT array_contains(p.ids, e.edge_id)")
    text += " SELECT path_length, count(*) AS n_paths FROM (SELECT * FROM paths LIMIT ALL) WHERE path_length >= :least AND s = 0 GROUP BY path_length"
    return spark.sql(text, {"start": START, "least": MIN}, edges=graph(spark, sf_dir), nfa=Nfa(tuple(PLAIN), (0,), (0,)).edges(spark))


@register(oracle(TRAIL, NEW, moves=[(0, 1, "absent")], accept=(1,)))
def unknown_label(spark, sf_dir):
    return query(spark, sf_dir, nfa=simple("absent")).by_length()


# ---- trails with null keys, composed constraints, greater lengths, files


SOME_WEIGHTS = ("epoch_us(ts) // 1000000 AS weight", "CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) // 1000000 END AS weight")


@register(oracle(MONO | TRAIL, f"{LATER} AND {NEW}").replace(*SOME_WEIGHTS))
def null_key_trail(spark, sf_dir):
    """A third of the edges have no key; a path may start with some, and none comes twice."""
    own = query(spark, sf_dir, monotonic("weight", "bigint"), grouped=True)
    return replace(own, edges=own.edges.withColumn("weight", F.when(F.col("edge_id") % 3 > 0, F.col("weight")))).by_length()


@register(oracle(MONO | COLORS | TRAIL, f"{LATER} AND {NEW}", "ok"))
def composed_python(spark, sf_dir):
    """Three Python constraints at once."""
    return query(spark, sf_dir, (MONOTONIC_PY, TWO_COLOR_PY, py_trail()), semantics="walk").by_length()


@register(oracle(MONO | COLORS | TRAIL, f"{LATER} AND {NEW}", "ok"))
def composed_mixed(spark, sf_dir):
    """A Column and a Python constraint at once."""
    return query(spark, sf_dir, (monotonic("weight", "bigint"), TWO_COLOR_PY)).by_length()


def levels_sql(max_len: int, state: dict[str, tuple[str, str, str]], valid: str = "true", where: str = "true") -> str:
    """Counts by length, level by level, of walks over PLAIN moves: state as column -> (type, initial value, value after an edge)."""
    names = "".join(f", {c}" for c in state)
    after = "".join(f", CAST({b} AS {kind}) AS {c}" for c, (kind, _, b) in state.items())
    first = "".join(f", CAST({a} AS {kind}) AS {c}" for c, (kind, a, _) in state.items())
    ctes = [EDGES, f"l0 AS (SELECT {START}::BIGINT AS v, 1::HUGEINT AS n{first})"]
    for i in range(1, max_len + 1):
        ctes.append(f"l{i} AS (SELECT v{names}, sum(n) AS n FROM (SELECT e.dst AS v, n{after} FROM l{i - 1} p JOIN e ON e.src = p.v WHERE e.label IN ('view', 'click') AND {valid}) GROUP BY ALL)")
    each = " UNION ALL ".join(f"SELECT {i} AS path_length, n FROM l{i} WHERE {where}" for i in range(MIN, max_len + 1))
    return f"WITH {', '.join(ctes)} SELECT path_length, CAST(sum(n) AS BIGINT) AS n_paths FROM ({each}) GROUP BY path_length"


@register(levels_sql(10, {}))
def walks_to_ten(spark, sf_dir):
    return query(spark, sf_dir, semantics="walk", grouped=True, max_len=10).by_length()


@register(levels_sql(10, {"w": ("BIGINT", "NULL", "e.weight")}, LATER))
def monotonic_to_ten(spark, sf_dir):
    """Monotonic trails, which need no list of edges, so that paths merge into counts."""
    return query(spark, sf_dir, monotonic("weight", "bigint"), max_len=10, grouped=True).by_length()


@register(levels_sql(6, {"lc": ("BIGINT", "NULL", "color"), "ok": ("BOOLEAN", "false", "ok OR coalesce(lc = color, false)")}, where="ok"))
def two_color_walks_to_six(spark, sf_dir):
    return query(spark, sf_dir, adjacent_equal("color", "bigint"), semantics="walk", max_len=6, grouped=True).by_length()


@register(f"WITH {EDGES} SELECT src, dst, label, CAST(weight AS DOUBLE) AS weight, CAST(color AS VARCHAR) AS color, row_number() OVER (ORDER BY src, dst, label, weight, color) - 1 AS edge_id FROM e")
def edges_from_csv(spark, sf_dir):
    """Written as CSV with the headers from and to, and read back."""
    path = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    graph(spark, sf_dir).selectExpr("src as `from`", "dst as `to`", "label", "weight", "color").write.option("header", True).csv(path)
    return read_edges(spark, path)


@register(f"WITH {EDGES} SELECT edge_id, src, dst, label FROM e WHERE label = 'purchase'")
def edges_of_a_label(spark, sf_dir):
    """Split into folders by label, of which one is read."""
    path = f"{shared_folder(spark)}/labels-{uuid.uuid4().hex}"
    write_by_label(graph(spark, sf_dir), path)
    return read_label(spark, path, "purchase").select("edge_id", "src", "dst", "label")


@register("SELECT f AS from_state, t AS to_state, label FROM (VALUES " + ", ".join(map(str, GENERAL.transitions)) + ") n(f, t, label)")
def nfa_from_csv(spark, sf_dir):
    """An automaton written as two CSV files and read back."""
    path = f"{shared_folder(spark)}/nfa-{uuid.uuid4().hex}"
    write_nfa(spark, GENERAL, f"{path}-moves", f"{path}-states")
    return read_nfa(spark, f"{path}-moves", f"{path}-states").edges(spark)


@register(f"WITH {EDGES}, x AS (SELECT DISTINCT src AS id FROM e) SELECT id, 'node' || id AS name, CASE WHEN id = {START} THEN 'Start' ELSE '' END AS label FROM x")
def nodes_from_csv(spark, sf_dir):
    """Nodes written as CSV, most without a label, and read back with empty ones."""
    path = f"{shared_folder(spark)}/nodes-{uuid.uuid4().hex}"
    nodes = graph(spark, sf_dir).select(F.col("src").alias("id")).distinct()
    nodes.select("id", F.concat(F.lit("node"), "id").alias("name"), F.when(F.col("id") == START, "Start").alias("label")).write.option("header", True).csv(path)
    return read_nodes(spark, path, fill_label=True)
