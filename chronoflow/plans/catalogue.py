"""The queries over the driver tables, with their SQL equivalents. Floats are rounded on both sides, as sums and logs
of two engines differ in the last digits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


from chronoflow.functions.losses import bce, hinge, huber
from chronoflow.functions.vectors import logsumexp, negated_recency, time_encoding
from chronoflow.operators import asof, daily, features as feat, graph, graphnet, memory, metrics, ranking, sampling, scorer, training
from chronoflow.operators.scorer import labelled
from chronoflow.plans import views
from chronoflow.plans.views import ASSETS, edges, edges_sql, table, transfers
from chronoflow.sources import transfers as source
from chronoflow.sources.shared import cut, cut_folder, drop, grown
from chronoflow.streaming import keyed, replay

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "auroc_dgb_batch"
SEED = 7
NATION, PARTY = edges_sql("nation"), edges_sql("party")


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r(c, digits: int = 6):
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[r(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def n_nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("x")).union(e.select("dst")).agg(F.countDistinct("x").alias("n_nodes"))


def test_queries(e: DataFrame) -> DataFrame:
    return e.where("split = 'test'").select(F.col("event_idx").alias("query_id"), F.col("src").alias("s"), F.col("dst").alias("d"), "day")


def plain(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("s"), F.col("dst").alias("d"), "day")


# Scans, filters, projections, plain aggregates


@query(f"WITH {PARTY} SELECT s, d, day, round(usd_sum, 5) AS usd_sum, round(amt_0, 5) AS amt_0, round(amt_1, 5) AS amt_1, round(amt_2, 5) AS amt_2, round(amt_3, 5) AS amt_3, txn FROM o")
def daily_flow(spark: SparkSession, d: str) -> DataFrame:
    return rounded(daily.daily_edges(views.party(spark, d), ASSETS), 5)


@query(f"WITH {NATION} SELECT event_idx, src, dst, day, split, txn FROM e")
def daily_split(spark, d):
    return edges(spark, d, "nation", amounts=True).select("event_idx", "src", "dst", "day", "split", "txn")


@query(f"""WITH {NATION} SELECT event_idx, round((log10(usd_sum) - amt_mean) / amt_std, 6) AS z_log_usd, round(ln(1.0 + txn), 6) AS ln_txn,
  round(amt_0 / usd_sum, 6) AS share_0, round(amt_1 / usd_sum, 6) AS share_1, round(amt_2 / usd_sum, 6) AS share_2, round(amt_3 / usd_sum, 6) AS share_3 FROM e CROSS JOIN y""")
def edge_features(spark, d):
    return rounded(daily.edge_features(edges(spark, d, "nation", amounts=True), len(ASSETS)))


@query(f"WITH {NATION} SELECT n_nodes, n_days, train_end, val_end, round(amt_mean, 6) AS amt_mean, round(amt_std, 6) AS amt_std FROM meta CROSS JOIN y")
def graph_meta(spark, d):
    return rounded(daily.graph_meta(edges(spark, d, "nation", amounts=True)))


@query(f"WITH {NATION} SELECT addr, node_id FROM nodes")
def node_dim(spark, d):
    return daily.node_dim(daily.daily_edges(views.nation(spark, d), ASSETS))


@query(f"WITH {NATION} SELECT day, n, sum(n) OVER (ORDER BY day) - n AS lo FROM (SELECT day, count(*) AS n FROM e GROUP BY day)")
def day_offsets(spark, d):
    return daily.day_offsets(edges(spark, d, "nation"))


_WINDOW = ("1996-01-01", "1996-07-01")
_WEI = "(round(l_extendedprice * (1 - l_discount) * 100)::BIGINT)::VARCHAR || '0000000000000000'"


@query(f"""SELECT '0x-' || l_orderkey || '-' || l_linenumber AS transaction_hash, 'c' || o_custkey AS from_address, 's' || l_suppkey AS to_address, {_WEI} AS value_lossless, round(({_WEI})::DOUBLE / 1e18, 6) AS value_eth
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '{_WINDOW[0]}' AND l_shipdate < TIMESTAMP '{_WINDOW[1]}' AND l_extendedprice * (1 - l_discount) >= 0.005""")
def windowed_extract(spark, d):
    return rounded(source.window_of(transfers(spark, d).withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp")), *_WINDOW).drop("block_timestamp"))


@query("SELECT date_trunc('day', ts)::DATE AS dt, count(*) AS n FROM events GROUP BY 1")
def tx_per_day(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("dt")).agg(F.count("*").alias("n"))


@query("SELECT 's' || l_suppkey AS to_address, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, to_address LIMIT 20")
def top_counterparties(spark, d):
    return transfers(spark, d).groupBy("to_address").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "to_address").limit(20)


@query("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def recent_transfers(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id", "event_type")


@query("SELECT count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, round(avg(o_totalprice), 2) AS mean FROM orders")
def block_stats(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.min("o_orderdate").cast("date").alias("first"), F.max("o_orderdate").cast("date").alias("last"), r(F.avg("o_totalprice"), 2).alias("mean"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY event_type")
def relative_window(spark, d):
    e = table(spark, d, "events")
    return e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now")))).where(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAY")).groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 2).alias("total"))


@query("SELECT deg AS degree, count(*) AS nodes FROM (SELECT node, count(*) AS deg FROM (SELECT 'c' || o_custkey AS node FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY node) GROUP BY deg")
def degree_hist(spark, d):
    e = transfers(spark, d).select(F.col("from_address").alias("s"), F.col("to_address").alias("d"))
    return graph.degree(e).groupBy("degree").agg(F.count("*").alias("nodes"))


@query(f"WITH {NATION} SELECT node, count(*) AS degree FROM (SELECT s AS node FROM e UNION ALL SELECT d FROM e) GROUP BY node ORDER BY degree DESC, node LIMIT 10")
def top_hubs(spark, d):
    return graph.degree(edges(spark, d, "nation", names=True).select("s", "d")).orderBy(F.desc("degree"), "node").limit(10)


@query("""WITH n AS (SELECT date_trunc('minute', ts) AS dt, count(*) AS n FROM events GROUP BY 1)
SELECT strftime(x.dt, '%Y-%m-%d %H:%M') AS dt, coalesce(n.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(dt) FROM n), (SELECT max(dt) FROM n), INTERVAL 1 MINUTE)) AS dt) x LEFT JOIN n ON n.dt = x.dt""")
def minute_coverage_gaps(spark, d):
    return graph.coverage(table(spark, d, "events"), "minute").select(F.date_format("dt", "yyyy-MM-dd HH:mm").alias("dt"), "n")


@query("""WITH n AS (SELECT ts::DATE AS dt, count(*) AS n FROM events GROUP BY 1)
SELECT x.dt::DATE AS dt, coalesce(n.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(dt) FROM n), (SELECT max(dt) FROM n), INTERVAL 1 DAY)) AS dt) x LEFT JOIN n ON n.dt = x.dt::DATE""")
def daily_coverage(spark, d):
    return graph.coverage(table(spark, d, "events"))


_ENDS = "SELECT 'c' || o_custkey AS address FROM lineitem JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 's' || l_suppkey FROM lineitem"


@query(f"SELECT address, count(*) AS n FROM ({_ENDS}) GROUP BY address HAVING count(*) BETWEEN 50 AND 500 ORDER BY md5(address), address LIMIT 20")
def pick_seeds(spark, d):
    return graph.pick_seeds(transfers(spark, d))


@query(f"WITH {NATION} SELECT split, count(*) AS n, count(*) FILTER (seen) AS seen FROM (SELECT e.split, p.src IS NOT NULL AS seen FROM e LEFT JOIN (SELECT DISTINCT src, dst FROM e WHERE split = 'train') p USING (src, dst)) GROUP BY split")
def seen_share(spark, d):
    e = edges(spark, d, "nation")
    seen = e.where("split = 'train'").select("src", "dst", F.lit(True).alias("seen")).distinct()
    return e.join(seen, ["src", "dst"], "left").groupBy("split").agg(F.count("*").alias("n"), F.count("seen").alias("seen"))


@query("SELECT event_type, date_trunc('week', ts)::DATE AS week, count(*) AS n, sum(n_v) AS n_v FROM (SELECT *, CASE WHEN value > 0 THEN 1 ELSE 0 END AS n_v FROM events) GROUP BY CUBE (event_type, week)")
def activity_cube(spark, d):
    e = table(spark, d, "events").select("event_type", F.date_trunc("week", "ts").cast("date").alias("week"), F.when(F.col("value") > 0, 1).otherwise(0).alias("v"))
    return e.cube("event_type", "week").agg(F.count("*").alias("n"), F.sum("v").alias("n_v"))


# Graph sampling and structure

_T = "t AS MATERIALIZED (SELECT 'c' || o_custkey AS a, 's' || l_suppkey AS b, '0x-' || l_orderkey || '-' || l_linenumber AS h, epoch(l_shipdate)::BIGINT AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _hop(k: int, room: int, cap: int) -> str:
    known = " UNION ALL ".join(f"SELECT address, hop FROM f{j}" for j in range(k))
    return f"""f{k} AS MATERIALIZED (SELECT other AS address, {k} AS hop FROM (SELECT DISTINCT other FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY md5(concat_ws('|', h, ts, anchor, other, 0)), other) AS rn FROM
  (SELECT f.address AS anchor, b AS other, h, ts FROM t JOIN f{k - 1} f ON a = f.address UNION ALL SELECT f.address, a, h, ts FROM t JOIN f{k - 1} f ON b = f.address)) WHERE rn <= {cap})
  WHERE other NOT IN (SELECT address FROM ({known})) ORDER BY md5(concat_ws('|', other, 0)), other LIMIT greatest(0, {room} - (SELECT count(*) FROM ({known}))))"""


_SNOW = f"WITH {_T}, f0 AS (SELECT 's1' AS address, 0 AS hop), {', '.join(_hop(k, 300, 10) for k in range(1, 7))}, n AS ({' UNION ALL '.join(f'SELECT * FROM f{k}' for k in range(7))})"


@query(f"{_SNOW} SELECT * FROM n")
def snowball_nodes(spark, d):
    return graph.snowball(transfers(spark, d), "s1", max_nodes=300, per_node=10)


@query(f"{_SNOW} SELECT a AS from_address, b AS to_address, h AS transaction_hash FROM t WHERE a IN (SELECT address FROM n) AND b IN (SELECT address FROM n)")
def snowball_edges(spark, d):
    t = transfers(spark, d)
    return graph.induced(t, graph.snowball(t, "s1", max_nodes=300, per_node=10)).select("from_address", "to_address", "transaction_hash")


# Customers, their orders and the orders' lines: a graph of many components.
_SPARSE = "x AS MATERIALIZED (SELECT 'c' || o_custkey AS s, 'o' || o_orderkey AS d FROM orders UNION SELECT 'o' || l_orderkey, 'l' || l_orderkey || '-' || l_linenumber FROM lineitem)"


def _sparse(spark, d):
    orders = table(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("s"), F.concat(F.lit("o"), "o_orderkey").alias("d"))
    lines = table(spark, d, "lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("s"), F.concat(F.lit("l"), "l_orderkey", F.lit("-"), "l_linenumber").alias("d"))
    return orders.union(lines)  # repeated edges join nothing more


_COMPONENTS = f"""WITH RECURSIVE {_SPARSE}, b AS MATERIALIZED (SELECT s AS u, d AS v FROM x UNION SELECT d, s FROM x),
w(node, other) AS (SELECT u, u FROM b UNION SELECT w.node, b.v FROM w JOIN b ON b.u = w.other),
c AS (SELECT node, min(other) AS component FROM w GROUP BY node)"""


@query(f"{_COMPONENTS} SELECT * FROM c")
def components(spark, d):
    return graph.components(_sparse(spark, d))


@query(f"{_COMPONENTS} SELECT size, count(*) AS components FROM (SELECT count(*) AS size FROM c GROUP BY component) GROUP BY size")
def component_sizes(spark, d):
    return graph.components(_sparse(spark, d)).groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


# As-of neighbours



def _cuts(source: str, key: str) -> str:
    """For each row of a table (key, node, day) how many of the node's incidences came before the day."""
    rows = f"SELECT NULL AS {key}, node, day, 1 AS ev FROM inc UNION ALL SELECT {key}, node, day, 0 FROM {source}"
    return f"SELECT {key}, node, day, cut FROM (SELECT *, coalesce(sum(ev) OVER (PARTITION BY node ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS cut FROM ({rows})) WHERE ev = 0"


_INC = f"""inc AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY node ORDER BY day, event_idx, dir) AS rn FROM
  (SELECT src AS node, dst AS other, 0 AS dir, day, event_idx FROM e UNION ALL SELECT dst, src, 1, day, event_idx FROM e)),
q AS MATERIALIZED (SELECT event_idx AS query_id, src AS node, day FROM e WHERE split = 'test'),
c AS MATERIALIZED ({_cuts("q", "query_id")})"""


def _neighbor_queries(e):
    return e.where("split = 'test'").select(F.col("event_idx").alias("query_id"), F.col("src").alias("node"), "day")


# The n-th latest incidence is at place cut - n + 1: places are made from a list of numbers and joined by equality.
@query(f"""WITH {PARTY}, {_INC}, p AS MATERIALIZED (SELECT query_id, node, day, cut, (cut - k)::BIGINT AS rn FROM c CROSS JOIN range(20) AS r(k) WHERE k < cut)
SELECT query_id, cut - p.rn + 1 AS pos, other, p.day - inc.day AS dt, dir FROM p JOIN inc ON inc.node = p.node AND inc.rn = p.rn""")
def incidence_topk(spark, d):
    e = edges(spark, d, "party")
    return asof.recent_neighbors(asof.incidence(e), _neighbor_queries(e), 20).drop("eday")


@query(f"""WITH {PARTY}, {_INC}, p AS MATERIALIZED (SELECT query_id, node, day, cut, (CASE WHEN cut <= 7 OR k < 4 THEN cut - k ELSE 1 + ((6 - k) * (cut - 4)) // 3 END)::BIGINT AS rn FROM c CROSS JOIN range(7) AS r(k) WHERE k < cut)
SELECT query_id, cut - p.rn + 1 AS pos, other, p.day - inc.day AS dt, dir FROM p JOIN inc ON inc.node = p.node AND inc.rn = p.rn""")
def incidence_strat(spark, d):
    e = edges(spark, d, "party")
    return asof.spread_neighbors(asof.incidence(e), _neighbor_queries(e), 7).drop("eday")


_LAST3 = "SELECT DISTINCT other AS node, inc.day AS day FROM (SELECT node, unnest(range(greatest(1, cut - 2), cut + 1)) AS rn FROM {}) x JOIN inc USING (node, rn)"


@query(f"""WITH {PARTY}, {_INC}, a AS (SELECT DISTINCT node, day FROM q), h1 AS MATERIALIZED ({_LAST3.format("c")}), h1k AS MATERIALIZED (SELECT row_number() OVER () AS id, * FROM h1),
c1 AS MATERIALIZED ({_cuts("h1k", "id")}), h2 AS ({_LAST3.format("c1")})
SELECT 0 AS hop, * FROM a UNION ALL SELECT 1, * FROM h1 UNION ALL SELECT 2, * FROM h2""")
def two_hops(spark, d):
    e = edges(spark, d, "party")
    return asof.hops(asof.incidence(e), _neighbor_queries(e), 3, 2)


# Features

_Q = "q AS MATERIALIZED (SELECT event_idx AS query_id, src AS s, dst AS c, day AS t FROM e WHERE split = 'test')"
_RAW = f"""{_Q},
bp AS MATERIALIZED (SELECT query_id, max(day) AS pl, min(day) AS pf, count(day) AS pn FROM q LEFT JOIN e ON e.src = q.s AND e.dst = q.c AND e.day < q.t GROUP BY query_id),
bs AS MATERIALIZED (SELECT query_id, max(day) AS sl, count(day) AS sn, count(day) FILTER (day >= t - 30) AS s30, count(DISTINCT dst) AS od FROM q LEFT JOIN e ON e.src = q.s AND e.day < q.t GROUP BY query_id),
bd AS MATERIALIZED (SELECT query_id, max(day) AS dl, count(day) AS dn, count(day) FILTER (day >= t - 7) AS d7, count(day) FILTER (day >= t - 30) AS d30, count(day) FILTER (day >= t - 90) AS d90, count(DISTINCT src) AS ind FROM q LEFT JOIN e ON e.dst = q.c AND e.day < q.t GROUP BY query_id),
und AS MATERIALIZED (SELECT node, other, min(day) AS day FROM (SELECT src AS node, dst AS other, day FROM e UNION ALL SELECT dst, src, day FROM e) GROUP BY node, other),
gs AS MATERIALIZED (SELECT query_id, count(und.day) AS n FROM q LEFT JOIN und ON und.node = q.s AND und.day < q.t GROUP BY query_id),
gc AS MATERIALIZED (SELECT query_id, count(und.day) AS n FROM q LEFT JOIN und ON und.node = q.c AND und.day < q.t GROUP BY query_id),
lp AS MATERIALIZED (SELECT query_id, dst, max(day) AS last FROM q JOIN e ON e.src = q.s AND e.day < q.t GROUP BY query_id, dst),
rk AS MATERIALIZED (SELECT q.query_id, count(last) AS partners, count(*) FILTER (last > pl) AS later FROM q JOIN bp USING (query_id) LEFT JOIN lp USING (query_id) GROUP BY q.query_id)"""
_FROM = "FROM q JOIN bp USING (query_id) JOIN bs USING (query_id) JOIN bd USING (query_id) JOIN gs USING (query_id) JOIN gc USING (query_id) JOIN rk USING (query_id)"


def _flag(c):
    return f"CASE WHEN {c} IS NULL THEN 0.0 ELSE 1.0 END"


def _since(c):
    return f"coalesce(round(ln(1.0 + t - {c}), 6), 0.0)"


def _count(c):
    return f"round(ln(1.0 + {c}), 6)"


_COLUMN_SQL = {
    "pair_seen": _flag("pl"), "pair_recency": _since("pl"), "dst_seen": _flag("dl"), "dst_recency": _since("dl"), "src_seen": _flag("sl"), "src_recency": _since("sl"), "src_freq": _count("sn"), "dst_freq": _count("dn"),
    "dst_freq30": _count("d30"), "deg_s": _count("gs.n"), "deg_c": _count("gc.n"), "pair_freq": _count("pn"), "pair_age": _since("pf"), "dst_freq7": _count("d7"), "dst_freq90": _count("d90"), "src_freq30": _count("s30"),
    "out_deg_s": _count("od"), "in_deg_c": _count("ind"), "rec_rank": "round(CASE WHEN pl IS NOT NULL THEN ln(1.0 + later) ELSE ln(1.0 + greatest(partners, 1)) + 1.0 END, 6)", "n_partners_s": _count("od"),
    "dt_1": "CASE WHEN t - pl <= 1 THEN 1.0 ELSE 0.0 END", "dt_2": "CASE WHEN t - pl = 2 THEN 1.0 ELSE 0.0 END", "dt_7": "CASE WHEN t - pl <= 7 THEN 1.0 ELSE 0.0 END",
}


def _feature_query(name: str, columns: tuple[str, ...], view: str) -> None:
    def f(spark, d):
        e = edges(spark, d, view)
        return rounded(feat.features(plain(e), test_queries(e), columns))

    QUERIES[name] = f
    ORACLE_SQL[name] = f"WITH {edges_sql(view)}, {_RAW} SELECT query_id, {', '.join(f'{_COLUMN_SQL[c]} AS {c}' for c in columns)} {_FROM}"


_feature_query("feat_base4", feat.BASE4, "nation")
_feature_query("feat_buckets7", (*feat.BASE4, *feat.BUCKETS), "nation")
_feature_query("feat_global11", feat.GLOBAL11, "party")
_feature_query("feat_wide14", (*feat.GLOBAL11, *feat.BUCKETS), "nation")
_feature_query("feat_wide23", feat.WIDE23, "nation")


@query(f"""WITH {PARTY}, {_Q},
und AS MATERIALIZED (SELECT src AS node, dst AS mid, day FROM e UNION SELECT dst, src, day FROM e),
deg AS MATERIALIZED (SELECT node, mid, min(day) AS day FROM und GROUP BY node, mid),
a AS (SELECT query_id, mid, max(day) AS pa FROM q JOIN und ON node = s AND day < t GROUP BY query_id, mid), b AS (SELECT query_id, mid, max(day) AS pb FROM q JOIN und ON node = c AND day < t GROUP BY query_id, mid),
m AS MATERIALIZED (SELECT q.query_id, t, a.mid, pa, pb FROM a JOIN b ON a.query_id = b.query_id AND a.mid = b.mid JOIN q ON q.query_id = a.query_id),
md AS (SELECT m.query_id, m.mid, count(*) AS n FROM m JOIN deg ON deg.node = m.mid AND deg.day < m.t GROUP BY m.query_id, m.mid),
s1 AS (SELECT m.query_id, count(*) AS cn, count(*) FILTER (pa >= t - 30 AND pb >= t - 30) AS cn_recent, sum(1.0 / ln(1.0 + n)) AS aa FROM m JOIN md ON md.query_id = m.query_id AND md.mid = m.mid GROUP BY m.query_id),
s2 AS (SELECT query_id, count(DISTINCT x.dst) AS n FROM q JOIN e x ON x.src = q.s AND x.day < q.t JOIN e z ON z.src = x.dst AND z.dst = q.c AND z.day < q.t GROUP BY query_id)
SELECT q.query_id, coalesce(cn, 0) AS cn, coalesce(cn_recent, 0) AS cn_recent, round(coalesce(aa, 0.0), 6) AS aa, round(ln(1.0 + coalesce(s2.n, 0)), 6) AS two_hop FROM q LEFT JOIN s1 ON s1.query_id = q.query_id LEFT JOIN s2 ON s2.query_id = q.query_id""")
def common_neighbors(spark, d):
    e = edges(spark, d, "party")
    return rounded(feat.common_neighbors(plain(e), test_queries(e)))


@query(f"WITH {PARTY}, {_RAW} SELECT query_id, round(ln(1.0 + gs.n) + ln(1.0 + gc.n), 5) AS pref_attach {_FROM}")
def pref_attachment(spark, d):
    e = edges(spark, d, "party")
    return rounded(feat.preferential_attachment(plain(e), test_queries(e)), 5)


@query(f"""WITH {NATION}, n AS (SELECT day, count(*) AS n, row_number() OVER (ORDER BY day) AS k FROM e GROUP BY day),
x AS (SELECT a.day, a.k, coalesce(sum(0.25 * pow(0.75, a.k - 1 - b.k) * b.n), 0.0) AS ema FROM n a LEFT JOIN n b ON b.k < a.k GROUP BY a.day, a.k)
SELECT x.day, round(ln(1.0 + coalesce(p.n, 0)), 6) AS day_edges_prev, round(ln(1.0 + ema), 6) AS day_edges_ema FROM x LEFT JOIN n p ON p.k = x.k - 1""")
def day_context(spark, d):
    return rounded(feat.day_context(plain(edges(spark, d, "nation"))))


@query(f"WITH {NATION}, {_RAW} SELECT query_id, coalesce((pl - t)::DOUBLE, -1e9) AS pair_recency, coalesce((sl - t)::DOUBLE, -1e9) AS src_recency, coalesce((dl - t)::DOUBLE, -1e9) AS dst_recency {_FROM}")
def recency_signals(spark, d):
    e = edges(spark, d, "nation")
    x = feat._counted(plain(e), test_queries(e))
    return x.select("query_id", *[negated_recency(F.col("day"), F.col(f"{k}_last")).alias(f"{k}_recency") for k in ("pair", "src", "dst")])


@query(f"""WITH {NATION}, {_Q}, i AS MATERIALIZED (SELECT q.*, (query_id - min(query_id) OVER ()) // 50 AS batch FROM q), p AS (SELECT a.batch, a.query_id AS i, b.query_id AS j, a.s, b.c, a.t FROM i a JOIN i b ON a.batch = b.batch)
SELECT p.batch, p.i, p.j, CASE WHEN max(e.day) IS NULL THEN 0.0 ELSE 1.0 END AS pair_seen, coalesce(round(ln(1.0 + max(t) - max(e.day)), 6), 0.0) AS pair_recency FROM p LEFT JOIN e ON e.src = p.s AND e.dst = p.c AND e.day < p.t GROUP BY p.batch, p.i, p.j""")
def feat_cross(spark, d):
    """Sources with candidates inside batches of 50 edges; the size is fixed, so pairs grow with the edges."""
    e = edges(spark, d, "nation")
    b = sampling.batches(e, "test", 50).select(F.col("clock").alias("batch"), F.col("event_idx").alias("i"), F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    return rounded(feat.cross_features(plain(e), b, ("pair_seen", "pair_recency")))


def with_all(rows: DataFrame, nodes: DataFrame, name: str, block: int = 4096) -> DataFrame:
    """Each row with every node (column ``name``): a stated query set against all nodes, by blocks of them."""
    blocks = nodes.groupBy(F.floor(F.col(name) / block).alias("_b")).agg(F.collect_list(name).alias("_in"))
    return rows.crossJoin(blocks).withColumn(name, F.explode("_in")).drop("_b", "_in")


@query(f"""WITH {NATION}, {_Q}, p AS (SELECT query_id, s, node_id AS c, t FROM q CROSS JOIN nodes)
SELECT p.query_id, p.c, round(ln(1.0 + count(e.day)), 6) AS pair_freq FROM p LEFT JOIN e ON e.src = p.s AND e.dst = p.c AND e.day < p.t GROUP BY p.query_id, p.c""")
def feat_all_nodes(spark, d):
    """Every node as candidate of each test edge."""
    e = edges(spark, d, "nation")
    q = test_queries(e).select(F.col("query_id").alias("q"), "s", "day")
    nodes = e.select(F.col("src").alias("d")).union(e.select("dst")).distinct()
    pairs = with_all(q, nodes, "d").withColumn("query_id", F.xxhash64("q", "d"))
    f = feat.features(plain(e), pairs, ("pair_freq",))
    return rounded(pairs.select("query_id", "q", "d").join(f, "query_id").select(F.col("q").alias("query_id"), F.col("d").alias("c"), "pair_freq"))


# Negative samples

_H = "('0x' || substr(md5(concat_ws('|', {})), 1, 8))::BIGINT"


def _h(*parts) -> str:
    return _H.format(", ".join(str(p) for p in parts))


_NN = "(SELECT n_nodes FROM meta)"


def _nth(n: str, left_out: str) -> str:
    return f"list_reduce([({n})::BIGINT] || list_sort({left_out}), lambda a, x: CASE WHEN x <= a THEN a + 1 ELSE a END)"


_UNIFORM = f"""u AS (SELECT event_idx, src, day, a AS attempt, {_h(SEED, "'train'", "event_idx", "a")} % {_NN} AS neg_dst FROM e CROSS JOIN range(8) x(a)),
uf0 AS MATERIALIZED (SELECT event_idx, src, day, arg_min(neg_dst, attempt) AS neg_dst FROM u WHERE neg_dst <> src AND NOT EXISTS (SELECT 1 FROM e p WHERE p.src = u.src AND p.dst = u.neg_dst AND p.day = u.day) GROUP BY event_idx, src, day),
ux AS (SELECT e.event_idx, e.src, e.day, list_distinct(list(o.dst) || [e.src]) AS x FROM e JOIN e o ON o.src = e.src AND o.day = e.day WHERE e.event_idx NOT IN (SELECT event_idx FROM uf0) GROUP BY e.event_idx, e.src, e.day),
uf AS (SELECT event_idx, src, day, neg_dst FROM uf0 UNION ALL SELECT event_idx, src, day, {_nth(_h(SEED, "'train'", "event_idx", "'rest'") + f" % ({_NN} - len(x))", "x")} FROM ux WHERE {_NN} > len(x))"""


def _unseen(slots: str, label: str, keys: str) -> str:
    """Tables un (keys, src, dst) for the slots: pairs that never meet."""
    return f"""us AS MATERIALIZED ({slots}), upair AS MATERIALIZED (SELECT DISTINCT src, dst FROM e),
ud AS (SELECT *, {_h(SEED, f"'{label}'", "'s'", keys, "a")} % {_NN} AS src, {_h(SEED, f"'{label}'", "'d'", keys, "a")} % {_NN} AS dst FROM us CROSS JOIN range(8) x(a)),
un0 AS MATERIALIZED (SELECT {keys}, arg_min(src, a) AS src, arg_min(dst, a) AS dst FROM ud WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM upair p WHERE p.src = ud.src AND p.dst = ud.dst) GROUP BY {keys}),
umet AS MATERIALIZED (SELECT src, list(dst) AS x FROM upair WHERE src <> dst GROUP BY src),
ufull AS MATERIALIZED (SELECT coalesce(list(src), []) AS nofree FROM umet WHERE len(x) = {_NN} - 1),
ur AS (SELECT {keys}, {_nth(_h(SEED, f"'{label}'", "'s'", keys, "'rest'") + f" % ({_NN} - len(nofree))", "nofree")} AS src FROM us CROSS JOIN ufull WHERE {_NN} > len(nofree) AND {_NN} > 1 AND ({keys}) NOT IN (SELECT ({keys}) FROM un0)),
ux2 AS (SELECT ur.*, coalesce(x, []) || [ur.src] AS x FROM ur LEFT JOIN umet USING (src)),
un AS MATERIALIZED (SELECT {keys}, src, dst FROM un0 UNION ALL SELECT {keys}, src, {_nth(_h(SEED, f"'{label}'", "'d'", keys, "'rest'") + f" % ({_NN} - len(x))", "x")} FROM ux2)"""


@query(f"WITH {PARTY}, {_UNIFORM} SELECT event_idx, src, neg_dst, day FROM uf")
def neg_random_train(spark, d):
    e = edges(spark, d, "party")
    return sampling.uniform_targets(e, n_nodes(e), SEED)


@query(f"WITH {PARTY}, {_unseen('SELECT event_idx, day FROM e WHERE split = $$test$$', 'legacy', 'event_idx')} SELECT event_idx, us.day, un.src, un.dst FROM un JOIN us USING (event_idx)".replace("$$", "'"))
def neg_legacy_random(spark, d):
    e = edges(spark, d, "party")
    return sampling.unseen_pairs(e.where("split = 'test'"), e, n_nodes(e), SEED)


def _drawn(label: str) -> str:
    """clocks (clock, need, lo, hi), pool (pos, src, dst) and positives (clock, src, dst) to drawn."""
    return f"""few AS (SELECT clock, need, pos, md5(concat_ws('|', {SEED}, '{label}', clock, pos)) AS ord FROM (SELECT clock, need, unnest(range(lo, hi)) AS pos FROM clocks WHERE hi > lo AND hi - lo <= greatest(4 * need, 256))),
many AS (SELECT clock, need, lo + {_h(SEED, f"'{label}'", "clock", "i", "a")} % (hi - lo) AS pos, lpad(a::VARCHAR, 2, '0') || lpad(i::VARCHAR, 12, '0') AS ord FROM (SELECT *, unnest(range(need)) AS i FROM clocks WHERE hi - lo > greatest(4 * need, 256)) CROSS JOIN range(4) x(a)),
cand AS (SELECT clock, need, pos, min(ord) AS ord FROM (SELECT * FROM few UNION ALL SELECT * FROM many) GROUP BY clock, need, pos),
drawn AS MATERIALIZED (SELECT clock, k, src, dst FROM (SELECT clock, need, src, dst, row_number() OVER (PARTITION BY clock ORDER BY ord, pos) - 1 AS k FROM cand JOIN pool USING (pos)
  WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.clock = cand.clock AND p.src = pool.src AND p.dst = pool.dst)) WHERE k < need)"""


def _legacy(strategy: str) -> str:
    which = "SELECT src, dst, min(event_idx) AS first FROM e WHERE split <> 'test' GROUP BY src, dst" if strategy == "historical" else "SELECT src, dst, min(event_idx) AS first FROM e WHERE split = 'test' AND NOT EXISTS (SELECT 1 FROM e p WHERE p.split <> 'test' AND p.src = e.src AND p.dst = e.dst) GROUP BY src, dst"
    slots = "SELECT clock, unnest(range(got, need)) AS k FROM (SELECT clock, need, (SELECT count(*) FROM drawn WHERE drawn.clock = clocks.clock) AS got FROM clocks)"
    return f"""pool AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY first) - 1 AS pos FROM ({which})), positives AS (SELECT day AS clock, src, dst FROM e WHERE split = 'test'),
clocks AS (SELECT clock, count(*) AS need, 0 AS lo, (SELECT count(*) FROM pool) AS hi FROM positives GROUP BY clock), {_drawn('legacy-' + strategy)}, {_unseen(slots, f'legacy-{strategy}-top', 'clock, k')},
topped AS MATERIALIZED (SELECT clock, k, src, dst FROM drawn UNION ALL SELECT clock, k, src, dst FROM un)"""


@query(f"WITH {PARTY}, {_legacy('historical')} SELECT * FROM topped")
def neg_legacy_historical(spark, d):
    e = edges(spark, d, "party")
    return sampling.day_negatives(e, "historical", SEED, n_nodes(e))


@query(f"WITH {PARTY}, {_legacy('inductive')} SELECT * FROM topped")
def neg_legacy_inductive(spark, d):
    e = edges(spark, d, "party")
    return sampling.day_negatives(e, "inductive", SEED, n_nodes(e))


for _s in ("historical", "inductive"):

    def _topped(spark, d, strategy=_s):
        e = edges(spark, d, "nation")
        return sampling.day_negatives(e, strategy, SEED, n_nodes(e))

    QUERIES[f"neg_legacy_{_s}_nation"] = _topped
    ORACLE_SQL[f"neg_legacy_{_s}_nation"] = f"WITH {NATION}, {_legacy(_s)} SELECT * FROM topped"


_TAKEN = "taken AS (SELECT clock, src, list(DISTINCT rank) AS x FROM positives JOIN targets ON node = dst GROUP BY clock, src)"


def _dgb(strategy: str, n_neg: int = 1, span: str = "test", prefix: str = "") -> str:
    """Tables pos (the span's edges with clock and i) and neg."""
    pos = f"""pos AS MATERIALIZED (SELECT *, (event_idx - lo) // 200 AS clock, (event_idx - lo) % 200 AS i FROM (SELECT *, min(event_idx) OVER () AS lo FROM e WHERE split = '{span}')),
positives AS (SELECT clock, src, dst FROM pos), np AS MATERIALIZED (SELECT clock, count(*) AS npos, min(event_idx) AS begin FROM pos GROUP BY clock)"""
    ends = """targets AS MATERIALIZED (SELECT dst AS node, row_number() OVER (ORDER BY dst) - 1 AS rank FROM (SELECT DISTINCT dst FROM e)), sources AS MATERIALIZED (SELECT src AS node, row_number() OVER (ORDER BY src) - 1 AS rank FROM (SELECT DISTINCT src FROM e))"""
    if strategy == "random":
        return f"""{pos}, {ends}, u AS (SELECT clock, r * npos + i AS k, src, day, a, {_h(SEED, "'random'", "clock", "r * npos + i", "a")} % (SELECT count(*) FROM targets) AS rank FROM pos JOIN np USING (clock) CROSS JOIN range({n_neg}) y(r) CROSS JOIN range(8) x(a)),
neg0 AS MATERIALIZED (SELECT clock, k, src, arg_min(node, a) AS dst, day, FALSE AS is_pad FROM u JOIN targets USING (rank) WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.clock = u.clock AND p.src = u.src AND p.dst = node) GROUP BY clock, k, src, day),
{_TAKEN}, nr AS (SELECT DISTINCT u.clock, u.k, u.src, u.day, coalesce(x, []) AS x FROM u LEFT JOIN taken USING (clock, src) WHERE (u.clock, u.k) NOT IN (SELECT (clock, k) FROM neg0)),
neg AS MATERIALIZED (SELECT * FROM neg0 UNION ALL SELECT clock, k, src, node, day, FALSE FROM (SELECT *, {_nth(_h(SEED, "'random'", "'rest'", "clock", "k") + " % ((SELECT count(*) FROM targets) - len(x))", "x")} AS rank FROM nr WHERE len(x) < (SELECT count(*) FROM targets)) JOIN targets USING (rank))"""
    where = "WHERE event_idx >= (SELECT min(event_idx) FROM pos)" if strategy == "recurring" else ""
    lo = "(SELECT count(*) FROM pool WHERE first < (SELECT min(event_idx) FROM pos))" if strategy == "inductive" else "0"
    return f"""{pos}, {ends}, pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first) - 1 AS pos FROM (SELECT src, dst, min(event_idx) AS first FROM e {where} GROUP BY src, dst)),
clocks AS MATERIALIZED (SELECT clock, npos * {n_neg} AS need, {lo} AS lo, (SELECT count(*) FROM pool WHERE first < begin) AS hi FROM np), {_drawn(strategy)},
gap AS (SELECT clock, unnest(range(got, need)) AS k FROM (SELECT clock, need, (SELECT count(*) FROM drawn WHERE drawn.clock = clocks.clock) AS got FROM clocks)),
pu AS (SELECT clock, k, a, s.node AS src, t.node AS dst FROM gap CROSS JOIN range(8) x(a) JOIN sources s ON s.rank = {_h(SEED, f"'{strategy}'", "'pad'", "'src'", "clock", "k", "a")} % (SELECT count(*) FROM sources) JOIN targets t ON t.rank = {_h(SEED, f"'{strategy}'", "'pad'", "'dst'", "clock", "k", "a")} % (SELECT count(*) FROM targets)),
pads0 AS MATERIALIZED (SELECT clock, k, arg_min(src, a) AS src, arg_min(dst, a) AS dst FROM pu WHERE NOT EXISTS (SELECT 1 FROM positives p WHERE p.clock = pu.clock AND p.src = pu.src AND p.dst = pu.dst) GROUP BY clock, k),
{_TAKEN}, pr AS (SELECT pu.clock, pu.k, a, pu.src, coalesce(x, []) AS x FROM pu LEFT JOIN taken USING (clock, src) WHERE (pu.clock, pu.k) NOT IN (SELECT (clock, k) FROM pads0)),
pads AS (SELECT * FROM pads0 UNION ALL SELECT clock, k, arg_min(src, a), arg_min(node, a) FROM (SELECT *, {_nth(_h(SEED, f"'{strategy}'", "'pad'", "'rest'", "clock", "k") + " % ((SELECT count(*) FROM targets) - len(x))", "x")} AS rank FROM pr WHERE len(x) < (SELECT count(*) FROM targets)) JOIN targets USING (rank) GROUP BY clock, k),
neg AS MATERIALIZED (SELECT b.clock, b.k, b.src, b.dst, pos.day, is_pad FROM (SELECT *, FALSE AS is_pad FROM drawn UNION ALL SELECT *, TRUE FROM pads) b JOIN np ON np.clock = b.clock JOIN pos ON pos.clock = b.clock AND pos.i = b.k % npos)"""


for _s in ("random", *sampling.STRATEGIES):

    def _neg(spark, d, strategy=_s):
        return sampling.batch_negatives(edges(spark, d, "party"), strategy, SEED)

    QUERIES[f"neg_dgb_{_s}"] = _neg
    ORACLE_SQL[f"neg_dgb_{_s}"] = f"WITH {PARTY}, {_dgb(_s)} SELECT * FROM neg"


@query(f"WITH {PARTY}, {_dgb('inductive', 3, 'val')} SELECT * FROM neg")
def neg_ratio3_val(spark, d):
    return sampling.batch_negatives(edges(spark, d, "party"), "inductive", SEED, span="val", n_neg=3)


@query(f"WITH {PARTY}, {_dgb('inductive', 3)} SELECT clock, count(*) AS n, count(*) FILTER (is_pad) AS pads FROM neg GROUP BY clock")
def pad_share(spark, d):
    x = sampling.batch_negatives(edges(spark, d, "party"), "inductive", SEED, n_neg=3)
    return x.groupBy("clock").agg(F.count("*").alias("n"), F.sum(F.col("is_pad").cast("int")).alias("pads"))


@query(f"""WITH {PARTY}, pool AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first) - 1 AS pos, row_number() OVER (PARTITION BY src ORDER BY first) - 1 AS own FROM (SELECT src, dst, min(event_idx) AS first, min(day) AS day FROM e GROUP BY src, dst)),
q AS MATERIALIZED (SELECT event_idx, src, dst, day, {_h(SEED, "'branch'", "event_idx")} / 4294967296.0 AS u, {_h(SEED, "'source'", "event_idx")} / 4294967296.0 AS v FROM e),
b AS MATERIALIZED (SELECT *, CASE WHEN u < 0.5 THEN CASE WHEN v < 0.5 THEN 'source' ELSE 'global' END WHEN u < 0.5 + 0.2 THEN 'popular' WHEN u < 0.5 + 0.2 + 0.1 THEN 'novel' ELSE 'uniform' END AS branch FROM q),
dd AS MATERIALIZED (SELECT day, (SELECT count(*) FROM pool p WHERE p.day < x.day) AS upto, (SELECT count(*) FROM pool p WHERE p.day < x.day - 30) AS older, (SELECT count(*) FROM e p WHERE p.day < x.day) AS tokens FROM (SELECT DISTINCT day FROM e) x),
m AS (SELECT event_idx, count(*) AS mine FROM b JOIN pool p ON p.src = b.src AND p.day < b.day WHERE branch = 'source' GROUP BY event_idx),
r AS (SELECT b.*, a, upto, older, tokens, coalesce(mine, 0) AS mine, {_h(SEED, "branch", "b.event_idx", "a")} AS h FROM b JOIN dd USING (day) LEFT JOIN m ON m.event_idx = b.event_idx CROSS JOIN range(4) x(a)),
f AS (SELECT event_idx, r.day, branch, a, p.src, p.dst FROM r JOIN pool p ON p.src = r.src AND p.own = h % mine WHERE branch = 'source' AND mine > 0
  UNION ALL SELECT event_idx, r.day, branch, a, p.src, p.dst FROM r JOIN pool p ON p.pos = h % upto WHERE branch = 'global' AND upto > 0
  UNION ALL SELECT event_idx, r.day, branch, a, p.src, p.dst FROM r JOIN pool p ON p.pos = older + h % (upto - older) WHERE branch = 'novel' AND upto > older
  UNION ALL SELECT r.event_idx, r.day, branch, a, r.src, e.dst FROM r JOIN e ON e.event_idx = h % tokens WHERE branch = 'popular' AND tokens > 0),
w AS MATERIALIZED (SELECT event_idx, branch, arg_min(src, a) AS src, arg_min(dst, a) AS dst FROM f WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM e p WHERE p.src = f.src AND p.dst = f.dst AND p.day = f.day) GROUP BY event_idx, branch),
{_UNIFORM.replace("'train'", "'fallback'")}
SELECT * FROM w UNION ALL SELECT event_idx, 'uniform', src, neg_dst FROM uf WHERE event_idx NOT IN (SELECT event_idx FROM w)""")
def neg_mixture(spark, d):
    e = edges(spark, d, "party")
    return sampling.mixture(e, n_nodes(e), SEED)


@query(f"WITH {NATION} SELECT event_idx, src AS node FROM e UNION SELECT a.event_idx, b.dst FROM e a JOIN e b ON a.src = b.src AND a.day = b.day AND a.dst <> b.dst")
def vocabulary_mask(spark, d):
    e = edges(spark, d, "nation")
    nodes = e.select(F.col("src").alias("node_id")).union(e.select("dst")).distinct()
    return sampling.vocabulary_mask(e, nodes)


@query(f"""WITH {PARTY}, p AS (SELECT event_idx FROM e WHERE split = 'val' ORDER BY md5(concat_ws('|', {SEED}, 'probe', event_idx)), event_idx LIMIT 500)
SELECT event_idx, j, {_h(SEED, "'candidate'", "event_idx", "j")} % {_NN} AS node FROM p CROSS JOIN range(100) x(j)""")
def mrr_probe(spark, d):
    e = edges(spark, d, "party")
    return sampling.probe(e, n_nodes(e), SEED)


# Memorisation and metrics


def _scored(e, neg, key: str = "clock", window: bool = False, frozen: bool = False, span: str = "test"):
    """Positives and negatives of a span with their memorisation score: clock, k, y, score, seen (of the pair)."""
    events = sampling.batches(e, span) if key == "clock" else e.where(F.col("split") == span).withColumn("clock", F.col("day").cast("long"))
    start = F.broadcast(events.agg(F.min("event_idx").alias("_lo")))
    ahead = e.crossJoin(start).where("event_idx < _lo").drop("_lo").withColumn("clock", F.lit(-1).cast("long"))
    memory_of = ahead.select("src", "dst", "day", "clock")
    if not frozen:
        memory_of = memory_of.unionByName(events.select("src", "dst", "day", "clock"))
    place = F.col("i") if "i" in events.columns else F.row_number().over(W.partitionBy("clock").orderBy("event_idx")) - 1
    pos = events.select("clock", place.cast("long").alias("k"), "src", "dst", "day", F.lit(1).alias("y"))
    rows = pos.unionByName(neg.select("clock", "k", "src", "dst", "day", F.lit(0).alias("y")))
    rows = rows.withColumn("query_id", F.xxhash64("clock", "k", "y"))
    score = memory.edgebank(memory_of, rows, "clock", memory.span_days(e, span) if window else None)
    old = grown(ahead.select("src", "dst").distinct().withColumn("seen", F.lit(True)))
    return rows.join(grown(score), "query_id").join(old, ["src", "dst"], "left").select("clock", "k", "y", "day", "score", F.coalesce("seen", F.lit(False)).alias("seen"))


def _bank(window: bool = False, frozen: bool = False, span: str = "test") -> str:
    """Table sc from pos and neg: clock, k, y, day, score, seen."""
    hit = "max(m.day) > min(x.day) - (SELECT max(day) - min(day) + 1 FROM pos)" if window else "count(m.day) > 0"
    memory_sql = "SELECT src, dst, day, -1 AS clock FROM e WHERE event_idx < (SELECT min(event_idx) FROM pos)" + ("" if frozen else " UNION ALL SELECT src, dst, day, clock FROM pos")
    return f"""m AS MATERIALIZED ({memory_sql}), x AS MATERIALIZED (SELECT clock, i AS k, src, dst, day, 1 AS y FROM pos UNION ALL SELECT clock, k, src, dst, day, 0 FROM neg),
sc AS MATERIALIZED (SELECT x.clock, k, y, x.day, CASE WHEN {hit} THEN 1.0 ELSE 0.0 END AS score, count(m.day) FILTER (m.clock = -1) > 0 AS seen FROM x LEFT JOIN m ON m.src = x.src AND m.dst = x.dst AND m.clock < x.clock GROUP BY x.clock, k, y, x.day)"""


def _au(where: str = "", group: str = "", source: str = "sc") -> str:
    """The area by direct comparison of scores, as a subquery."""
    keys = f"{group}, " if group else ""
    return f"""(SELECT {keys}CASE WHEN sum(p) * sum(n) > 0 THEN sum(p * (below + n / 2.0)) / (sum(p) * sum(n)) END AS auroc FROM (SELECT {keys}p, n, coalesce(sum(n) OVER ({f'PARTITION BY {group} ' if group else ''}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT {keys}score, sum(y) AS p, sum(1 - y) AS n FROM {source} {where} GROUP BY {keys}score)) {f'GROUP BY {group}' if group else ''})"""


for _name, _window, _frozen in (("inf", False, False), ("tw", True, False), ("frozen", False, True)):
    for _s in ("historical", "inductive"):

        def _eb(spark, d, window=_window, frozen=_frozen, strategy=_s):
            e = edges(spark, d, "nation" if strategy == "historical" else "party")
            return _scored(e, sampling.batch_negatives(e, strategy, SEED), window=window, frozen=frozen).drop("day", "seen")

        _n = f"edgebank_{_name}_dgb_{_s}"
        QUERIES[_n] = _eb
        ORACLE_SQL[_n] = f"WITH {NATION if _s == 'historical' else PARTY}, {_dgb(_s)}, {_bank(_window, _frozen)} SELECT clock, k, y, score FROM sc"

_LEGACY = f"""{_legacy('historical')}, pos AS MATERIALIZED (SELECT *, day AS clock, row_number() OVER (PARTITION BY day ORDER BY event_idx) - 1 AS i FROM e WHERE split = 'test'), neg AS MATERIALIZED (SELECT clock, k, src, dst, clock AS day FROM topped)"""


def _legacy_scored(spark, d, window=False):
    e = edges(spark, d, "nation")
    neg = sampling.day_negatives(e, "historical", SEED, n_nodes(e)).withColumn("day", F.col("clock").cast("int")).withColumn("clock", F.col("clock").cast("long"))
    return _scored(e, neg, "day", window)


@query(f"WITH {NATION}, {_LEGACY}, {_bank()} SELECT clock, k, y, score FROM sc")
def edgebank_inf_legacy(spark, d):
    return _legacy_scored(spark, d).drop("day", "seen")


@query(f"WITH {NATION}, {_LEGACY}, {_bank(True)} SELECT clock, k, y, score FROM sc")
def edgebank_tw_legacy(spark, d):
    return _legacy_scored(spark, d, True).drop("day", "seen")


@query(f"WITH {NATION}, {_LEGACY}, {_bank()} SELECT round(auroc, 6) AS auroc FROM {_au()}")
def auroc_legacy(spark, d):
    return rounded(metrics.auroc(_legacy_scored(spark, d)))


_AP = """(SELECT sum(p * tp / al) / sum(p) AS ap FROM (SELECT p, sum(p) OVER w AS tp, sum(p + n) OVER w AS al FROM (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)))"""


@query(f"WITH {NATION}, {_LEGACY}, {_bank()} SELECT round(ap, 6) AS ap FROM {_AP}")
def ap_legacy(spark, d):
    return rounded(metrics.average_precision(_legacy_scored(spark, d)))


@query(f"WITH {NATION}, {_LEGACY}, {_bank(True)} SELECT day, round(auroc, 6) AS auroc FROM {_au(group='day')}")
def auroc_per_day(spark, d):
    return rounded(metrics.auroc(_legacy_scored(spark, d, True), ["day"]))


_STRATA = "(SELECT *, 'all' AS stratum FROM sc UNION ALL SELECT sc.*, CASE WHEN p.seen THEN 'seen' ELSE 'unseen' END FROM sc JOIN (SELECT clock, k, seen FROM sc WHERE y = 1) p ON p.clock = sc.clock AND p.k = sc.k)"


@query(f"WITH {PARTY}, {_dgb('random')}, {_bank()} SELECT stratum, round(auroc, 6) AS auroc FROM {_au(group='stratum', source=_STRATA)}")
def auroc_strata(spark, d):
    e = edges(spark, d, "party")
    s = _scored(e, sampling.batch_negatives(e, "random", SEED))
    mark = s.where("y = 1").select("clock", "k", "seen")
    return rounded(metrics.auroc(metrics.strata(s.drop("seen").join(grown(mark), ["clock", "k"])), ["stratum"]))


@query(f"WITH {NATION}, {_dgb('historical')}, {_bank(True)} SELECT round(avg(auroc), 6) AS auroc, count(*) AS batches FROM {_au(group='clock')} WHERE auroc IS NOT NULL")
def auroc_dgb_batch(spark, d):
    e = edges(spark, d, "nation")
    return rounded(metrics.batch_auroc(_scored(e, sampling.batch_negatives(e, "historical", SEED), window=True)))


_SYM = "(SELECT * FROM sc WHERE y = 0 OR NOT seen)"


@query(f"WITH {PARTY}, {_dgb('inductive')}, {_bank()} SELECT round(avg(auroc), 6) AS auroc, count(*) AS batches FROM {_au(group='clock', source=_SYM)} WHERE auroc IS NOT NULL")
def inductive_sym(spark, d):
    """Only positives that are new pairs, against negatives first seen in the span."""
    e = edges(spark, d, "party")
    return rounded(metrics.batch_auroc(_scored(e, sampling.batch_negatives(e, "inductive", SEED)).where("y = 0 OR NOT seen")))


@query(f"WITH {PARTY}, {_dgb('recurring')}, {_bank()} SELECT round(avg(auroc), 6) AS auroc, count(*) AS batches FROM {_au(group='clock')} WHERE auroc IS NOT NULL")
def test_recurring(spark, d):
    e = edges(spark, d, "party")
    return rounded(metrics.batch_auroc(_scored(e, sampling.batch_negatives(e, "recurring", SEED))))


@query(f"WITH {PARTY}, {_dgb('inductive', 3)}, {_bank()} SELECT round(avg(auroc), 6) AS auroc, count(*) AS batches FROM {_au(group='clock')} WHERE auroc IS NOT NULL")
def auroc_ratio3(spark, d):
    e = edges(spark, d, "party")
    return rounded(metrics.batch_auroc(_scored(e, sampling.batch_negatives(e, "inductive", SEED, n_neg=3))))


_J = "(SELECT arg_max(score, (j, score)) AS threshold, max(j) AS j FROM (SELECT score, sum(p) OVER w / sum(p) OVER () - sum(n) OVER w / sum(n) OVER () AS j FROM (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM sc GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)))"


@query(f"WITH {NATION}, {_dgb('historical', 1, 'val')}, {_bank(True)} SELECT threshold, round(j, 6) AS j FROM {_J}")
def youden_val(spark, d):
    e = edges(spark, d, "nation")
    return rounded(metrics.youden(_scored(e, sampling.batch_negatives(e, "historical", SEED, span="val"), window=True, span="val")))


@query(f"""WITH {NATION}, {_dgb('historical')}, {_bank(True)}, th AS (SELECT 1.0 AS threshold)
SELECT round(coalesce(count(*) FILTER (score >= threshold AND y = 0) / nullif(count(*) FILTER (score >= threshold), 0), 0.0), 6) AS fdr, round(coalesce(count(*) FILTER (score < threshold AND y = 0) / nullif(count(*) FILTER (score < threshold), 0), 0.0), 6) AS npv, round(avg(y), 6) AS prevalence FROM sc CROSS JOIN th""")
def fdr_npv(spark, d):
    e = edges(spark, d, "nation")
    s = _scored(e, sampling.batch_negatives(e, "historical", SEED), window=True)
    return rounded(metrics.fdr_npv(s, spark.range(1).select(F.lit(1.0).alias("threshold"))))


def _chain_sql() -> str:
    """The threshold of the validation span, and the scores of the test span."""
    val = f"vj AS MATERIALIZED (WITH {_dgb('historical', 1, 'val')}, {_bank(True)} SELECT threshold, j FROM {_J})"
    return f"{val}, {_dgb('historical')}, {_bank(True)}"


@query(f"""WITH {NATION}, {_chain_sql()} SELECT threshold, round(coalesce(count(*) FILTER (score >= threshold AND y = 0) / nullif(count(*) FILTER (score >= threshold), 0), 0.0), 6) AS fdr,
  round(coalesce(count(*) FILTER (score < threshold AND y = 0) / nullif(count(*) FILTER (score < threshold), 0), 0.0), 6) AS npv, round(avg(y), 6) AS prevalence FROM sc CROSS JOIN vj GROUP BY threshold""")
def fdr_npv_at_val_threshold(spark, d):
    """The threshold fitted on the validation span, frozen, applied to the test span."""
    e = edges(spark, d, "nation")
    scores = lambda span: _scored(e, sampling.batch_negatives(e, "historical", SEED, span=span), window=True, span=span)
    t = cut(metrics.youden(scores("val")).select("threshold"))
    return rounded(metrics.fdr_npv(scores("test"), t).crossJoin(F.broadcast(t)))


_YB = """yb AS MATERIALIZED (SELECT event_idx, split, log10(usd_sum) AS y, last_value(log10(usd_sum) IGNORE NULLS) OVER (PARTITION BY src, dst ORDER BY event_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM e WHERE usd_sum > 0),
md AS (SELECT median(y) AS median FROM yb WHERE split = 'train'), ab AS MATERIALIZED (SELECT event_idx, y, coalesce(prior, median) AS persistence, median, prior IS NOT NULL AS seen FROM yb CROSS JOIN md WHERE split = 'test')"""


@query(f"WITH {NATION}, {_YB} SELECT event_idx, round(y, 6) AS y, round(persistence, 6) AS persistence, round(median, 6) AS median, seen FROM ab")
def amount_baselines(spark, d):
    return rounded(memory.amount_baselines(edges(spark, d, "nation", amounts=True)))


@query(f"WITH {PARTY}, {_YB} SELECT seen, round(sqrt(avg((persistence - y) ** 2)), 6) AS rmse, round(avg(abs(persistence - y)), 6) AS mae FROM ab GROUP BY seen")
def amount_errors(spark, d):
    return rounded(metrics.errors(memory.amount_baselines(edges(spark, d, "party", amounts=True)), "y", "persistence", ["seen"]))


_RANKS = """t AS MATERIALIZED (SELECT event_idx, src, dst, day FROM e WHERE split = 'test'), lp AS MATERIALIZED (SELECT t.event_idx, t.src, t.day, t.dst AS target, e.dst AS partner, max(e.day) AS last FROM t JOIN e ON e.src = t.src AND e.day < t.day GROUP BY ALL),
cand AS MATERIALIZED (SELECT t.event_idx, t.dst AS target, node_id AS c, coalesce(last, -1) AS score, node_id = t.dst AS is_target, node_id <> t.dst AND EXISTS (SELECT 1 FROM t o WHERE o.src = t.src AND o.day = t.day AND o.dst = node_id) AS left_out
  FROM t CROSS JOIN nodes LEFT JOIN lp ON lp.event_idx = t.event_idx AND lp.partner = node_id),
rk AS MATERIALIZED (SELECT a.event_idx, 1 + count(*) FILTER (b.score > a.score) + 0.5 * count(*) FILTER (b.score = a.score) AS rank FROM cand a LEFT JOIN cand b ON b.event_idx = a.event_idx AND NOT b.is_target AND NOT b.left_out WHERE a.is_target GROUP BY a.event_idx),
rs AS MATERIALIZED (SELECT rk.event_idx, rank, EXISTS (SELECT 1 FROM e WHERE e.split <> 'test' AND e.src = t.src AND e.dst = t.dst) AS seen FROM rk JOIN t USING (event_idx))"""


@query(f"WITH {NATION}, {_RANKS} SELECT event_idx, rank::DOUBLE AS rank, seen FROM rs")
def recency_ranks(spark, d):
    e = edges(spark, d, "nation")
    return ranking.recency_ranks(e, n_nodes(e))


@query(f"""WITH {NATION}, {_RANKS} SELECT stratum, count(*) AS n, round(avg(1 / rank), 6) AS mrr, round(avg((rank <= 1)::INT), 6) AS hits1, round(avg((rank <= 10)::INT), 6) AS hits10, round(avg((rank <= 100)::INT), 6) AS hits100
FROM (SELECT *, unnest(['all', CASE WHEN seen THEN 'seen' ELSE 'unseen' END]) AS stratum FROM rs) GROUP BY stratum""")
def recency_ranking(spark, d):
    e = edges(spark, d, "nation")
    return rounded(metrics.rank_metrics(ranking.recency_ranks(e, n_nodes(e))))


@query(f"""WITH {NATION}, {_RANKS.split('cand AS')[0].rstrip().rstrip(',')}, x AS (SELECT t.event_idx, count(partner) AS partners, max(last) FILTER (partner = target) AS mine FROM t LEFT JOIN lp USING (event_idx) GROUP BY t.event_idx),
z AS (SELECT x.*, CASE WHEN mine IS NOT NULL THEN 1 + (SELECT count(*) FROM lp WHERE lp.event_idx = x.event_idx AND last > mine) END AS place FROM x)
SELECT mine IS NOT NULL AS is_partner, count(*) AS n, count(*) FILTER (place = 1) AS latest, median(partners) AS median_partners, median(place) AS median_place FROM z GROUP BY 1""")
def partner_strata(spark, d):
    return ranking.partner_strata(edges(spark, d, "nation"))


def _candidates(spark, d):
    """Test edges with every target as candidate and a popularity score."""
    e = edges(spark, d, "nation")
    t = e.where("split = 'test'").select("event_idx", "src", "dst", "day")
    nodes = e.groupBy(F.col("dst").alias("c")).agg(F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("pop"))
    p = ranking.partner_rows(e).where("partner IS NOT NULL").select("event_idx", F.col("partner").alias("c"), "last")
    same = e.where("split = 'test'").select("src", "day", F.col("dst").alias("c"), F.lit(True).alias("o"))
    j = with_all(t, nodes.select("c"), "c").join(nodes, "c").join(p, ["event_idx", "c"], "left").join(same, ["src", "day", "c"], "left")
    return j.select("event_idx", "c", F.col("pop").cast("double").alias("score"), (F.col("c") == F.col("dst")).alias("is_target"), (F.coalesce("o", F.lit(False)) & (F.col("c") != F.col("dst"))).alias("left_out"), "last", (F.col("pop") > 0).alias("globally_seen"))


_CAND = f"""{_RANKS.split('cand AS')[0].rstrip().rstrip(',')}, pp AS (SELECT dst AS c, count(*) FILTER (split = 'train') AS pop FROM e GROUP BY dst),
cd AS MATERIALIZED (SELECT t.event_idx, c, pop::DOUBLE AS score, c = t.dst AS is_target, c <> t.dst AND EXISTS (SELECT 1 FROM t o WHERE o.src = t.src AND o.day = t.day AND o.dst = c) AS left_out, last, pop > 0 AS globally_seen
  FROM t CROSS JOIN pp LEFT JOIN lp ON lp.event_idx = t.event_idx AND lp.partner = c)"""


@query(f"WITH {NATION}, {_CAND} SELECT a.event_idx, (1 + count(*) FILTER (b.score > a.score) + 0.5 * count(*) FILTER (b.score = a.score))::DOUBLE AS rank FROM cd a LEFT JOIN cd b ON b.event_idx = a.event_idx AND NOT b.is_target AND NOT b.left_out WHERE a.is_target GROUP BY a.event_idx")
def filtered_ranks(spark, d):
    return ranking.filtered_ranks(_candidates(spark, d))


@query(f"""WITH {NATION}, {_CAND}, k AS (SELECT *, coalesce(last, -1) AS l FROM cd) SELECT a.event_idx, (1 + count(*) FILTER (b.l > a.l OR b.l = a.l AND b.score > a.score) + 0.5 * count(*) FILTER (b.l = a.l AND b.score = a.score))::DOUBLE AS rank
FROM k a LEFT JOIN k b ON b.event_idx = a.event_idx AND NOT b.is_target AND NOT b.left_out WHERE a.is_target GROUP BY a.event_idx""")
def lexicographic_ranks(spark, d):
    return ranking.lexicographic_ranks(_candidates(spark, d))


@query(f"""WITH {NATION}, {_CAND} SELECT CASE WHEN b.last IS NOT NULL THEN 'partner' WHEN b.globally_seen THEN 'global_seen' ELSE 'never_seen' END AS kind, count(*) AS n
FROM cd a JOIN cd b ON b.event_idx = a.event_idx AND NOT b.is_target AND NOT b.left_out AND b.score > a.score WHERE a.is_target AND a.last IS NOT NULL GROUP BY 1""")
def outrankers(spark, d):
    return ranking.outrankers(_candidates(spark, d))


@query(f"""WITH {NATION}, {_CAND}, k AS (SELECT event_idx, row_number() OVER (PARTITION BY event_idx ORDER BY score, c) AS a, row_number() OVER (PARTITION BY event_idx ORDER BY last, c) AS b FROM cd WHERE last IS NOT NULL)
SELECT event_idx, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY event_idx HAVING count(*) >= 5""")
def recency_spearman(spark, d):
    return rounded(metrics.spearman(_candidates(spark, d).where("last IS NOT NULL"), "score", "last", ["event_idx"], 5, "c"))


_UNPIVOT = "(SELECT 'pair_freq' AS signal, y, pn::DOUBLE AS score FROM fs UNION ALL SELECT 'dst_freq', y, dn FROM fs UNION ALL SELECT 'dst_freq7', y, d7 FROM fs)"


@query(f"""WITH {PARTY}, {_dgb('random')}, al AS MATERIALIZED (SELECT src, dst, day, 1 AS y, row_number() OVER () AS id FROM pos UNION ALL SELECT src, dst, day, 0, 1000000000 + row_number() OVER () FROM neg),
fp AS (SELECT id, count(e.day) AS pn FROM al LEFT JOIN e ON e.src = al.src AND e.dst = al.dst AND e.day < al.day GROUP BY id),
fd AS (SELECT id, count(e.day) AS dn, count(e.day) FILTER (e.day >= al.day - 7) AS d7 FROM al LEFT JOIN e ON e.dst = al.dst AND e.day < al.day GROUP BY id),
fs AS MATERIALIZED (SELECT y, pn, dn, d7 FROM al JOIN fp USING (id) JOIN fd USING (id))
SELECT signal, round(auroc, 6) AS auroc FROM {_au(group='signal', source=_UNPIVOT)}""")
def signal_auroc(spark, d):
    e = edges(spark, d, "party")
    rows = sampling.batches(e, "test").select("clock", F.col("i").alias("k"), "src", "dst", "day", F.lit(1).alias("y")).unionByName(sampling.batch_negatives(e, "random", SEED).select("clock", "k", "src", "dst", "day", F.lit(0).alias("y")))
    rows = rows.withColumn("query_id", F.xxhash64("clock", "k", "y"))
    f = feat.features(plain(e), rows.select("query_id", F.col("src").alias("s"), F.col("dst").alias("d"), "day"), ("pair_freq", "dst_freq", "dst_freq7"))
    long = rows.select("query_id", "y").join(f, "query_id").unpivot(["query_id", "y"], ["pair_freq", "dst_freq", "dst_freq7"], "signal", "score")
    return rounded(metrics.auroc(long, ["signal"]))


_SIGNALS = ("pair_freq", "pair_recency", "pair_age", "src_freq", "src_freq30", "dst_freq", "dst_freq7", "dst_freq30", "dst_recency", "out_deg_s", "in_deg_c", "dt_7")


def _signal_rows(spark, d):
    """Positives and inductive negatives of the test span with all signals: y, seen (before the span), score by signal."""
    e = edges(spark, d, "party")
    pos = sampling.batches(e, "test").select("clock", F.col("i").alias("k"), "src", "dst", "day", F.lit(1).alias("y"))
    neg = sampling.batch_negatives(e, "historical", SEED).select("clock", "k", "src", "dst", "day", F.lit(0).alias("y"))
    old = grown(e.where("split <> 'test'").select("src", "dst").distinct().withColumn("seen", F.lit(True)))
    rows = cut(pos.unionByName(neg).join(old, ["src", "dst"], "left").withColumns({"seen": F.coalesce("seen", F.lit(False)), "query_id": F.xxhash64("clock", "k", "y")}))
    f = feat.features(plain(e), rows.select("query_id", F.col("src").alias("s"), F.col("dst").alias("d"), "day"), _SIGNALS)
    return rows.select("query_id", "y", "seen").join(grown(f), "query_id")


_STRATUM = {"newpos_vs_newneg": "NOT seen", "seenpos_vs_newneg": "(y = 1 AND seen) OR (y = 0 AND NOT seen)", "allpos_vs_activeneg": "y = 1 OR seen"}
_SIG = f"""al AS MATERIALIZED (SELECT row_number() OVER () AS query_id, src AS s, dst AS c, day AS t, y FROM (SELECT src, dst, day, 1 AS y FROM pos UNION ALL SELECT src, dst, day, 0 FROM neg)),
lab AS MATERIALIZED (SELECT query_id, y, EXISTS (SELECT 1 FROM e p WHERE p.split <> 'test' AND p.src = al.s AND p.dst = al.c) AS seen FROM al),
sg AS MATERIALIZED (SELECT query_id, lab.y, lab.seen, {', '.join(f'{_COLUMN_SQL[x]}::DOUBLE AS {x}' for x in _SIGNALS)} {_FROM} JOIN lab USING (query_id)),
lg AS MATERIALIZED (SELECT query_id, y, seen, signal, score FROM sg UNPIVOT (score FOR signal IN ({', '.join(_SIGNALS)}))),
st AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{k}' AS stratum, signal, y, score FROM lg WHERE {w}" for k, w in _STRATUM.items())})"""
_SIGRAW = _RAW.replace(_Q, "q AS MATERIALIZED (SELECT query_id, s, c, t FROM al)")


@query(f"WITH {PARTY}, {_dgb('historical')}, {_SIG.split('sg AS')[0]}{_SIGRAW}, sg AS{_SIG.split('sg AS')[1]} SELECT stratum, signal, round(auroc, 6) AS auroc FROM {_au(group='stratum, signal', source='st')}")
def signal_strata(spark, d):
    """The area of every signal over three strata of positives and negatives."""
    f = _signal_rows(spark, d).unpivot(["query_id", "y", "seen"], list(_SIGNALS), "signal", "score")
    of = F.array_compact(F.array(*[F.when(F.expr(w), F.lit(k)) for k, w in _STRATUM.items()]))
    return rounded(metrics.auroc(f.withColumn("stratum", F.explode(of)), ["stratum", "signal"]))


_PROBE = f"""p AS MATERIALIZED (SELECT event_idx, src, dst, day FROM e WHERE split = 'val' ORDER BY md5(concat_ws('|', {SEED}, 'probe', event_idx)), event_idx LIMIT 500),
pc AS MATERIALIZED (SELECT DISTINCT event_idx, node FROM (SELECT event_idx, {_h(SEED, "'candidate'", "event_idx", "j")} % {_NN} AS node FROM p CROSS JOIN range(100) x(j) UNION ALL SELECT event_idx, dst FROM p)),
ps AS MATERIALIZED (SELECT p.event_idx, pc.node, pc.node = p.dst AS hit, coalesce(max(e.day), -1) AS score FROM pc JOIN p USING (event_idx) LEFT JOIN e ON e.src = p.src AND e.dst = pc.node AND e.day < p.day GROUP BY ALL),
pr AS MATERIALIZED (SELECT a.event_idx, 1 + count(*) FILTER (b.score > a.score AND NOT b.hit) + 0.5 * count(*) FILTER (b.score = a.score AND NOT b.hit) AS rank FROM ps a JOIN ps b USING (event_idx) WHERE a.hit GROUP BY a.event_idx)"""


def _probe_ranks(e):
    p = sampling.probe(e, n_nodes(e), SEED)
    own = e.select("event_idx", "src", "dst", "day").join(p.select("event_idx").distinct(), "event_idx")
    c = p.select("event_idx", "node").union(own.select("event_idx", "dst")).distinct().join(own, "event_idx").withColumn("query_id", F.xxhash64("event_idx", "node"))
    last = asof.last_before(plain(e), c.select("query_id", F.col("src").alias("s"), F.col("node").alias("d"), "day"))
    return ranking.filtered_ranks(c.join(last, "query_id").select("event_idx", F.coalesce("last", F.lit(-1)).alias("score"), (F.col("node") == F.col("dst")).alias("is_target"), F.lit(False).alias("left_out")))


@query(f"WITH {PARTY}, {_PROBE} SELECT round(avg(1 / rank), 6) AS mrr, count(*) AS n FROM pr")
def sampled_val_mrr(spark, d):
    """The mean reciprocal rank of the last contact over the probe's candidates and the target."""
    return rounded(_probe_ranks(edges(spark, d, "party")).agg(F.avg(1.0 / F.col("rank")).alias("mrr"), F.count("*").alias("n")))


@query(f"WITH {NATION}, {_LEGACY}, {_bank()}, {_PROBE} SELECT round(sqrt(greatest((SELECT avg(1 / rank) FROM pr), 0) * greatest(ap, 0)), 6) AS combo FROM {_AP}")
def combined_metric(spark, d):
    """The geometric mean of the probe's MRR and the average precision, by which models are selected."""
    e = edges(spark, d, "nation")
    mrr = _probe_ranks(e).agg(F.avg(1.0 / F.col("rank")).alias("mrr"))
    return rounded(metrics.average_precision(_legacy_scored(spark, d)).crossJoin(mrr).select(metrics.combined(F.col("mrr"), F.col("ap")).alias("combo")))


@query(f"""WITH {NATION}, b AS MATERIALIZED (SELECT *, (event_idx - min(event_idx) OVER ()) // 50 AS clock FROM e WHERE split = 'test')
SELECT x.event_idx AS i, y.event_idx AS j, x.src, y.dst, y.dst = x.dst OR y.dst = x.src OR EXISTS (SELECT 1 FROM e p WHERE p.src = x.src AND p.dst = y.dst AND p.day = x.day) AS masked FROM b x JOIN b y ON x.clock = y.clock AND x.event_idx <> y.event_idx""")
def in_batch_negatives(spark, d):
    """The other targets of each batch of 50 as negatives of a source; masked where they are its own that day."""
    e = edges(spark, d, "nation")
    return sampling.in_batch(sampling.batches(e, "test", 50), e)


_LOSS = "SELECT * FROM (SELECT event_id, (value - 50) / 25.0 AS z, (event_id % 2)::INT AS y FROM events)"


@query(f"""SELECT y, round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z)))), 6) AS bce, round(avg(greatest(0, 1 - (2 * y - 1) * z)), 6) AS hinge, round(avg(CASE WHEN abs(z - y) <= 1 THEN 0.5 * (z - y) ** 2 ELSE abs(z - y) - 0.5 END), 6) AS huber,
  round(avg(greatest(z, 0) - z * y + ln(1 + exp(-abs(z))) + 0.1 * CASE WHEN abs(z - y) <= 1 THEN 0.5 * (z - y) ** 2 ELSE abs(z - y) - 0.5 END), 6) AS two_term FROM ({_LOSS}) GROUP BY y""")
def losses(spark, d):
    rows = table(spark, d, "events").select(((F.col("value") - 50) / 25.0).alias("z"), (F.col("event_id") % 2).cast("int").alias("y"))
    z, y = F.col("z"), F.col("y")
    return rounded(rows.groupBy("y").agg(*[F.avg(x).alias(n) for n, x in (("bce", bce(z, y)), ("hinge", hinge(z, y)), ("huber", huber(z, y)), ("two_term", bce(z, y) + 0.1 * huber(z, y)))]))


_HISTORY = "SELECT (user_id % 5)::INT AS seed, date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE)::INT AS epoch, avg(value) AS value FROM events GROUP BY ALL"


@query(f"""WITH h AS MATERIALIZED ({_HISTORY}), s AS MATERIALIZED (SELECT *, max(value) OVER (PARTITION BY seed ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM h),
i AS MATERIALIZED (SELECT seed, epoch, value, max(CASE WHEN best IS NULL OR value > best THEN epoch END) OVER (PARTITION BY seed ORDER BY epoch) AS since FROM s), z AS (SELECT seed, min(epoch) FILTER (epoch - since >= 5) AS stop FROM i GROUP BY seed)
SELECT i.seed, arg_max(epoch, (value, -epoch)) AS epoch, round(max(value), 6) AS value, max(epoch) AS last FROM i JOIN z USING (seed) WHERE stop IS NULL OR epoch <= stop GROUP BY i.seed""")
def selected_epochs(spark, d):
    """The best epoch of each seed, as training stops after five epochs without a better one."""
    e = table(spark, d, "events")
    h = e.crossJoin(F.broadcast(e.agg(F.min("ts").cast("date").alias("first")))).groupBy((F.col("user_id") % 5).cast("int").alias("seed"), F.datediff(F.col("ts").cast("date"), "first").alias("epoch")).agg(F.avg("value").alias("value"))
    return rounded(metrics.selected(h, patience=5))


@query(f"WITH {NATION}, i AS (SELECT src AS node, event_idx, txn FROM e UNION ALL SELECT dst, event_idx, txn FROM e) SELECT node, count(*) AS n, round(avg(txn), 6) AS txn, round(avg(ln(1.0 + txn)), 6) AS ln_txn FROM i GROUP BY node")
def message_means(spark, d):
    """The mean of the messages that reach each node, from both ends of its edges."""
    e = edges(spark, d, "nation", amounts=True).select("src", "dst", F.col("txn").cast("double").alias("txn"), F.ln(1.0 + F.col("txn")).alias("ln_txn"))
    return rounded(graph.scatter_mean(e, ["txn", "ln_txn"]))


# Reports over tidy metrics: areas of three seeds and two memory kinds

_TIDY = "td AS MATERIALIZED (SELECT event_type AS model, (user_id % 3)::INT AS seed, 'value' AS metric, avg(value) AS value FROM events GROUP BY ALL)"


def _tidy(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).cast("int").alias("seed"), F.lit("value").alias("metric")).agg(F.avg("value").alias("value"))


@query(f"WITH {_TIDY} SELECT model, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(value) AS seeds FROM td GROUP BY model, metric")
def metric_over_seeds(spark, d):
    return rounded(metrics.over_seeds(_tidy(spark, d), ["model", "metric"]))


@query(f"WITH {_TIDY}, ref AS (SELECT min(model) AS m FROM td) SELECT a.model, a.seed, a.metric, round(a.value - b.value, 6) AS delta FROM td a JOIN td b ON a.seed = b.seed AND b.model = (SELECT m FROM ref) WHERE a.model <> b.model")
def seed_deltas(spark, d):
    t = _tidy(spark, d)
    return rounded(metrics.seed_deltas(t, t.agg(F.min("model").alias("model"))))


@query("SELECT epoch, round(avg(value), 6) AS value, count(*) AS seeds FROM (SELECT user_id % 5 AS seed, date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE)::INT AS epoch, avg(value) AS value FROM events WHERE date_diff('day', (SELECT min(ts) FROM events)::DATE, ts::DATE) <= 10 + 4 * (user_id % 5) GROUP BY ALL) GROUP BY epoch")
def epoch_means(spark, d):
    e = table(spark, d, "events")
    h = e.crossJoin(F.broadcast(e.agg(F.min("ts").cast("date").alias("first")))).withColumn("epoch", F.datediff(F.col("ts").cast("date"), "first")).where(F.col("epoch") <= 10 + 4 * (F.col("user_id") % 5))
    return rounded(metrics.epoch_means(h.groupBy((F.col("user_id") % 5).alias("seed"), "epoch").agg(F.avg("value").alias("value"))))


@query(f"""WITH {NATION}, {_CAND}, sc AS (SELECT event_idx, c, 'pop' AS model, score FROM cd UNION ALL SELECT event_idx, c, 'last', coalesce(last, -1) FROM cd), w AS (SELECT model, avg(score) AS m, stddev_pop(score) AS s FROM sc GROUP BY model)
SELECT event_idx, c, round(avg((score - m) / CASE WHEN s = 0 THEN 1 ELSE s END), 5) AS score FROM sc JOIN w USING (model) GROUP BY event_idx, c""")
def score_ensemble(spark, d):
    c = _candidates(spark, d)
    s = c.select("event_idx", "c", F.lit("pop").alias("model"), "score").unionByName(c.select("event_idx", "c", F.lit("last").alias("model"), F.coalesce(F.col("last").cast("double"), F.lit(-1.0)).alias("score")))
    return rounded(metrics.z_mean(s, "model", ["event_idx", "c"]), 5)


@query(f"""WITH {NATION}, {_CAND} SELECT event_idx, round(-(max(score / 100.0) FILTER (is_target) - ln(sum(exp(score / 100.0)))), 5) AS loss FROM cd WHERE NOT left_out GROUP BY event_idx""")
def softmax_loss(spark, d):
    c = _candidates(spark, d).where("NOT left_out")
    g = c.groupBy("event_idx").agg(F.collect_list(F.col("score") / 100.0).alias("all"), F.max(F.when(F.col("is_target"), F.col("score") / 100.0)).alias("hit"))
    return rounded(g.select("event_idx", (logsumexp(F.col("all")) - F.col("hit")).alias("loss")), 5)


@query("SELECT event_id, round(cos(x), 6) AS e0, round(cos(x * pow(10.0, -4.0 / 3)), 6) AS e1, round(cos(x * pow(10.0, -8.0 / 3)), 6) AS e2, round(cos(x * 1e-4), 6) AS e3 FROM (SELECT event_id, (event_id % 365)::DOUBLE AS x FROM events)")
def time_encodings(spark, d):
    v = time_encoding((F.col("event_id") % 365).cast("double"), 4)
    return rounded(table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", *[F.col("v")[k].alias(f"e{k}") for k in range(4)]))


@query(f"""WITH {PARTY}, dd AS (SELECT DISTINCT day FROM e WHERE split = 'test'), md AS (SELECT median(day) AS m FROM dd), a AS MATERIALIZED (SELECT e.*, day <= m AS early FROM e CROSS JOIN md WHERE split = 'test')
SELECT early, count(*) AS n, count(*) FILTER (NOT EXISTS (SELECT 1 FROM a b WHERE b.early AND b.src = a.src AND b.dst = a.dst)) AS novel FROM a GROUP BY early""")
def day_split(spark, d):
    """Test edges up to the median active day and after it, and how many pairs of each part the first does not have."""
    t = edges(spark, d, "party").where("split = 'test'")
    a = t.crossJoin(F.broadcast(t.select("day").distinct().agg(F.expr("percentile(day, 0.5)").alias("m")))).withColumn("early", F.col("day") <= F.col("m"))
    known = a.where("early").select("src", "dst", F.lit(1).alias("known")).distinct()
    return a.join(known, ["src", "dst"], "left").groupBy("early").agg(F.count("*").alias("n"), (F.count("*") - F.count("known")).alias("novel"))




# Fitted scorers and the streaming replay; SQL has no counterpart of these, or only of their results


def _fitted(spark, d, hidden=()):
    """A day is of one split. Features of these columns are joined by key and day, so a query's number need not be its own:
    it tells split and y, and no row is joined to get them back. The rows that are kept are the distinct ones, counted."""
    e = edges(spark, d, "party")
    names = ("train", "val", "test")
    kind = sum((F.when(F.col("split") == name, k).otherwise(0) for k, name in enumerate(names)), F.lit(0))
    days = F.broadcast(cut(e.select("day", kind.alias("kind")).distinct()))  # the calendar
    pairs = labelled(e.select("event_idx", "src", "dst", "day"), sampling.uniform_targets(e, n_nodes(e), SEED).select("event_idx", "src", F.col("neg_dst").alias("dst"), "day")).join(days, "day")
    pairs = cut(pairs.select((F.col("y") * len(names) + F.col("kind")).cast("long").alias("query_id"), F.col("src").alias("s"), F.col("dst").alias("d"), "day"))  # read several times
    columns = ["dst_freq", "dst_freq30", "dst_recency", "pair_freq", "src_freq"]
    f = feat.features(plain(e), pairs, tuple(columns)).withColumns({
        "split": F.element_at(F.array(*map(F.lit, names)), (F.col("query_id") % len(names) + 1).cast("int")),
        "y": (F.col("query_id") >= len(names)).cast("int"),
    })
    f = cut(f.groupBy("split", *columns, "y").agg(F.count("*").cast("double").alias("n_rows")))
    model = scorer.fit(f.where("split = 'train'"), columns, hidden, SEED)
    return rounded(metrics.auroc(scorer.scored(model, f.where("split <> 'train'")), ["split"]))


@query()
def fitted_logistic(spark, d):
    return _fitted(spark, d)


@query()
def fitted_perceptron(spark, d):
    return _fitted(spark, d, (16, 16))


def _day_split(spark, d, hidden=()):
    """A scorer fitted on the test days up to the median one and held against the later ones, over all their pairs and
    those that the first part does not have. Each positive has a drawn negative with the same source and day."""
    e = edges(spark, d, "party")
    t = e.where("split = 'test'").select("event_idx", "src", "dst", "day")
    neg = sampling.uniform_targets(e, n_nodes(e), SEED, asked=t)
    pairs = labelled(t, neg.select("event_idx", "src", F.col("neg_dst").alias("dst"), "day")).withColumn("query_id", F.col("event_idx") * 2 + F.col("y"))
    middle = t.select("day").distinct().agg(F.expr("percentile(day, 0.5)").alias("m"))
    pairs = cut(pairs.crossJoin(F.broadcast(middle)).withColumn("early", F.col("day") <= F.col("m")).drop("m"))
    known = pairs.where("early AND y = 1").select("src", "dst", F.lit(True).alias("known")).distinct()
    columns = ["dst_freq", "dst_freq30", "dst_recency", "pair_freq", "src_freq"]
    asked = pairs.select("query_id", F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    f = cut(feat.features(plain(e), asked, tuple(columns)).join(pairs.join(known, ["src", "dst"], "left").select("query_id", "early", "known", "y"), "query_id"))
    late = cut(scorer.scored(scorer.fit(f.where("early"), columns, hidden, SEED), f.where("NOT early")))
    every, novel = late.withColumn("stratum", F.lit("all")), late.where("known IS NULL").withColumn("stratum", F.lit("novel"))
    return rounded(metrics.auroc(every.unionByName(novel), ["stratum"]))


@query()
def day_split_logistic(spark, d):
    return _day_split(spark, d)


@query()
def day_split_network(spark, d):
    return _day_split(spark, d, (64, 64))


# Graph networks with weights drawn from a seed; tested against a walk node by node

NET = graphnet.Shape(dim=8, edge=3, heads=2, layers=2, stack=1, k=10, k_inner=5, head="bilinear", memory=True)
PLAIN_NET = graphnet.Shape(dim=8, edge=3, heads=2, layers=2, k=5, memory=False)


def _net_edges(spark, d):
    e = edges(spark, d, "activity", amounts=True)
    amounts = F.log1p(F.greatest(F.col("usd_sum").cast("double"), F.lit(0.0)))
    return e.select("event_idx", "src", "dst", "day", "split", F.array(amounts, F.log1p(F.col("txn").cast("double"))).alias("feat"))


def _net_days(e):
    """Every node on every day with a test edge."""
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    return with_all(e.where("split = 'test'").select("day").distinct(), nodes, "node")


@query()
def memory_states(spark, d):
    """The state of each node after each of its days."""
    e = _net_edges(spark, d)
    return graphnet.memory_log(e, graphnet.random_weights(NET, SEED), NET).select("node", "clock", F.transform("h", lambda x: F.round(x, 6)).alias("h"))


@query()
def node_embeddings(spark, d):
    """All nodes on all test days, by attention over two hops and memory."""
    e, w = _net_edges(spark, d), graphnet.random_weights(NET, SEED)
    z = graphnet.embeddings(asof.incidence(e, ("feat",)), _net_days(e), w, NET, graphnet.memory_log(e, w, NET))
    return z.select("node", "day", F.transform("h", lambda x: F.round(x, 6)).alias("h"))


def _net_ranks(spark, d, shape):
    e, w = _net_edges(spark, d), graphnet.random_weights(shape, SEED)
    t = e.where("split = 'test'").select("event_idx", "src", "dst", "day")
    log = graphnet.memory_log(e, w, shape) if shape.memory else None
    z = graphnet.embeddings(asof.incidence(e, ("feat",)), _net_days(e), w, shape, log)
    return graphnet.block_ranks(t, z, w, shape)


@query()
def memory_net_ranking(spark, d):
    return _net_ranks(spark, d, NET)


@query()
def attention_net_ranking(spark, d):
    return _net_ranks(spark, d, PLAIN_NET)


SMALL_NET = graphnet.Shape(dim=8, edge=3, heads=2, layers=1, k=10, memory=False)


@query()
def trained_network(spark, d):
    """Two epochs of training over all training edges: losses, and the validation span by its own negatives; epoch -1 is
    the network before them. Tested against numerical gradients and a single process."""
    e, nodes = _net_edges(spark, d), n_nodes(edges(spark, d, "activity"))
    plan = training.Plan(epochs=2, step=2000, rate=0.01, seed=SEED)
    history = training.train(e, nodes, SMALL_NET, plan, start=True).history
    names = ["train_loss", "train_ap", "train_auroc", "val_ap", "val_auroc"]
    rows = [(h["epoch"], *[h[c] for c in names]) for h in history]
    return rounded(spark.createDataFrame(rows, "epoch int, " + ", ".join(f"{c} double" for c in names)), 4)


def _ticks(spark, d, tasks=1):
    """A folder with the edges and the test queries as files, one a day; days before the first query are ``tasks`` files."""
    e = edges(spark, d, "activity")
    root = cut_folder(spark)
    days = [x.day for x in e.select("day").distinct().orderBy("day").collect()]  # the calendar
    rows = e.select(F.col("event_idx").alias("query_id"), F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    rows = rows.withColumn("is_query", F.lit(False)).unionByName(rows.join(e.where("split = 'test'").select(F.col("event_idx").alias("query_id")), "query_id").withColumn("is_query", F.lit(True)))
    rows = cut(rows)
    first = e.where("split = 'test'").agg(F.min("day")).first()[0]
    rows.where(F.col("day") < first).repartition(tasks).write.parquet(f"{root}/in")
    for x in days:
        if x >= first:
            rows.where(F.col("day") == x).coalesce(1).write.mode("append").parquet(f"{root}/in")
    drop(rows)
    return root


def _stream_sql(columns):
    return f"WITH {edges_sql('activity')}, {_RAW} SELECT query_id, {', '.join(f'{_COLUMN_SQL[c]} AS {c}' for c in columns)} {_FROM}"


@query("SELECT strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY dt HAVING max(ts)::DATE + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)")
def streaming_daily(spark, d):
    """Events of each day, as a stream gives them once its watermark, a day behind, has passed the day."""
    root = cut_folder(spark)
    rows = table(spark, d, "events").select("ts")
    rows.write.parquet(f"{root}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in").select(F.col("ts").cast("timestamp").alias("ts"))
    sink = replay.daily_counts(stream).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("dt date, n long").parquet(f"{root}/out").select(F.col("dt").cast("string").alias("dt"), "n")


@query(_stream_sql(feat.BASE4))
def streaming_replay(spark, d):
    """The test queries answered by the stream, a file a day, from what came before."""
    root = _ticks(spark, d)
    r = replay.Replay(spark, root)
    r.start(f"{root}/in").awaitTermination()
    return rounded(r.answers())


@query(_stream_sql(feat.WIDE23))
def streaming_keyed(spark, d):
    """The test queries answered from keyed state, a file a day; all 23 features, no history read. The days before the first
    query come in any order, as events count whenever they come."""
    root = _ticks(spark, d, 4)
    keyed.start(spark.readStream.schema(replay.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root, feat.WIDE23).awaitTermination()
    return rounded(keyed.answers(spark.read.schema(keyed.PART).parquet(f"{root}/parts"), feat.WIDE23).drop("late"))
