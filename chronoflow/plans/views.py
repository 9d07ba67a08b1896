"""The driver tables as streams of transfers.

``party``: customer to supplier, mostly new pairs; ``nation``: the same between nations, every pair recurs;
``activity``: user to kind of event. Return flag and line status together stand for the asset; two of the six are no
traded asset and are filtered by the aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from chronoflow.operators import daily
from chronoflow.sources.shared import cut, grown

ASSETS = ("AF", "AO", "NF", "NO")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate", F.concat("l_returnflag", "l_linestatus").alias("asset"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amt"))
    return line.join(grown(_orders(spark, sf_dir)), F.col("l_orderkey") == F.col("o_orderkey"))


def _flow(rows: DataFrame, source, target, ts, asset, amount) -> DataFrame:
    return rows.select(source.alias("source_eoa"), target.alias("target_eoa"), ts.alias("block_timestamp"), asset.alias("asset"), amount.cast("string").alias("amount_human"))


def party(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lines(spark, sf_dir)
    return _flow(r, F.concat(F.lit("c"), "o_custkey"), F.concat(F.lit("s"), "l_suppkey"), F.col("l_shipdate"), F.col("asset"), F.col("amt"))


def nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _lines(spark, sf_dir).join(grown(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")), F.col("o_custkey") == F.col("c_custkey"))
    r = r.join(grown(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")), F.col("l_suppkey") == F.col("s_suppkey"))
    return _flow(r, F.concat(F.lit("n"), "c_nationkey"), F.concat(F.lit("n"), "s_nationkey"), F.col("l_shipdate"), F.col("asset"), F.col("amt"))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return _flow(e, F.concat(F.lit("u"), "user_id"), F.concat(F.lit("e"), "event_type"), F.col("ts"), F.lit(ASSETS[0]), F.col("value"))


VIEWS = {"party": party, "nation": nation, "activity": activity}


def edges(spark: SparkSession, sf_dir: str, view: str, amounts: bool = False, names: bool = False) -> DataFrame:
    """The numbered daily edges of a view, as a table: queries use them several times. Only with ``amounts`` do they carry
    sums by asset, usd_sum and txn, and only with ``names`` s and d, which are more bytes than all else; the rows are the
    same."""
    return grown(cut(daily.numbered_edges(grown(daily.daily_edges(VIEWS[view](spark, sf_dir), ASSETS, amounts)), names)))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single transfers in the form of the sampler: from_address, to_address, block_timestamp, transaction_hash,
    value_lossless (a string), value_eth."""
    r = _lines(spark, sf_dir)
    wei = F.concat(F.round(F.col("amt") * 100).cast("long").cast("string"), F.lit("0" * 16))
    return r.select(F.concat(F.lit("c"), "o_custkey").alias("from_address"), F.concat(F.lit("s"), "l_suppkey").alias("to_address"), F.col("l_shipdate").alias("block_timestamp"), F.concat_ws("-", F.lit("0x"), "l_orderkey", "l_linenumber").alias("transaction_hash"), wei.alias("value_lossless"), (wei.cast("double") / F.lit(1e18)).alias("value_eth"))


# The same views in SQL, for comparison.
_PARTY = """SELECT 'c' || o_custkey AS s, 's' || l_suppkey AS d, CAST(l_shipdate AS DATE) AS dt, l_returnflag || l_linestatus AS asset, l_extendedprice * (1 - l_discount) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
_NATION = """SELECT 'n' || c_nationkey AS s, 'n' || s_nationkey AS d, CAST(l_shipdate AS DATE) AS dt, l_returnflag || l_linestatus AS asset, l_extendedprice * (1 - l_discount) AS amt
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey"""
_ACTIVITY = "SELECT 'u' || user_id AS s, 'e' || event_type AS d, CAST(ts AS DATE) AS dt, 'AF' AS asset, value AS amt FROM events"
FLOW_SQL = {"party": _PARTY, "nation": _NATION, "activity": _ACTIVITY}


def edges_sql(view: str) -> str:
    """Common table expressions: ev, nodes, e (the numbered daily edges) and meta (one row)."""
    sums = ", ".join(f"coalesce(sum(amt) FILTER (asset = '{a}'), 0.0) AS amt_{k}" for k, a in enumerate(ASSETS))
    return f"""ev AS MATERIALIZED (SELECT * FROM ({FLOW_SQL[view]}) WHERE asset IN {ASSETS} AND dt IS NOT NULL),
g AS MATERIALIZED (SELECT s, d, (dt - (SELECT min(dt) FROM ev))::INTEGER AS day, {sums}, count(*) AS txn FROM ev GROUP BY s, d, dt),
nodes AS MATERIALIZED (SELECT addr, row_number() OVER (ORDER BY addr) - 1 AS node_id FROM (SELECT s AS addr FROM g UNION SELECT d FROM g)),
o AS MATERIALIZED (SELECT g.*, amt_0 + amt_1 + amt_2 + amt_3 AS usd_sum, row_number() OVER (ORDER BY day, s, d) - 1 AS event_idx, count(*) OVER () AS total FROM g),
cut AS MATERIALIZED (SELECT max(CASE WHEN event_idx = floor(total * 0.7)::BIGINT THEN day END) AS val_day, max(CASE WHEN event_idx = floor(total * (0.7 + 0.15))::BIGINT THEN day END) AS test_day FROM o),
e AS MATERIALIZED (SELECT o.*, a.node_id AS src, b.node_id AS dst, CASE WHEN day < val_day THEN 'train' WHEN day < test_day THEN 'val' ELSE 'test' END AS split
  FROM o CROSS JOIN cut JOIN nodes a ON a.addr = s JOIN nodes b ON b.addr = d),
y AS MATERIALIZED (SELECT avg(log10(usd_sum)) AS amt_mean, stddev_pop(log10(usd_sum)) AS amt_std FROM e WHERE split = 'train' AND usd_sum > 0),
meta AS MATERIALIZED (SELECT (SELECT count(*) FROM nodes) AS n_nodes, max(day) + 1 AS n_days, count(*) FILTER (split = 'train') AS train_end, count(*) FILTER (split <> 'test') AS val_end FROM e)"""
