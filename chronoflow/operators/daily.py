"""Raw transfers to a numbered table of daily edges.

One row for each (source, target, day); numbered by day, source and target; cut into train, validation and test at
day borders. Rows without a source, target or time are dropped; an amount that is no number counts as a transfer of
no amount.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.functions.vectors import ln1
from chronoflow.sources.shared import cut

FLOW = "source_eoa string, target_eoa string, block_timestamp timestamp_ntz, asset string, amount_human string"


def daily_edges(flow: DataFrame, assets: tuple[str, ...], amounts: bool = True) -> DataFrame:
    """s, d, day (since the first), amt_0.. by asset, usd_sum, txn: one shuffle, as the assets are a fixed list. Without
    ``amounts`` s, d and day alone."""
    f = flow.where(F.col("block_timestamp").isNotNull() & F.col("source_eoa").isNotNull() & F.col("target_eoa").isNotNull() & F.col("asset").isin(*assets))
    f = f.select(F.col("source_eoa").alias("s"), F.col("target_eoa").alias("d"), F.to_date("block_timestamp").alias("dt"), "asset", F.col("amount_human").try_cast("double").alias("amt"))
    if not amounts:
        g = cut(f.select("s", "d", "dt").distinct())
        return g.crossJoin(F.broadcast(g.agg(F.min("dt").alias("first")))).select("s", "d", F.datediff("dt", "first").alias("day"))
    sums = [F.coalesce(F.sum(F.when(F.col("asset") == a, F.col("amt"))), F.lit(0.0)).alias(f"amt_{k}") for k, a in enumerate(assets)]
    g = cut(f.groupBy("s", "d", "dt").agg(*sums, F.count("*").alias("txn")))  # read twice
    first = F.broadcast(g.agg(F.min("dt").alias("first")))  # one row
    total = sum((F.col(f"amt_{k}") for k in range(1, len(assets))), F.col("amt_0"))
    return g.crossJoin(first).select("s", "d", F.datediff("dt", "first").alias("day"), *[f"amt_{k}" for k in range(len(assets))], total.alias("usd_sum"), "txn")


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the rank (from 0) of distinct strings without a global sort: rows are dealt by ranges whose bounds Spark takes
    from a sample of the strings, so that ranges are even whatever the strings start with, and numbered within; only the
    table of ranges is ordered in one task. Written, as another run may take other bounds."""
    ids = cut(rows.repartitionByRange(column).sortWithinPartitions(column).withColumn("_n", F.monotonically_increasing_id()))
    part = F.shiftright("_n", 33).alias("_p")
    heads = ids.groupBy(part).agg(F.count("*").alias("_c"))
    heads = heads.select("_p", (F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).alias("_before"))
    return ids.withColumn("_p", part).join(F.broadcast(heads), "_p").withColumn(name, F.col("_before") + F.col("_n").bitwiseAND((1 << 33) - 1)).drop("_p", "_n", "_before")


def node_dim(edges: DataFrame) -> DataFrame:
    """addr and node_id, its rank among all endpoints."""
    return numbered(edges.select(F.col("s").alias("addr")).union(edges.select("d")).distinct(), "addr", "node_id")


def day_offsets(edges: DataFrame) -> DataFrame:
    """day, n and lo, the number of edges before it. As small as the calendar."""
    return edges.groupBy("day").agg(F.count("*").alias("n")).withColumn("lo", F.sum("n").over(W.orderBy("day")) - F.col("n"))


def split_days(edges: DataFrame, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """One row: the first days of validation and test, and where they start. A border is the start of the day that
    holds the edge at that fraction."""
    days = day_offsets(edges)
    n = F.sum("n").over(W.partitionBy())
    days = days.select("day", "lo", F.floor(n * F.lit(train)).alias("a"), F.floor(n * F.lit(train + val)).alias("b"))
    last = lambda k: F.max(F.when(F.col("lo") <= F.col(k), F.struct("day", "lo")))
    return days.agg(last("a").alias("a"), last("b").alias("b")).select(F.col("a.day").alias("val_day"), F.col("b.day").alias("test_day"), F.col("a.lo").alias("train_end"), F.col("b.lo").alias("val_end"))


def numbered_edges(edges: DataFrame, names: bool = True) -> DataFrame:
    """The edges with event_idx (order of day, s, d), src, dst and split; s and d themselves only with ``names``. Nodes are
    numbered in the order of their names, so edges are ordered by numbers: days by their offsets and edges within a day, so
    no task sorts everything. A task holds its share of the nodes, each once, and sorts no edges to find them."""
    nodes = node_dim(edges).hint("shuffle_hash")
    e = edges.join(nodes.select(F.col("addr").alias("s"), F.col("node_id").alias("src")), "s").join(nodes.select(F.col("addr").alias("d"), F.col("node_id").alias("dst")), "d")
    within = F.row_number().over(W.partitionBy("day").orderBy("src", "dst")) - 1
    e = (e if names else e.drop("s", "d")).withColumn("_w", within).join(F.broadcast(day_offsets(edges).select("day", "lo")), "day")
    part = F.when(F.col("day") < F.col("val_day"), "train").when(F.col("day") < F.col("test_day"), "val").otherwise("test")
    return e.crossJoin(F.broadcast(split_days(edges))).withColumn("event_idx", (F.col("lo") + F.col("_w")).cast("long")).withColumn("split", part).drop("_w", "lo", "val_day", "test_day", "train_end", "val_end")


def amount_stats(edges: DataFrame) -> DataFrame:
    """One row: mean and population deviation of log10(usd_sum) on train. Edges without a positive sum have no log."""
    return edges.where("split = 'train' AND usd_sum > 0").agg(F.avg(F.log10("usd_sum")).alias("amt_mean"), F.stddev_pop(F.log10("usd_sum")).alias("amt_std"))


def edge_features(edges: DataFrame, assets: int) -> DataFrame:
    """event_idx, z-scored log amount, ln(1 + transfers) and the share of each asset."""
    z = (F.log10(F.when(F.col("usd_sum") > 0, F.col("usd_sum"))) - F.col("amt_mean")) / F.col("amt_std")
    shares = [F.coalesce(F.try_divide(f"amt_{k}", "usd_sum"), F.lit(0.0)).alias(f"share_{k}") for k in range(assets)]
    return edges.crossJoin(F.broadcast(amount_stats(edges))).select("event_idx", z.alias("z_log_usd"), ln1(F.col("txn")).alias("ln_txn"), *shares)


def graph_meta(edges: DataFrame) -> DataFrame:
    """One row with the sizes of the graph, its split and the amount statistics."""
    ends = edges.select(F.col("src").alias("x")).union(edges.select("dst"))
    sizes = ends.agg(F.countDistinct("x").alias("n_nodes")).crossJoin(edges.agg((F.max("day") + 1).alias("n_days")))
    return sizes.crossJoin(split_days(edges).select("train_end", "val_end")).crossJoin(amount_stats(edges))
