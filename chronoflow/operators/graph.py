"""Sampling and structure of transfer graphs."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.functions.hashing import hash_key
from chronoflow.sources.shared import cut, cut_folder, drop, grown


BUCKETS = 64


def adjacency(edges: DataFrame) -> DataFrame:
    """Each edge from both its ends, written in ``BUCKETS`` folders by a hash of the end: anchor, other, transaction_hash,
    block_timestamp, bucket. A reader that names buckets reads no others."""
    ends = F.explode(F.array(F.struct(F.col("from_address").alias("anchor"), F.col("to_address").alias("other")), F.struct(F.col("to_address").alias("anchor"), F.col("from_address").alias("other"))))
    rows = edges.select(ends.alias("x"), "transaction_hash", "block_timestamp").select("x.*", "transaction_hash", "block_timestamp").where("anchor IS NOT NULL AND other IS NOT NULL")
    path = cut_folder(edges.sparkSession, "adjacency")
    # Buckets are split by the other end, so that a hub's is no single file.
    rows.withColumn("bucket", bucket_of("anchor")).repartition("bucket", F.pmod(F.xxhash64("other"), F.lit(4))).write.partitionBy("bucket").parquet(path)
    return edges.sparkSession.read.schema(rows.schema.add("bucket", "integer")).parquet(path)


def bucket_of(column: str):
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def snowball(edges: DataFrame, seed: str, max_nodes: int = 100_000, per_node: int = 50, rng_seed: int = 0) -> DataFrame:
    """Addresses reached from ``seed`` hop by hop, at most ``per_node`` edges of each address of a hop's frontier (in
    hash order) and ``max_nodes`` in all (in hash order within the last hop): address, hop. Raises if the seed has no
    edges; warns if the graph ends first. edges: from_address, to_address, transaction_hash, block_timestamp."""
    spark = edges.sparkSession
    if edges.where((F.col("from_address") == seed) | (F.col("to_address") == seed)).isEmpty():
        raise ValueError(f"no edges touch {seed}")
    known = adjacency(edges)
    nodes = cut(spark.createDataFrame([(seed, 0)], "address string, hop int"))
    frontier, size, hop = nodes, 1, 0
    while size < max_nodes:
        hop += 1
        f = frontier.select(F.col("address").alias("anchor"))
        buckets = [r["b"] for r in f.select(bucket_of("anchor").alias("b")).distinct().collect()]  # at most ``BUCKETS``
        touching = known.where(F.col("bucket").isin(buckets)).join(f, "anchor").drop("bucket")
        order = hash_key(F.col("transaction_hash"), F.unix_timestamp(F.col("block_timestamp").cast("timestamp")), F.col("anchor"), F.col("other"), rng_seed)
        capped = touching.withColumn("rn", F.row_number().over(W.partitionBy("anchor").orderBy(order, "other"))).where(F.col("rn") <= per_node)
        new = capped.select(F.col("other").alias("address")).distinct().join(nodes, "address", "left_anti")
        new = cut(new.orderBy(hash_key(F.col("address"), rng_seed), "address").limit(max_nodes - size).withColumn("hop", F.lit(hop)))
        added = new.count()
        if not added:
            warnings.warn(f"the graph around {seed} is exhausted at {size} nodes", stacklevel=2)
            break
        old = (nodes, frontier)
        nodes, frontier, size = cut(nodes.unionByName(new)), new, size + added
        drop(*old)
    return nodes


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges between two of the nodes."""
    n = nodes.select("address")
    return edges.join(n, edges["from_address"] == n["address"], "left_semi").join(n, edges["to_address"] == n["address"], "left_semi")


def pick_seeds(edges: DataFrame, least: int = 50, most: int = 500, limit: int = 20) -> DataFrame:
    """Addresses with between ``least`` and ``most`` edges (both included), the first in hash order: address, n."""
    ends = edges.select(F.explode(F.array("from_address", "to_address")).alias("address")).where("address IS NOT NULL")
    n = ends.groupBy("address").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return n.orderBy(F.md5("address"), "address").limit(limit)


def degree(edges: DataFrame) -> DataFrame:
    """node and its number of edges at either end."""
    return edges.select(F.explode(F.array("s", "d")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node it is connected with. Each round sends a node to its smallest neighbour's
    smallest neighbour, one with a single neighbour to that one's smallest, and takes the edges along, until none joins two
    nodes. A round has only the nodes that edges still join; its moves are put together at the end, the last round first."""
    e, moves = cut(edges.select(F.col("s").alias("a"), F.col("d").alias("b"))), []
    while not e.isEmpty():
        other = F.when(F.col("a") != F.col("b"), F.col("b"))
        near = e.union(e.select("b", "a")).groupBy("a").agg(F.min(other).alias("lo"), F.max(other).alias("hi"))
        near = cut(near.select("a", F.least("lo", "a").alias("near"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.least("lo", "a")).alias("step")))
        hook = cut(near.select(F.col("a").alias("from"), "step").join(grown(near.select(F.col("a").alias("step"), F.col("near").alias("to"))), "step").select("from", "to"))
        moves.append(hook)
        a, b = hook.select(F.col("from").alias("a"), F.col("to").alias("x")), hook.select(F.col("from").alias("b"), F.col("to").alias("y"))
        old = (e, near)
        e = cut(e.where("a <> b").join(grown(a), "a").join(grown(b), "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct())
        drop(*old)
    drop(e)
    if not moves:
        return edges.select(F.col("s").alias("node"), F.col("s").alias("component"))
    labels = moves.pop()
    while moves:
        hook = moves.pop()
        then = labels.select(F.col("from").alias("to"), F.col("to").alias("last"))
        old = (labels, hook)
        labels = cut(hook.join(grown(then), "to", "left").select("from", F.coalesce("last", "to").alias("to")))
        drop(*old)
    return labels.select(F.col("from").alias("node"), F.col("to").alias("component"))


def coverage(events: DataFrame, unit: str = "day") -> DataFrame:
    """Events of each day (or other unit) from the first to the last, 0 where there are none: dt, n."""
    at = F.to_date("ts") if unit == "day" else F.date_trunc(unit, "ts")
    n = events.groupBy(at.alias("dt")).agg(F.count("*").alias("n"))
    ticks = n.agg(F.explode(F.sequence(F.min("dt"), F.max("dt"), F.expr(f"INTERVAL 1 {unit}"))).alias("dt"))
    return ticks.join(n, "dt", "left").select("dt", F.coalesce("n", F.lit(0)).alias("n"))


def scatter_mean(edges: DataFrame, columns: list[str]) -> DataFrame:
    """node, n and the mean of each column over the edges at the node, a self-loop twice: partial means meet in one
    shuffle."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node"), *columns)
    return ends.groupBy("node").agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in columns])
