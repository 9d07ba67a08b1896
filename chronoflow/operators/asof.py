"""Strictly-past lookups. The one module in which event time meets query time.

Events and queries are stacked and a window with the frame ``(unbounded, -1)`` over an integer clock (day, or batch)
gives each query what happened before its tick. Only events count; queries never enter state.

A key that may be a hub (a node) is first added up by day, partly before the shuffle, and asked once a day: its window has
as many rows as the calendar has days, however many events it has, and queries join what their (key, day) was told.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from chronoflow.sources.shared import cut, grown


def past(*keys: str, clock: str = "day", back: int | None = None):
    """The window of strictly earlier ticks of a key, all of them or the last ``back``."""
    return W.partitionBy(*keys).orderBy(clock).rangeBetween(W.unboundedPreceding if back is None else -back, -1)


def stacked(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Events (s, d, day) and queries (query_id, s, d, day) in one table; ``ev`` is 1 for events."""
    e = events.select("s", "d", "day", F.lit(None).cast("long").alias("query_id"), F.lit(1).alias("ev"))
    return e.unionByName(queries.select("s", "d", "day", "query_id", F.lit(0).alias("ev")))


def told(daily: DataFrame, asks: DataFrame, keys: list[str], **made: Column) -> DataFrame:
    """``keys``, day and the columns ``made`` (over ``past(*keys)``) for each distinct key and day of ``asks``, from a table
    with a row for each key and day."""
    ask = asks.select(*keys, "day").distinct().withColumn("_ask", F.lit(True))
    rows = daily.unionByName(ask, allowMissingColumns=True)
    return grown(rows.withColumns(made).where("_ask").select(*keys, "day", *made))


def when_event(c: Column) -> Column:
    return F.when(F.col("ev") == 1, c)


def intervals(events: DataFrame, clock: str = "day") -> DataFrame:
    """For every event of a pair, until when it is the pair's last: (s, d, clock, until), until inclusive."""
    nxt = F.lead(clock).over(W.partitionBy("s", "d").orderBy(clock))
    return events.select("s", "d", clock).distinct().select("s", "d", F.col(clock).alias("last"), nxt.alias("until"))


def last_before(events: DataFrame, queries: DataFrame, clock: str = "day") -> DataFrame:
    """query_id and the pair's last tick before the query's (null if none)."""
    rows = events.select("s", "d", clock, F.lit(None).cast("long").alias("query_id"), F.lit(1).alias("ev"))
    rows = rows.unionByName(queries.select("s", "d", clock, "query_id", F.lit(0).alias("ev")))
    rows = rows.withColumn("last", F.max(when_event(F.col(clock))).over(past("s", "d", clock=clock)))
    return rows.where("ev = 0").select("query_id", "last")


BLOCK = 4096  # edges that are numbered together
HUB = 1_000_000  # incidences of a node from which on its window is cut


def incidence(edges: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each edge from both its ends, numbered (rn, from 1) by node in the order of time: node, other, day, dir, rn, and
    the columns ``keep`` of the edge. A self-loop gives two rows. The numbers of a node with more than ``HUB`` rows are
    those of its days before, of the day's blocks of ``BLOCK`` edges before, and within the block, so no window has all of
    its rows."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(0).alias("dir")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(1).alias("dir"))))
    rows = edges.select("event_idx", "day", *keep, ends.alias("x")).select("x.*", "day", "event_idx", *keep)
    hubs = F.broadcast(cut(rows.groupBy("node").agg(F.count("*").alias("_n")).where(F.col("_n") > HUB).select("node")))
    plain = F.row_number().over(W.partitionBy("node").orderBy("day", "event_idx", "dir"))
    if hubs.isEmpty():
        return rows.withColumn("rn", plain)
    light = rows.join(hubs, "node", "left_anti").withColumn("rn", plain)
    return light.unionByName(_numbered_by_blocks(rows.join(hubs, "node", "left_semi")))


def _numbered_by_blocks(rows: DataFrame) -> DataFrame:
    rows = rows.withColumn("_b", F.floor(F.col("event_idx") / BLOCK))
    blocks = rows.groupBy("node", "day", "_b").agg(F.count("*").alias("_n"))
    ahead = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    days = blocks.groupBy("node", "day").agg(F.sum("_n").alias("_n"))
    days = days.select("node", "day", ahead(W.partitionBy("node").orderBy("day")).alias("_d"))
    blocks = blocks.withColumn("_w", ahead(W.partitionBy("node", "day").orderBy("_b"))).join(days, ["node", "day"]).select("node", "day", "_b", (F.col("_d") + F.col("_w")).alias("_a"))
    within = F.row_number().over(W.partitionBy("node", "day", "_b").orderBy("event_idx", "dir"))
    return rows.withColumn("_r", within).join(blocks, ["node", "day", "_b"]).withColumn("rn", F.col("_a") + F.col("_r")).drop("_b", "_r", "_a")


def _cuts(inc: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node, day and cut, the number of the node's incidences before that day."""
    daily = inc.groupBy("node", "day").agg(F.count("*").alias("n"))
    cuts = told(daily, queries, ["node"], cut=F.coalesce(F.sum("n").over(past("node")), F.lit(0)))
    return queries.select("query_id", "node", "day").join(cuts, ["node", "day"]).select("query_id", "node", "day", "cut")


def recent_neighbors(inc: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The last k incidences before each query (query_id, node, day): query_id, pos (1 is the latest), other, dt, dir.
    Places are computed and joined by equality, so the join is no range join."""
    at = _cuts(inc, queries).where("cut > 0").withColumn("rn", F.explode(F.sequence(F.greatest(F.lit(1), F.col("cut") - k + 1), F.col("cut"))))
    return _taken(at, inc)


def spread_neighbors(inc: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Half of the k from the latest, the other half evenly spaced over the older ones."""
    recent, old = (k + 1) // 2, k // 2
    latest = F.sequence(F.col("cut") - recent + 1, F.col("cut"))
    older = F.transform(F.sequence(F.lit(0), F.lit(old - 1)), lambda j: F.lit(1) + F.floor(j * (F.col("cut") - recent) / old))
    places = F.when(F.col("cut") <= k, F.sequence(F.lit(1).cast("long"), F.col("cut"))).otherwise(F.concat(older, latest))
    return _taken(_cuts(inc, queries).where("cut > 0").withColumn("rn", F.explode(places)), inc)


def _taken(at: DataFrame, inc: DataFrame) -> DataFrame:
    kept = [c for c in inc.columns if c not in ("node", "rn", "other", "day", "dir", "event_idx")]
    side = inc.select("node", F.col("rn").cast("long").alias("rn"), "other", F.col("day").alias("eday"), "dir", *kept)
    rows = at.withColumn("rn", F.col("rn").cast("long")).join(grown(side), ["node", "rn"])
    return rows.select("query_id", (F.col("cut") - F.col("rn") + 1).alias("pos"), "other", (F.col("day") - F.col("eday")).alias("dt"), "dir", "eday", *kept)


def hops(inc: DataFrame, queries: DataFrame, k: int, depth: int) -> DataFrame:
    """The neighbours of neighbours: at each hop the distinct (node, day of its edge) are asked in turn. Rows: hop, node,
    day."""
    frontier = queries.select("node", "day").distinct()
    found = frontier.select(F.lit(0).alias("hop"), "node", "day")
    for hop in range(1, depth + 1):
        asked = frontier.withColumn("query_id", F.xxhash64("node", "day"))
        frontier = recent_neighbors(inc, asked, k).select(F.col("other").alias("node"), F.col("eday").alias("day")).distinct()
        found = found.unionByName(frontier.select(F.lit(hop).alias("hop"), "node", "day"))
    return found
