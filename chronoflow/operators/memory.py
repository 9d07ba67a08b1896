"""Memorisation scorers: has the pair been seen before the clock's tick?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.operators.asof import last_before
from chronoflow.operators.metrics import exact_median
from chronoflow.sources.shared import cut


def edgebank(events: DataFrame, queries: DataFrame, clock: str = "day", window: DataFrame | None = None) -> DataFrame:
    """query_id and score: 1 if the pair occurred at an earlier tick of ``clock``. With ``window`` (one row, columns
    ``w`` and that of the event time ``day``) only if its last day is later than the query's day less w."""
    if window is None:
        last = last_before(events.select(F.col("src").alias("s"), F.col("dst").alias("d"), clock), queries.select("query_id", F.col("src").alias("s"), F.col("dst").alias("d"), clock), clock)
        return last.select("query_id", F.when(F.col("last").isNotNull(), 1.0).otherwise(0.0).alias("score"))
    # The last day seen at an earlier tick, where ticks need not be days.
    e = events.select("src", "dst", clock, F.col("day").alias("eday"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("int").alias("qday"))
    q = queries.select("src", "dst", clock, F.lit(None).cast("int").alias("eday"), "query_id", F.col("day").alias("qday"))
    over = W.partitionBy("src", "dst").orderBy(clock).rangeBetween(W.unboundedPreceding, -1)
    r = e.unionByName(q).withColumn("last", F.max("eday").over(over)).where("query_id IS NOT NULL").crossJoin(F.broadcast(window.select("w")))
    return r.select("query_id", F.when(F.col("last") > F.col("qday") - F.col("w"), 1.0).otherwise(0.0).alias("score"))


def span_days(edges: DataFrame, span: str = "test") -> DataFrame:
    """One row: w, how many days a span covers."""
    return edges.where(F.col("split") == span).agg((F.max("day") - F.min("day") + 1).alias("w"))


def amount_baselines(edges: DataFrame) -> DataFrame:
    """For test edges the log10 amount, the pair's last one before (the train median without one) and the median."""
    y = cut(edges.where("usd_sum > 0").select("event_idx", "src", "dst", "split", F.log10("usd_sum").alias("y")))
    median = F.lit(exact_median(y.where("split = 'train'"), "y")).cast("double")
    over = W.partitionBy("src", "dst").orderBy("event_idx").rowsBetween(W.unboundedPreceding, -1)
    y = y.withColumn("prior", F.last("y", ignorenulls=True).over(over)).where("split = 'test'").withColumn("median", median)
    return y.select("event_idx", "y", F.coalesce("prior", "median").alias("persistence"), "median", F.col("prior").isNotNull().alias("seen"))
