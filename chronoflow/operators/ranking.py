"""Ranking of all nodes as the target of each test edge, in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.operators import metrics
from chronoflow.operators.asof import intervals
from chronoflow.operators.features import partner_ranks
from chronoflow.sources.shared import cut


def partner_rows(edges: DataFrame) -> DataFrame:
    """For each test edge a row for every past partner of its source: event_idx, src, dst, day, partner, last, and other,
    whether the source has that partner as another target on the day. Edges without partners have one row with nulls."""
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    met = intervals(e).withColumnRenamed("d", "partner")
    q = edges.where("split = 'test'").select("event_idx", "src", "dst", "day")
    j = q.join(met, (q["src"] == met["s"]) & (met["last"] < q["day"]) & (met["until"].isNull() | (q["day"] <= met["until"])), "left").drop("s", "until")
    same = edges.select("src", F.col("dst").alias("partner"), "day", F.lit(True).alias("other"))
    j = j.join(same, ["src", "partner", "day"], "left")
    return j.withColumn("other", F.coalesce("other", F.lit(False)) & (F.col("partner") != F.col("dst")))


def recency_ranks(edges: DataFrame, n_nodes: DataFrame) -> DataFrame:
    """event_idx, rank of the target by recency (ties share the mean rank, other targets of the source that day are left
    out) and seen, whether the pair occurred before the test span. Partners are counted, not listed; the other targets of
    the day are edges of the same source and day, whose last days are ranked among themselves."""
    q = edges.where("split = 'test'").select(F.col("event_idx").alias("query_id"), F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    e = edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    g = partner_ranks(e, q).join(q, "query_id")
    mine, never = F.col("mine"), F.lit(-(1 << 30))
    # Of each source and day the edges by last day: as many rows as the calendar has days.
    g = g.withColumn("_m", F.coalesce("mine", never))
    same = W.partitionBy("s", "day")
    by = g.groupBy("s", "day", "_m").agg(F.count("*").alias("_n")).withColumns({
        "_all": F.sum("_n").over(same),
        "_met": F.sum(F.when(F.col("_m") > never, F.col("_n")).otherwise(0)).over(same),
        "later_others": F.coalesce(F.sum("_n").over(same.orderBy(F.desc("_m")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    })
    g = g.join(by, ["s", "day", "_m"]).crossJoin(F.broadcast(n_nodes.select("n_nodes")))
    g = g.withColumns({"others": F.col("_all") - 1, "known": F.col("_met") - F.when(mine.isNotNull(), 1).otherwise(0), "equal_others": F.col("_n") - 1})
    kept = F.col("partners") - F.col("known")
    unseen = 1 + kept + 0.5 * (F.col("n_nodes") - 1 - F.col("others") - kept)
    rank = F.when(mine.isNotNull(), 1 + F.col("later") - F.col("later_others") + 0.5 * (F.col("equal") - 1 - F.col("equal_others"))).otherwise(unseen)
    old = edges.where("split <> 'test'").select(F.col("src").alias("s"), F.col("dst").alias("d"), F.lit(True).alias("seen")).distinct()
    return g.select(F.col("query_id").alias("event_idx"), "s", "d", rank.cast("double").alias("rank")).join(old, ["s", "d"], "left").select("event_idx", "rank", F.coalesce("seen", F.lit(False)).alias("seen"))


def filtered_ranks(scores: DataFrame) -> DataFrame:
    """event_idx and 1 + better + half the tied of the target, from (event_idx, score, is_target, left_out)."""
    target = scores.where("is_target").select("event_idx", F.col("score").alias("_t"))
    r = scores.where("NOT left_out AND NOT is_target").join(target, "event_idx", "right")
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return r.groupBy("event_idx").agg((1 + count(F.col("score") > F.col("_t")) + 0.5 * count(F.col("score") == F.col("_t"))).alias("rank"))


def lexicographic_ranks(scores: DataFrame) -> DataFrame:
    """The same with last (null: never) as the first key and score as the second."""
    never = F.lit(-(1 << 60))
    s = scores.withColumn("_k", F.struct(F.coalesce(F.col("last").cast("long"), never).alias("a"), F.col("score").alias("b")))
    target = s.where("is_target").select("event_idx", F.col("_k").alias("_t"))
    r = s.where("NOT left_out AND NOT is_target").join(target, "event_idx", "right")
    count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    return r.groupBy("event_idx").agg((1 + count(F.col("_k") > F.col("_t")) + 0.5 * count(F.col("_k") == F.col("_t"))).alias("rank"))


def partner_strata(edges: DataFrame) -> DataFrame:
    """Test edges by whether the target is a past partner: how many, how often it is the latest one, median number of
    partners and median recency place (1 is the latest)."""
    q = edges.where("split = 'test'").select(F.col("event_idx").alias("query_id"), F.col("src").alias("s"), F.col("dst").alias("d"), "day")
    g = partner_ranks(edges.select(F.col("src").alias("s"), F.col("dst").alias("d"), "day"), q)
    g = cut(g.select(F.col("mine").isNotNull().alias("is_partner"), "partners", (1 + F.col("later")).alias("place")))
    counts = g.groupBy("is_partner").agg(F.count("*").alias("n"), F.sum(F.when(F.col("place") == 1, 1).otherwise(0)).alias("latest"))
    middle = lambda c: F.when(F.col("is_partner"), F.lit(metrics.exact_median(g.where("is_partner"), c))).otherwise(F.lit(metrics.exact_median(g.where("NOT is_partner"), c))).cast("double")
    return counts.select("is_partner", "n", "latest", middle("partners").alias("median_partners"), middle("place").alias("median_place"))


def outrankers(scores: DataFrame) -> DataFrame:
    """What stands above the targets that are past partners: events, and better candidates by kind, from (event_idx,
    score, is_target, left_out, last, globally_seen)."""
    t = scores.where("is_target AND last IS NOT NULL").select("event_idx", F.col("score").alias("_t"))
    r = scores.where("NOT left_out AND NOT is_target").join(t, "event_idx").where("score > _t")
    kind = F.when(F.col("last").isNotNull(), "partner").when(F.col("globally_seen"), "global_seen").otherwise("never_seen")
    return r.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
