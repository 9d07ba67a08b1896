"""Point-in-time features of a (source, candidate, day) query over daily edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.functions.vectors import ln1
from chronoflow.operators.asof import intervals, last_before, past, stacked, told, when_event
from chronoflow.sources.shared import cut, grown

BASE4 = ("pair_seen", "pair_recency", "dst_seen", "dst_recency")
BUCKETS = ("dt_1", "dt_2", "dt_7")
GLOBAL11 = (*BASE4, "src_seen", "src_recency", "src_freq", "dst_freq", "dst_freq30", "deg_s", "deg_c")
WIDE = ("pair_freq", "pair_age", "dst_freq7", "dst_freq90", "src_freq30", "out_deg_s", "in_deg_c", "rec_rank", "n_partners_s")
WIDE23 = (*GLOBAL11, *WIDE, *BUCKETS)


def _counted(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Raw counts and last days by pair, source and target."""
    r = stacked(events, queries)
    ev, day, pair = F.col("ev"), F.col("day"), past("s", "d")
    r = r.withColumns({"pair_last": F.max(when_event(day)).over(pair), "pair_first": F.min(when_event(day)).over(pair), "pair_n": F.coalesce(F.sum("ev").over(pair), F.lit(0))})
    first = events.groupBy("s", "d").agg(F.min("day").alias("day"))
    q = r.where(ev == 0).drop("ev")
    for key, name, degree, windows in (("s", "src", "out_deg", (30,)), ("d", "dst", "in_deg", (7, 30, 90))):
        daily = events.groupBy(key, "day").agg(F.count("*").alias("n")).join(grown(first.groupBy(key, "day").agg(F.count("*").alias("new"))), [key, "day"], "left")
        w = past(key)
        made = {f"{name}_last": F.max(F.when(F.col("n") > 0, day)).over(w), f"{name}_n": F.sum("n").over(w), degree: F.coalesce(F.sum("new").over(w), F.lit(0))}
        q = q.join(told(daily, queries, [key], **made, **{f"{name}_{back}": F.sum("n").over(past(key, back=back)) for back in windows}), [key, "day"])
    return q


def first_contacts(events: DataFrame) -> DataFrame:
    """node, day: for each node the first day with each undirected neighbour; a self-loop is one neighbour."""
    first = events.groupBy(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).agg(F.min("day").alias("day"))
    return first.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node"), "day")


def degrees(events: DataFrame, at: DataFrame) -> DataFrame:
    """query_id and deg, the number of undirected neighbours of (query_id, node, day) before that day."""
    daily = first_contacts(events).groupBy("node", "day").agg(F.count("*").alias("n"))
    deg = told(daily, at, ["node"], deg=F.coalesce(F.sum("n").over(past("node")), F.lit(0)))
    return at.select("query_id", "node", "day").join(deg, ["node", "day"]).select("query_id", "deg")


def partner_ranks(events: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id; partners of the source before the day; mine, the candidate's last day as one of them, and, where there is
    one, later and equal: how many partners were last met after it, and on it (the candidate too).

    No partner is listed. A partner last met on x and next on y is, for a query of day T, last met on x if x < T <= y, so
    those met after ``mine`` are the pairs' days between ``mine`` and T less the steps (x, y) with x > mine and y < T. Steps
    are counted by the blocks of 1, 2, 4 ... days that the days before T are made of: a step is a row for half of the
    block sizes, added up by (source, block, x), so no group has more rows than the calendar has days."""
    met = intervals(events)
    q = last_before(events, queries).withColumnRenamed("last", "mine").join(grown(queries.select("query_id", "s", "day")), "query_id")
    daily = met.groupBy("s", F.col("last").alias("day")).agg(F.count("*").alias("n"))
    first = events.groupBy("s", "d").agg(F.min("day").alias("day")).groupBy("s", "day").agg(F.count("*").alias("new"))
    sums = {c: F.coalesce(F.sum(x).over(past("s")), F.lit(0)) for c, x in (("upto", "n"), ("partners", "new"))}
    asks = q.select("s", "day").unionByName(q.where("mine IS NOT NULL").select("s", (F.col("mine") + 1).alias("day")))
    asked = told(daily.join(grown(first), ["s", "day"], "left"), asks, ["s"], **sums)
    q = q.join(asked, ["s", "day"]).join(asked.select("s", (F.col("day") - 1).alias("mine"), F.col("upto").alias("_to_mine")), ["s", "mine"], "left")
    steps = met.where("until IS NOT NULL").groupBy("s", F.col("last").alias("x"), F.col("until").alias("y")).agg(F.count("*").alias("n"))
    span = events.agg(F.min("day"), F.max("day")).first()  # two days of the calendar
    low, end = span if span[0] is not None else (0, 0)
    levels = range((end - low + 1).bit_length())
    block = lambda k, on, at: F.when(on, F.struct(F.lit(k).alias("k"), at.cast("long").alias("b")))
    bit = lambda c, k: F.shiftright(c, k) % 2 == 1
    blocks = lambda each: F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("at")
    y, t = (F.col("y") - low).cast("long"), F.least(F.col("day") - low, F.lit(end - low + 1)).cast("long")
    # The days before t are the blocks of its set bits, whose numbers are even: only such ones need a step's row.
    steps = steps.select("s", "x", "n", blocks([block(k, ~bit(y, k), F.shiftright(y, k)) for k in levels])).groupBy("s", "at", "x").agg(F.sum("n").alias("n"))
    q_blocks = q.where("mine IS NOT NULL").select("query_id", "s", F.col("mine").alias("x"), blocks([block(k, bit(t, k), F.shiftright(t, k) - 1) for k in levels]))
    rows = steps.unionByName(q_blocks.select("s", "at", "x").distinct().withColumn("ask", F.lit(True)), allowMissingColumns=True)
    over = W.partitionBy("s", "at").orderBy(-F.col("x")).rangeBetween(W.unboundedPreceding, -1)
    gone = rows.withColumn("gone", F.coalesce(F.sum("n").over(over), F.lit(0))).where("ask").select("s", "at", "x", "gone")
    gone = q_blocks.join(grown(gone), ["s", "at", "x"]).groupBy("query_id").agg(F.sum("gone").alias("gone"))
    # Those last met on ``mine``: its pairs, less the ones met again before the day.
    again = met.where("until IS NOT NULL").groupBy("s", F.col("last").alias("mine"), F.col("until").alias("day")).agg(F.count("*").alias("n"))
    again = told(again, q.where("mine IS NOT NULL").select("s", "mine", "day"), ["s", "mine"], left=F.coalesce(F.sum("n").over(past("s", "mine")), F.lit(0)))
    on_day = daily.select("s", F.col("day").alias("mine"), F.col("n").alias("_on"))
    q = q.join(again, ["s", "mine", "day"], "left").join(grown(on_day), ["s", "mine"], "left").join(grown(gone), "query_id", "left")
    later = F.when(F.col("mine").isNotNull(), F.col("upto") - F.col("_to_mine") - F.coalesce("gone", F.lit(0)))
    return q.select("query_id", "partners", "mine", later.alias("later"), F.when(F.col("mine").isNotNull(), F.col("_on") - F.col("left")).alias("equal"))


def features(events: DataFrame, queries: DataFrame, columns: tuple[str, ...] = WIDE23) -> DataFrame:
    """query_id and the named features of queries (query_id, s, d, day)."""
    r = _counted(events, queries)
    if {"deg_s", "deg_c"} & set(columns):
        for name, end in (("deg_s", "s"), ("deg_c", "d")):
            r = r.join(grown(degrees(events, queries.select("query_id", F.col(end).alias("node"), "day")).withColumnRenamed("deg", f"n_{name}")), "query_id")
    if "rec_rank" in columns:
        r = r.join(grown(partner_ranks(events, queries).select("query_id", "partners", "later")), "query_id")
    return shaped(r, columns)


def shaped(r: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """query_id and the named features from the raw counts and last days before each query's day."""
    day = F.col("day")
    flag = lambda c: F.when(F.col(c).isNotNull(), 1.0).otherwise(0.0)
    since = lambda c: F.coalesce(ln1(day - F.col(c)), F.lit(0.0))
    count = lambda c: ln1(F.coalesce(F.col(c), F.lit(0)))
    dt = day - F.col("pair_last")
    mark = lambda cond: F.when(F.col("pair_last").isNotNull() & cond, 1.0).otherwise(0.0)
    made = {
        "pair_seen": lambda: flag("pair_last"), "pair_recency": lambda: since("pair_last"), "dst_seen": lambda: flag("dst_last"), "dst_recency": lambda: since("dst_last"),
        "src_seen": lambda: flag("src_last"), "src_recency": lambda: since("src_last"), "src_freq": lambda: count("src_n"), "dst_freq": lambda: count("dst_n"),
        "dst_freq30": lambda: count("dst_30"), "deg_s": lambda: count("n_deg_s"), "deg_c": lambda: count("n_deg_c"), "pair_freq": lambda: count("pair_n"), "pair_age": lambda: since("pair_first"),
        "dst_freq7": lambda: count("dst_7"), "dst_freq90": lambda: count("dst_90"), "src_freq30": lambda: count("src_30"), "out_deg_s": lambda: count("out_deg"), "in_deg_c": lambda: count("in_deg"),
        "rec_rank": lambda: F.when(F.col("later").isNotNull(), ln1(F.col("later"))).otherwise(ln1(F.greatest(F.col("partners"), F.lit(1))) + 1.0),
        "n_partners_s": lambda: count("out_deg"), "dt_1": lambda: mark(dt <= 1), "dt_2": lambda: mark(dt == 2), "dt_7": lambda: mark(dt <= 7),
    }
    return r.select("query_id", *[made[c]().alias(c) for c in columns])


def cross_features(events: DataFrame, batch: DataFrame, columns: tuple[str, ...] = BASE4) -> DataFrame:
    """Features of all sources with all candidates within each batch of rows (batch, s, d, day): i, j and the features."""
    left = batch.select("batch", F.col("i"), "s", "day")
    pairs = left.join(batch.select("batch", F.col("i").alias("j"), "d"), "batch").withColumn("query_id", F.xxhash64("batch", "i", "j"))
    return pairs.select("query_id", "batch", "i", "j").join(features(events, pairs, columns), "query_id").drop("query_id")


LIGHT = 512  # rows of a node's neighbour list that one row may hold


def neighbour_pairs(events: DataFrame) -> DataFrame:
    """node, mid, days: for each node and undirected neighbour the days on which they met, in order."""
    both = F.explode(F.array(F.struct(F.col("s").alias("node"), F.col("d").alias("mid")), F.struct(F.col("d").alias("node"), F.col("s").alias("mid"))))
    return events.select(both.alias("x"), "day").select("x.*", "day").groupBy("node", "mid").agg(F.array_sort(F.collect_set("day")).alias("days"))


def common_pairs(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, s, d, day, mid: nodes that both ends of a query ever meet, from neighbour pairs. Two light ends (up to
    ``LIGHT`` neighbours) meet as lists, and only what they share is a row. Else the neighbours of the end that has fewer
    are looked up among the other's, by (node, neighbour); a heavy list is dealt in shares of ``LIGHT``, so neither side of
    a join has a hub's whole list under one key."""
    size = grown(cut(pairs.groupBy("node").agg(F.count("*").alias("n"))))
    end = lambda c: size.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    q = cut(queries.select("query_id", "s", "d", "day").join(end("s"), "s").join(end("d"), "d"))
    lists = pairs.join(size.where(F.col("n") <= LIGHT), "node", "left_semi").groupBy("node").agg(F.collect_list("mid").alias("mids"))
    lists = grown(lists)
    both = (F.col("n_s") <= LIGHT) & (F.col("n_d") <= LIGHT)
    light = q.where(both).join(lists.withColumnRenamed("mids", "a"), F.col("s") == F.col("node")).drop("node")
    light = light.join(lists.withColumnRenamed("mids", "b"), F.col("d") == F.col("node"))
    light = light.select("query_id", "s", "d", "day", F.explode(F.array_intersect("a", "b")).alias("mid"))
    fewer = F.col("n_s") <= F.col("n_d")
    h = q.where(~both).withColumns({"node": F.when(fewer, F.col("s")).otherwise(F.col("d")), "other": F.when(fewer, F.col("d")).otherwise(F.col("s")), "shares": F.ceil(F.least("n_s", "n_d") / LIGHT)})
    h = h.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
    dealt = pairs.join(size, "node").select("node", "mid", F.pmod(F.xxhash64("mid"), F.ceil(F.col("n") / LIGHT)).alias("share"))
    h = h.join(grown(dealt), ["node", "share"]).join(pairs.select(F.col("node").alias("other"), "mid"), ["other", "mid"])
    return light.unionByName(h.select("query_id", "s", "d", "day", "mid"))


def common_neighbors(events: DataFrame, queries: DataFrame, recent: int = 30) -> DataFrame:
    """query_id; how many undirected neighbours both ends had before the day (cn), how many of them both met within
    ``recent`` days (cn_recent), their Adamic-Adar sum (aa), and the directed two-hop paths (two_hop). Rows are the common
    neighbours, of which two-hop nodes are a part, not the queries' past events."""
    pairs = grown(cut(neighbour_pairs(events)))
    side = lambda c, name: pairs.select(F.col("node").alias(c), "mid", F.col("days").alias(name))
    last = lambda c: F.array_max(F.filter(c, lambda x: x < F.col("day")))
    a = common_pairs(pairs, queries).join(side("s", "_a"), ["s", "mid"]).join(side("d", "_b"), ["d", "mid"])
    a = a.withColumns({"pa": last("_a"), "pb": last("_b")}).where("pa IS NOT NULL AND pb IS NOT NULL").drop("_a", "_b")
    first = grown(events.groupBy("s", "d").agg(F.min("day").alias("first")))
    a = a.join(first.select("s", F.col("d").alias("mid"), F.col("first").alias("out")), ["s", "mid"], "left")
    a = a.join(first.select(F.col("s").alias("mid"), "d", F.col("first").alias("into")), ["mid", "d"], "left")
    daily = first_contacts(events).groupBy("node", "day").agg(F.count("*").alias("n"))
    deg = told(daily, a.select(F.col("mid").alias("node"), "day"), ["node"], deg=F.coalesce(F.sum("n").over(past("node")), F.lit(0)))
    a = a.join(deg.withColumnRenamed("node", "mid"), ["mid", "day"])
    near = (F.col("pa") >= F.col("day") - recent) & (F.col("pb") >= F.col("day") - recent)
    path = (F.col("out") < F.col("day")) & (F.col("into") < F.col("day"))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    a = a.groupBy("query_id").agg(F.count("*").alias("cn"), count(near).alias("cn_recent"), F.sum(F.when(F.col("deg") > 0, 1.0 / ln1(F.col("deg")))).alias("aa"), count(path).alias("paths"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    r = queries.select("query_id").join(grown(a), "query_id", "left")
    return r.select("query_id", zero("cn").alias("cn"), zero("cn_recent").alias("cn_recent"), F.coalesce("aa", F.lit(0.0)).alias("aa"), ln1(zero("paths")).alias("two_hop"))


def preferential_attachment(events: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id and ln(1 + deg s) + ln(1 + deg c)."""
    f = features(events, queries, ("deg_s", "deg_c"))
    return f.select("query_id", (F.col("deg_s") + F.col("deg_c")).alias("pref_attach"))


def day_context(events: DataFrame, alpha: float = 0.25) -> DataFrame:
    """For each active day: ln(1 + edges of the active day before), 0 on the first, and ln(1 + moving average of the
    counts before it), which starts at 0 and ticks once per active day. As small as the calendar, folded in one row."""
    days = events.groupBy("day").agg(F.count("*").alias("n"))
    last = lambda a, f, zero: F.coalesce(F.try_element_at(a, F.lit(-1))[f], F.lit(zero))

    def step(a, x):
        ema = (1 - alpha) * last(a, "ema", 0.0) + alpha * last(a, "n", 0)
        return F.concat(a, F.array(F.struct(x["day"].alias("day"), last(a, "n", 0).cast("long").alias("prev"), ema.alias("ema"), x["n"].alias("n"))))

    start = F.array().cast("array<struct<day:int,prev:bigint,ema:double,n:bigint>>")
    fold = F.aggregate(F.sort_array(F.collect_list(F.struct(F.col("day").cast("int").alias("day"), "n"))), start, step)
    x = days.agg(fold.alias("f")).select(F.explode("f").alias("x"))
    return x.select("x.day", ln1(F.col("x.prev")).alias("day_edges_prev"), ln1(F.col("x.ema")).alias("day_edges_ema"))
