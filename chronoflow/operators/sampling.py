"""Negative samples by hashed positions.

Every pool is a prefix or a tail of a list ordered by first appearance. A draw is a position in it, from the md5 of
seed, strategy, clock, slot and attempt; draws meet the list by equality, positives of the clock go by anti-join, and
what is left is taken in order of attempt and slot. Nothing sorts a pool per clock, and any engine with md5 draws the
same. A pool not larger than ``EXACT`` times the need, or ``WHOLE``, is taken whole, in hash order, so that padding means
an exhausted pool and not unlucky draws. Draws are bounded; a slot that they leave empty gets one exact draw among all
that is allowed to it, by its place in the order of the nodes. Only a slot to which nothing is allowed stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.functions.hashing import hash_int, hash_key, unit
from chronoflow.operators.daily import day_offsets
from chronoflow.sources.shared import cut, dealt, grown

ATTEMPTS = 8
DRAWS = 4
EXACT = 4
WHOLE = 256
BATCH = 200
STRATEGIES = ("historical", "inductive", "recurring")


def _attempts(rows: DataFrame, n: int = ATTEMPTS, start: int = 0) -> DataFrame:
    return rows.withColumn("attempt", F.explode(F.sequence(F.lit(start), F.lit(n - 1))))


def _in_rounds(slots: DataFrame, drawn, keys: tuple[str, ...], n: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """The first draw of each slot (distinct ``keys``) that is allowed, and the slots without one. ``drawn`` makes of slots
    with an attempt the rows of their draws, with ok, whether one is allowed; rows that are not may be repeated. Nearly all
    slots are filled by attempt 0, so the others are drawn for what that leaves alone."""
    first = cut(drawn(_attempts(slots, 1)))
    failed = first.where("NOT ok").select(*slots.columns).distinct()
    found = first.where("ok").drop("ok", "attempt")
    if failed.isEmpty():
        return found, failed
    failed = cut(failed)
    more = cut(_first(drawn(_attempts(failed, n, 1)).where("ok").drop("ok"), *keys))
    return found.unionByName(more.select(*found.columns)), failed.join(grown(more.select(*keys)), list(keys), "left_anti")


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """The row with the smallest attempt of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct("attempt", *[c for c in rest if c != "attempt"])).alias("m")).select(*keys, *[F.col(f"m.{c}").alias(c) for c in rest if c != "attempt"])


def nth_allowed(n: Column, left_out: Column) -> Column:
    """The n-th (from 0) whole number from 0 that is not among ``left_out``, distinct numbers from 0. The optimizer may
    ask this of rows that a filter is about to drop, so callers take n by ``try_mod``; a null n gives null."""
    return F.aggregate(F.sort_array(left_out), n.cast("long"), lambda at, x: F.when(x <= at, at + 1).otherwise(at))


def uniform_targets(edges: DataFrame, n_nodes: DataFrame, seed: int, label: str = "train", asked: DataFrame | None = None) -> DataFrame:
    """For each edge (event_idx, src, dst, day), or those of them ``asked``, a uniform node that is neither its source nor a
    target of it that day: event_idx, src, neg_dst, day. ``n_nodes`` is one row with that column."""
    n = F.broadcast(cut(n_nodes.select("n_nodes")))
    taken = grown(edges.select("src", F.col("dst").alias("neg_dst"), "day", F.lit(True).alias("_taken")))

    def drawn(slots: DataFrame) -> DataFrame:
        r = slots.crossJoin(n).withColumn("neg_dst", hash_int(seed, label, F.col("event_idx"), F.col("attempt")) % F.col("n_nodes")).drop("n_nodes")
        return r.join(taken, ["src", "neg_dst", "day"], "left").withColumn("ok", F.col("_taken").isNull() & (F.col("neg_dst") != F.col("src"))).drop("_taken")

    found, rest = _in_rounds((edges if asked is None else asked).select("event_idx", "src", "day"), drawn, ("event_idx", "src", "day"))
    found = found.select("event_idx", "src", "neg_dst", "day")
    if rest.isEmpty():
        return found
    rest = rest.join(grown(edges.select("src", "day", "dst")), ["src", "day"])
    rest = rest.groupBy("event_idx", "src", "day").agg(F.collect_set("dst").alias("x")).withColumn("x", F.array_union("x", F.array("src"))).crossJoin(n)
    rest = rest.withColumn("free", F.col("n_nodes") - F.size("x")).where("free > 0")
    place = F.try_mod(hash_int(seed, label, F.col("event_idx"), F.lit("rest")), F.col("free"))
    return found.unionByName(rest.select("event_idx", "src", nth_allowed(place, F.col("x")).alias("neg_dst"), "day"))


def unseen_pairs(slots: DataFrame, edges: DataFrame, n_nodes: DataFrame, seed: int, label: str = "legacy", keys: tuple[str, ...] = ("event_idx",)) -> DataFrame:
    """For each slot (its ``keys`` and day) a uniform pair of two nodes that never meet in the whole stream."""
    n = F.broadcast(cut(n_nodes.select("n_nodes")))
    own = [F.col(k) for k in keys]
    draw = lambda side: hash_int(seed, label, side, *own, F.col("attempt")) % F.col("n_nodes")
    pairs = grown(edges.select("src", "dst").distinct())

    def drawn(slots: DataFrame) -> DataFrame:
        r = slots.crossJoin(n).withColumns({"src": draw("s"), "dst": draw("d")}).drop("n_nodes")
        return r.join(grown(pairs.withColumn("_met", F.lit(True))), ["src", "dst"], "left").withColumn("ok", F.col("_met").isNull() & (F.col("src") != F.col("dst"))).drop("_met")

    found, rest = _in_rounds(slots.select(*keys, "day"), drawn, (*keys, "day"))
    found = found.select(*keys, "day", "src", "dst")
    if rest.isEmpty():
        return found
    # The rest: a source that has a target left, then one of these. Sources without are as many as pairs by nodes at most.
    met = pairs.where("src <> dst").groupBy("src").agg(F.collect_list("dst").alias("x"))
    full = met.crossJoin(n).where(F.size("x") == F.col("n_nodes") - 1).agg(F.collect_list("src").alias("full"))
    rest = rest.crossJoin(n).crossJoin(F.broadcast(full)).where("n_nodes > 1 AND n_nodes > size(full)")
    rest = rest.withColumn("src", nth_allowed(F.try_mod(hash_int(seed, label, "s", *own, F.lit("rest")), F.col("n_nodes") - F.size("full")), F.col("full")))
    rest = rest.join(grown(met), "src", "left").withColumn("x", F.array_append(F.coalesce("x", F.array().cast("array<bigint>")), F.col("src")))
    place = F.try_mod(hash_int(seed, label, "d", *own, F.lit("rest")), F.col("n_nodes") - F.size("x"))
    return found.unionByName(rest.select(*keys, "day", "src", nth_allowed(place, F.col("x")).alias("dst")))


def first_seen(edges: DataFrame) -> DataFrame:
    """Pairs in the order of their first edge: src, dst, first (event_idx), day and pos, numbered by days and within."""
    p = edges.groupBy("src", "dst").agg(F.min("event_idx").alias("first"), F.min("day").alias("day"))  # numbers rise with days
    within = F.row_number().over(W.partitionBy("day").orderBy("first")) - 1
    return p.withColumn("_w", within).join(F.broadcast(day_offsets(p).select("day", "lo")), "day").select("src", "dst", "first", "day", (F.col("lo") + F.col("_w")).alias("pos"))


def from_pool(clocks: DataFrame, pool: DataFrame, positives: DataFrame, seed: int, label: str) -> DataFrame:
    """Pairs without replacement for each clock (clock, need, lo, hi): the pool's places lo to hi - 1 (columns pos, src,
    dst), without the clock's positives (clock, src, dst). Rows: clock, k (slot, from 0), src, dst."""
    c = dealt(clocks.where("hi > lo AND need > 0"), "clock")
    size = F.col("hi") - F.col("lo")
    whole = size <= F.greatest(EXACT * F.col("need"), F.lit(WHOLE))
    few = c.where(whole).withColumn("pos", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    few = few.select("clock", "need", "pos", hash_key(seed, label, F.col("clock"), F.col("pos")).alias("ord"), F.lit(None).cast("long").alias("draw"))
    many = _attempts(c.where(~whole).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("need") - 1))), DRAWS)
    place = F.col("lo") + F.try_mod(hash_int(seed, label, F.col("clock"), F.col("i"), F.col("attempt")), size)
    # Places may be drawn repeatedly; the order of draws is a number, that of attempt and slot.
    many = many.select("clock", "need", place.alias("pos"), (F.col("attempt") * F.lit(10**12) + F.col("i")).alias("draw")).groupBy("clock", "need", "pos").agg(F.min("draw").alias("draw"))
    r = few.unionByName(many.withColumn("ord", F.lit(None).cast("string")))
    r = r.join(grown(pool.select("pos", "src", "dst")), "pos").join(grown(positives.select("clock", "src", "dst")), ["clock", "src", "dst"], "left_anti")
    k = F.row_number().over(W.partitionBy("clock").orderBy("ord", "draw", "pos")) - 1
    return r.withColumn("k", k.cast("long")).where("k < need").select("clock", "k", "src", "dst")


def padding(clocks: DataFrame, drawn: DataFrame, ends: DataFrame, positives: DataFrame, seed: int, label: str) -> DataFrame:
    """For the slots that ``from_pool`` left empty: a random source and a random target (``ends``: side, rank, node and
    n of each side) that are no positive of the clock. Rows: clock, k, src, dst."""
    got = drawn.groupBy("clock").agg(F.count("*").alias("got"))
    gap = clocks.join(grown(got), "clock", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need")
    slots = cut(gap.withColumn("k", F.explode(F.sequence(F.col("got").cast("long"), F.col("need") - 1))).select("clock", "k"))
    empty = slots.count()
    if not empty:
        return slots.select("clock", "k", F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"))
    r = _attempts(dealt(slots, "clock", "k"))
    for side in ("src", "dst"):
        nodes = ends.where(F.col("side") == side)
        n = F.broadcast(nodes.agg(F.count("*").alias("n")))
        r = r.crossJoin(n).withColumn("rank", hash_int(seed, label, "pad", side, F.col("clock"), F.col("k"), F.col("attempt")) % F.col("n")).drop("n")
        r = r.join(grown(nodes.select("rank", F.col("node").alias(side))), "rank").drop("rank")
    own = grown(positives.select("clock", "src", "dst"))
    found = grown(cut(_first(r.join(own, ["clock", "src", "dst"], "left_anti"), "clock", "k").select("clock", "k", "src", "dst")))
    if found.count() == empty:
        return found
    # What is left takes the first drawn source that has a target left.
    rest = r.join(found, ["clock", "k"], "left_anti").select("clock", "k", "attempt", "src")
    rest = _allowed_target(rest, own, ends, seed, (label, "pad", "rest"))
    return found.unionByName(_first(rest, "clock", "k").select("clock", "k", "src", "dst"))


def _allowed_target(slots: DataFrame, positives: DataFrame, ends: DataFrame, seed: int, label: tuple[str, ...]) -> DataFrame:
    """Slots (clock, k, src and more) with dst, a target that is no positive (clock, src, dst) of the clock; slots to
    which none is allowed go."""
    targets = grown(ends.where("side = 'dst'").select("rank", F.col("node").alias("dst")))
    taken = positives.join(targets, "dst").groupBy("clock", "src").agg(F.collect_set("rank").alias("x"))
    r = slots.join(grown(taken), ["clock", "src"], "left").withColumn("x", F.coalesce("x", F.array().cast("array<bigint>")))
    r = r.crossJoin(F.broadcast(targets.agg(F.count("*").alias("n")))).where(F.col("n") > F.size("x"))
    place = F.try_mod(hash_int(seed, *label, F.col("clock"), F.col("k")), F.col("n") - F.size("x"))
    return r.withColumn("rank", nth_allowed(place, F.col("x"))).join(targets, "rank").drop("x", "n", "rank")


def ranked_ends(edges: DataFrame) -> DataFrame:
    """The distinct sources and targets, each side ranked by node number: side, rank, node. Ranks go by blocks of
    numbers, of which only the table of blocks is ordered in one task."""
    nodes = edges.select(F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("node")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("node")))).alias("x")).select("x.*").distinct()
    nodes = nodes.withColumn("b", F.floor(F.col("node") / 4096))
    blocks = nodes.groupBy("side", "b").agg(F.count("*").alias("n"))
    blocks = blocks.select("side", "b", (F.sum("n").over(W.partitionBy("side").orderBy("b")) - F.col("n")).alias("lo"))
    within = F.row_number().over(W.partitionBy("side", "b").orderBy("node")) - 1
    return nodes.withColumn("_w", within).join(grown(blocks), ["side", "b"]).select("side", (F.col("lo") + F.col("_w")).alias("rank"), "node")


def batches(edges: DataFrame, span: str, size: int = BATCH) -> DataFrame:
    """The edges of a span with their batch of ``size`` consecutive ones (clock) and place in it (i)."""
    e = edges.where(F.col("split") == span)
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_idx").alias("_lo"))))
    at = F.col("event_idx") - F.col("_lo")
    return e.withColumn("clock", F.floor(at / size)).withColumn("i", (at % size).cast("long")).drop("_lo")


def batch_negatives(edges: DataFrame, strategy: str, seed: int, size: int = BATCH, span: str = "test", n_neg: int = 1) -> DataFrame:
    """Negatives on the batch clock, ``n_neg`` for each positive: clock, k, src, dst, day (that of positive k mod the
    batch's positives) and is_pad. The pool grows with the batches: pairs seen before the batch (historical), those of
    them first seen in the span (inductive), or those active in the span before the batch (recurring); ``random`` keeps
    source and day and draws a target."""
    pos = grown(cut(batches(edges, span, size)))
    # All batches are full but the last: the number of positives follows from one row.
    span_row = F.broadcast(pos.agg(F.count("*").alias("total")))
    npos = F.least(F.lit(size).cast("long"), F.col("total") - F.col("clock") * size)
    if strategy == "random":
        slots = pos.crossJoin(span_row).withColumn("npos", npos).withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(n_neg - 1)))).select("clock", (F.col("r") * F.col("npos") + F.col("i")).alias("k"), "src", "day")
        ends = cut(ranked_ends(edges))
        targets = ends.where("side = 'dst'")
        targets, n = grown(targets.select("rank", F.col("node").alias("dst"))), F.broadcast(cut(targets.agg(F.count("*").alias("n"))))
        taken = grown(pos.select("clock", "src", "dst", F.lit(True).alias("_taken")))

        def target(slots: DataFrame) -> DataFrame:
            r = slots.crossJoin(n).withColumn("rank", hash_int(seed, strategy, F.col("clock"), F.col("k"), F.col("attempt")) % F.col("n")).drop("n")
            return r.join(targets, "rank").drop("rank").join(taken, ["clock", "src", "dst"], "left").withColumn("ok", F.col("_taken").isNull()).drop("_taken")

        found, rest = _in_rounds(slots, target, ("clock", "k", "src", "day"))
        found = found.select("clock", "k", "src", "dst", "day")
        if rest.isEmpty():
            return found.withColumn("is_pad", F.lit(False))
        rest = _allowed_target(rest, pos.select("clock", "src", "dst"), ends, seed, (strategy, "rest"))
        return found.unionByName(rest.select("clock", "k", "src", "dst", "day")).withColumn("is_pad", F.lit(False))
    start = F.broadcast(pos.agg(F.min("event_idx").alias("start")))
    source = edges.crossJoin(start).where("event_idx >= start").drop("start") if strategy == "recurring" else edges
    pool = grown(cut(first_seen(source)))
    # How much of the list is visible when a batch begins, and where the span's own pairs start in it.
    edge_batch = F.floor((F.col("first") - F.col("start")) / size)
    added = pool.crossJoin(start).groupBy(F.greatest(edge_batch, F.lit(-1)).alias("clock")).agg(F.count("*").alias("new"))
    calendar = pos.select("clock").distinct().join(grown(added), "clock", "full").withColumn("new", F.coalesce("new", F.lit(0)))
    calendar = calendar.crossJoin(F.broadcast(added.agg(F.coalesce(F.sum(F.when(F.col("clock") < 0, F.col("new"))), F.lit(0)).alias("old")))).crossJoin(span_row)
    lo = F.col("old") if strategy == "inductive" else F.lit(0)
    clocks = before(calendar, "clock", "new", "hi").where("clock >= 0").select("clock", (npos * n_neg).alias("need"), lo.cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"))
    clocks = grown(cut(clocks))
    drawn = cut(from_pool(clocks, pool, pos, seed, strategy))
    pads = padding(clocks, drawn, ranked_ends(edges), pos, seed, strategy)
    both = drawn.withColumn("is_pad", F.lit(False)).unionByName(pads.withColumn("is_pad", F.lit(True)))
    both = both.crossJoin(span_row).withColumn("i", F.col("k") % npos).drop("total")
    return both.join(pos.select("clock", "i", "day"), ["clock", "i"]).select("clock", "k", "src", "dst", "day", "is_pad")


def before(rows: DataFrame, order: str, value: str, name: str, block: int = 4096) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``order`` (distinct whole numbers). Only sums of blocks of
    ``block`` numbers are ordered in one task."""
    rows = rows.withColumn("_b", F.floor(F.col(order) / block))
    sums = rows.groupBy("_b").agg(F.sum(value).alias("_n"))
    sums = sums.select("_b", (F.sum("_n").over(W.orderBy("_b")) - F.col("_n")).alias("_ahead"))
    within = F.sum(value).over(W.partitionBy("_b").orderBy(order)) - F.col(value)
    return rows.withColumn("_w", within).join(grown(sums), "_b").withColumn(name, F.col("_ahead") + F.col("_w")).drop("_b", "_w", "_ahead")


def day_negatives(edges: DataFrame, strategy: str, seed: int, n_nodes: DataFrame) -> DataFrame:
    """Negatives of test days, as many as positives, from the pairs seen before the test span (historical) or only in it
    (inductive), without the day's positives; where these don't suffice, pairs of nodes that never meet: clock (day), k,
    src, dst."""
    test = edges.where("split = 'test'")
    ahead = edges.where("split <> 'test'")
    pool = first_seen(ahead) if strategy == "historical" else first_seen(test.join(grown(ahead.select("src", "dst").distinct()), ["src", "dst"], "left_anti"))
    pool = grown(cut(pool))
    clocks = test.groupBy(F.col("day").alias("clock")).agg(F.count("*").alias("need")).crossJoin(F.broadcast(pool.agg(F.count("*").alias("hi")))).withColumn("lo", F.lit(0).cast("long"))
    clocks = grown(cut(clocks))  # else Spark leaves out that ``from_pool`` deals them, as they are grouped alike, and draws all in one task
    label = f"legacy-{strategy}"
    drawn = cut(from_pool(clocks, pool, test.select(F.col("day").alias("clock"), "src", "dst"), seed, label))
    got = drawn.groupBy("clock").agg(F.count("*").alias("got"))
    gap = cut(clocks.select("clock", "need").join(got, "clock", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < need"))
    if gap.isEmpty():
        return drawn
    slots = dealt(gap, "clock").select("clock", F.explode(F.sequence(F.col("got").cast("long"), F.col("need") - 1)).alias("k"), F.col("clock").alias("day"))
    return drawn.unionByName(unseen_pairs(slots, edges, n_nodes, seed, f"{label}-top", ("clock", "k")).drop("day"))


def mixture(edges: DataFrame, n_nodes: DataFrame, seed: int, hard: float = 0.5, same_source: float = 0.5, popular: float = 0.2, novel: float = 0.1, window: int = 30, tokens: int = 0, span: tuple[int, int] | None = None) -> DataFrame:
    """Training negatives: for each edge a hard pair seen before its day (of the same source with probability
    ``same_source``), a target by past popularity (over the last ``tokens`` edges before the day, if given), a pair first
    seen within ``window`` days, or a uniform target; what finds nothing falls back to uniform. With a ``span`` only edges
    with event_idx in [lo, hi) are asked for; what is drawn for an edge does not hang on it. event_idx, branch, src, dst."""
    u = unit(seed, "branch", F.col("event_idx"))
    v = unit(seed, "source", F.col("event_idx"))
    branch = F.when(u < hard, F.when(v < same_source, "source").otherwise("global")).when(u < hard + popular, "popular").when(u < hard + popular + novel, "novel").otherwise("uniform")
    asked = edges if span is None else edges.where((F.col("event_idx") >= span[0]) & (F.col("event_idx") < span[1]))
    q = asked.select("event_idx", "src", "dst", "day", branch.alias("branch"))
    pool = grown(cut(first_seen(edges)))
    days = day_offsets(edges).select("day", F.col("lo").alias("events_before"))
    pairs = pool.groupBy("day").agg(F.count("*").alias("n"))
    # Of each day: the pairs first seen before it, and before the window. As small as the calendar.
    order = W.orderBy("day")
    ticks = days.select("day").union(days.select(F.col("day") - window)).distinct().join(pairs, "day", "left").withColumn("upto", F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("day", "upto")
    days = days.join(ticks, "day").join(ticks.select((F.col("day") + window).alias("day"), F.col("upto").alias("older")), "day")
    q = q.join(F.broadcast(days), "day")
    own = F.row_number().over(W.partitionBy("src").orderBy("first")) - 1
    mine = pool.withColumn("own", own.cast("long"))
    sources = mine.select("src", "day", F.lit(None).cast("long").alias("event_idx"), F.lit(1).alias("ev")).unionByName(q.where("branch = 'source'").select("src", "day", "event_idx", F.lit(0).alias("ev")))
    sources = sources.withColumn("mine", F.coalesce(F.sum("ev").over(W.partitionBy("src").orderBy("day").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))).where("ev = 0").select("event_idx", "mine")
    zero, b = F.lit(0).cast("long"), F.col("branch")
    oldest = F.greatest(zero, F.col("events_before") - tokens) if tokens else zero
    lo = F.when(b == "novel", F.col("older")).when(b == "popular", oldest).otherwise(zero)
    hi = F.when(b == "source", F.col("mine")).when(b == "popular", F.col("events_before")).when(b != "uniform", F.col("upto"))
    r = cut(q.join(grown(sources), "event_idx", "left").select("event_idx", F.col("src").alias("of"), "day", "branch", lo.alias("lo"), hi.alias("hi")))
    own_list = grown(mine.select(F.col("src").alias("of"), F.col("own").alias("pos"), "dst"))
    pair_list, target_list = grown(pool.select("pos", "src", "dst")), grown(edges.select(F.col("event_idx").alias("pos"), "dst"))
    taken = grown(edges.select("src", "dst", "day", F.lit(True).alias("_taken")))

    def drawn(slots: DataFrame) -> DataFrame:
        place = F.col("lo") + F.try_mod(hash_int(seed, b, F.col("event_idx"), F.col("attempt")), F.col("hi") - F.col("lo"))
        x = slots.withColumn("pos", place)
        own_pairs = x.where(b == "source").join(own_list, ["of", "pos"], "left").withColumn("src", F.col("of"))
        seen_pairs = x.where(b.isin("global", "novel")).join(pair_list, "pos", "left")
        popular_targets = x.where(b == "popular").join(target_list, "pos", "left").withColumn("src", F.col("of"))
        x = own_pairs.unionByName(seen_pairs).unionByName(popular_targets).drop("pos").join(taken, ["src", "dst", "day"], "left")
        return x.withColumn("ok", F.coalesce(F.col("_taken").isNull() & (F.col("src") != F.col("dst")), F.lit(False))).drop("_taken")

    found, failed = _in_rounds(r.where("hi > lo"), drawn, ("event_idx",), DRAWS)
    found = found.select("event_idx", "branch", "src", "dst")
    # What drew nothing: no place to draw from, or no draw that is allowed.
    keys = ["event_idx", "src", "day"]
    rest = r.where("hi IS NULL OR hi <= lo").select("event_idx", F.col("of").alias("src"), "day").unionByName(failed.select("event_idx", F.col("of").alias("src"), "day"))
    uniform = uniform_targets(edges, n_nodes, seed, "fallback", rest.select(*keys))
    return found.unionByName(uniform.select("event_idx", F.lit("uniform").alias("branch"), "src", F.col("neg_dst").alias("dst")))


def vocabulary_mask(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """event_idx and the nodes that a full softmax leaves out for it: its source, and the source's other targets that
    day."""
    own = edges.select("event_idx", F.col("src").alias("node"))
    other = edges.select("event_idx", "src", "dst", "day").join(edges.select("src", "day", F.col("dst").alias("node")), ["src", "day"]).where("node <> dst").select("event_idx", "node")
    return own.union(other).distinct().join(nodes.select(F.col("node_id").alias("node")), "node", "left_semi")


def probe(edges: DataFrame, n_nodes: DataFrame, seed: int, events: int = 500, candidates: int = 100) -> DataFrame:
    """A bounded probe of the validation span, the first events in hash order, each with uniform candidates:
    event_idx, j, node. A sample is the feature here."""
    e = edges.where("split = 'val'").orderBy(hash_key(seed, "probe", F.col("event_idx")), "event_idx").limit(events)
    e = e.select("event_idx", F.explode(F.sequence(F.lit(0), F.lit(candidates - 1))).alias("j")).crossJoin(F.broadcast(n_nodes.select("n_nodes")))
    return e.select("event_idx", "j", (hash_int(seed, "candidate", F.col("event_idx"), F.col("j")) % F.col("n_nodes")).alias("node"))


def in_batch(batch: DataFrame, edges: DataFrame) -> DataFrame:
    """The other targets of each row's batch (clock, event_idx, src, dst, day) as its negatives: i, j, src, dst and
    masked, true where the target is the row's own, its source, or one that the source has that day. Batches have a fixed
    size, so this grows with the edges."""
    x = batch.select("clock", F.col("event_idx").alias("i"), "src", "day", F.col("dst").alias("own"))
    pairs = x.join(batch.select("clock", F.col("event_idx").alias("j"), "dst"), "clock").where("i <> j")
    known = edges.select("src", "dst", "day").distinct().withColumn("known", F.lit(True))
    pairs = pairs.join(known, ["src", "dst", "day"], "left")
    return pairs.select("i", "j", "src", "dst", ((F.col("dst") == F.col("own")) | (F.col("dst") == F.col("src")) | F.coalesce("known", F.lit(False))).alias("masked"))
