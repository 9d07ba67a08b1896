"""Mixing sources to target weights by entropy balancing. Built-in functions only.

Sources, ordered by name (null last), have the weights given, in turn and from the start again, and share the words of
all documents by weight. No source may be taken more often than ``limit`` times its size; what is above is shared again
by weight among the others (the level at which all of it is dealt out is found in closed form).

The rate of a document is the one nearest to 1 in relative entropy under the constraint that its source's words sum to
the target: ``exp(lambda * size / mean size of the source)``, at most ``limit``. The dual is convex; its derivative
and curvature in each source's lambda are sums over (source, size) classes, counted once over all documents, and Newton
steps (halving a bracket where a step would leave it) solve it for all sources at once; if they do not within ``STEPS``
steps, that is an error.

Rates become copies by classes: of n equal-sized documents with rate r, round(n * r) copies are taken, and what rounding
leaves of a source's words is repaid through the class that meets it most closely. Within a class the copies are
spread evenly, the remainder by a hash order of the documents, so that reruns agree.

Edge cases: a null or empty text has size 0 and takes nothing; a null source is a source; equal rows are documents of
their own with equal ranks up to order; a source without words has target 0; an empty table gives an empty result; other
columns pass through ``mixed``, except those with the names of the results. Names starting with ``__m_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.llm.quality_lines import words_of
from chronoflow.llm.store import dropped, written

WEIGHTS = (5, 2, 1)
LIMIT = 3
STEPS, CLOSE = 100, 1e-7
GROUP = 1000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """From (__m_source, __m_words) of every source: the same with its target. The number of sources is small next to
    that of documents; they are ordered in one task."""
    order = W.orderBy(F.col("__m_source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", weight).withColumn("all", F.sum("__m_words").over(W.partitionBy()))
    s = s.withColumn("cap", limit * F.col("__m_words"))
    level = W.orderBy(F.col("cap") / F.col("w"), F.col("__m_source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("w").over(level.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", (F.col("all") - before) / rest).withColumn("full", F.col("cap") <= F.col("w") * F.col("level"))
    s = s.withColumn("level", F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("at"), "level"))).over(W.partitionBy())["level"])
    return s.select("__m_source", "__m_words", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("level")).alias("__m_target"))


def multipliers(classes: DataFrame, wanted: DataFrame, limit: int = LIMIT) -> DataFrame:
    """lambda of every source, by Newton steps on the dual. ``classes``: source, size and number of its documents."""
    state = wanted.select("__m_source", "__m_target", F.lit(0.0).alias("x"), F.lit(-1e6).alias("lo"), F.lit(1e6).alias("hi"), F.lit(False).alias("done"))
    state = written(state, "dual")
    joined = lambda s: classes.join(s, classes["__m_source"].eqNullSafe(s["__m_source"])).drop(s["__m_source"])
    for _ in range(STEPS):
        old = state
        rate = F.least(F.lit(float(limit)), F.exp(F.least(F.col("x") * F.col("z"), F.lit(50.0))))
        words = F.col("__m_n") * F.col("__m_size") * rate
        sums = joined(state).groupBy("__m_source").agg(F.sum(words).alias("f"), F.sum(F.when(rate < limit, words * F.col("z")).otherwise(0.0)).alias("df"))
        state = state.alias("s").join(sums.alias("n"), F.col("s.__m_source").eqNullSafe(F.col("n.__m_source"))).select("s.*", "f", "df")
        over = F.col("f") > F.col("__m_target")
        state = state.withColumns({"done": F.abs(F.col("f") - F.col("__m_target")) <= CLOSE * F.col("__m_target"), "hi": F.when(over, F.col("x")).otherwise(F.col("hi")), "lo": F.when(over, F.col("lo")).otherwise(F.col("x"))})
        # The step is Newton's for log f = log target, as log f is nearly linear.
        step = F.col("x") - F.try_divide((F.ln("f") - F.ln("__m_target")) * F.col("f"), F.col("df"))
        # Far ends of the bracket are approached by doubling.
        half = F.when(F.col("hi") == 1e6, F.greatest(2 * F.abs("x"), F.lit(1.0))).when(F.col("lo") == -1e6, -F.greatest(2 * F.abs("x"), F.lit(1.0))).otherwise((F.col("lo") + F.col("hi")) / 2)
        state = state.withColumn("step", F.when((step > F.col("lo")) & (step < F.col("hi")) & (F.abs(step) < 1e5), step).otherwise(half))
        last, state = old, written(state.select("__m_source", "__m_target", F.when(F.col("done"), F.col("x")).otherwise(F.col("step")).alias("x"), "lo", "hi", "done"), "dual")
        dropped(last)
        if state.filter("NOT done").isEmpty():
            break
    else:
        raise RuntimeError(f"no multipliers within {STEPS} steps")
    return state.select("__m_source", F.col("x").alias("__m_lambda"))


def class_copies(classes: DataFrame, wanted: DataFrame, lambdas: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The copies that each (source, size) class takes in all (__m_copies)."""
    same = lambda s: classes["__m_source"].eqNullSafe(s["__m_source"])
    full = F.col("__m_target") >= limit * F.col("__m_words") * (1 - 1e-12)
    rate = F.when(full, F.lit(float(limit))).otherwise(F.least(F.lit(float(limit)), F.exp(F.col("__m_lambda") * F.col("z"))))
    c = classes.join(wanted, same(wanted)).drop(wanted["__m_source"])
    c = c.join(lambdas, c["__m_source"].eqNullSafe(lambdas["__m_source"]), "left").drop(lambdas["__m_source"])
    c = written(c.withColumn("__m_copies", F.round(F.col("__m_n") * rate).cast("long")).select("__m_source", "__m_size", "__m_n", "__m_target", "__m_copies"), "classes")
    for _ in range(3):
        old = c
        left = c.groupBy("__m_source").agg((F.max("__m_target") - F.sum(F.col("__m_copies") * F.col("__m_size"))).alias("left"))
        near = c.join(left, c["__m_source"].eqNullSafe(left["__m_source"])).drop(left["__m_source"]).filter("__m_size > 0")
        move = F.greatest(-F.col("__m_copies"), F.least(limit * F.col("__m_n") - F.col("__m_copies"), F.round(F.col("left") / F.col("__m_size")).cast("long")))
        near = near.withColumn("move", move)
        best = near.groupBy("__m_source").agg(F.min(F.struct(F.abs(F.col("left") - F.col("move") * F.col("__m_size")).alias("miss"), F.abs("move").alias("moves"), "__m_size", "move")).alias("best"))
        hit = F.col("c.__m_source").eqNullSafe(F.col("b.__m_source")) & (F.col("c.__m_size") == F.col("b.best.__m_size"))
        c = c.alias("c").join(best.alias("b"), hit, "left").select("c.__m_source", "c.__m_size", "c.__m_n", "c.__m_target", (F.col("c.__m_copies") + F.coalesce("b.best.move", F.lit(0))).alias("__m_copies"))
        last, c = old, written(c, "classes")
        dropped(last)
    return c.drop("__m_target")


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """``docs`` with size, source_size, target and copies (0 to ``limit``)."""
    columns = [c for c in docs.columns if c not in ("size", "source_size", "target", "copies")]
    docs = docs.withColumns({"__m_id": F.col(doc_id), "__m_source": F.col(source), "__m_text": F.xxhash64(text), "__m_size": F.size(words_of(F.coalesce(F.col(text), F.lit("")))).cast("long")})
    counts = written(docs.groupBy("__m_source", "__m_size").agg(F.count("*").alias("__m_n")), "sizes")
    sizes = counts.groupBy("__m_source").agg(F.sum(F.col("__m_n") * F.col("__m_size")).alias("__m_words"), F.sum("__m_n").alias("d"))
    wanted = written(targets(sizes.drop("d"), weights, limit), "targets")
    mean = sizes.select(F.col("__m_source").alias("s"), (F.col("__m_words") / F.col("d")).alias("mean"))
    classes = counts.join(mean, counts["__m_source"].eqNullSafe(mean["s"])).select("__m_source", "__m_size", "__m_n", F.coalesce(F.try_divide("__m_size", "mean"), F.lit(0.0)).alias("z"))
    classes = written(classes, "classes")
    # Sources taken at the limit, or without words, need no rates.
    open_ = wanted.filter((F.col("__m_target") < limit * F.col("__m_words") * (1 - 1e-12)) & (F.col("__m_target") > 0))
    copies = class_copies(classes, wanted, multipliers(classes, open_, limit), limit)
    copies = copies.withColumn("groups", F.ceil(F.col("__m_n") / GROUP)).join(wanted, copies["__m_source"].eqNullSafe(wanted["__m_source"])).drop(wanted["__m_source"])
    copies = written(copies, "copies")
    same = docs["__m_source"].eqNullSafe(copies["__m_source"]) & (docs["__m_size"] == copies["__m_size"])
    rows = docs.join(copies, same).drop(copies["__m_source"]).drop(copies["__m_size"])
    rows = rows.withColumn("__m_group", F.pmod(F.xxhash64("__m_id", F.lit("group")), F.col("groups")))
    # A document's rank in its class: the ranks before its group's, and its rank there.
    small = docs.select("__m_id", "__m_source", "__m_size").join(copies, same).drop(copies["__m_source"]).drop(copies["__m_size"])
    small = small.filter("groups > 1").withColumn("__m_group", F.pmod(F.xxhash64("__m_id", F.lit("group")), F.col("groups")))
    ahead = small.groupBy("__m_source", "__m_size", "__m_group").agg(F.count("*").alias("here"))
    ahead = ahead.withColumn("ahead", F.sum("here").over(W.partitionBy("__m_source", "__m_size").orderBy("__m_group")) - F.col("here")).drop("here")
    ahead = written(ahead, "ranks")
    keys = [rows[k].eqNullSafe(ahead[k]) for k in ("__m_source", "__m_size", "__m_group")]
    ranked = rows.join(ahead, keys[0] & keys[1] & keys[2], "left").drop(*[ahead[k] for k in ("__m_source", "__m_size", "__m_group")])
    at = F.row_number().over(W.partitionBy("__m_source", "__m_size", "__m_group").orderBy(F.xxhash64("__m_id"), "__m_id", "__m_text"))
    ranked = ranked.withColumn("__m_rank", at + F.coalesce("ahead", F.lit(0)))
    each = F.floor(F.col("__m_copies") / F.col("__m_n")) + F.when(F.col("__m_rank") <= F.col("__m_copies") % F.col("__m_n"), 1).otherwise(0)
    return ranked.select(*columns, F.col("__m_size").alias("size"), F.col("__m_words").alias("source_size"), F.col("__m_target").alias("target"), each.cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document."""
    rows = mixed(docs.select("doc_id", "text", "source"), **options)
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each document as often as the mix takes it."""
    rows = mixed(docs, **options)
    return rows.withColumn("__m_copy", F.explode(F.sequence(F.lit(1), F.greatest("copies", F.lit(1))))).filter("copies > 0").select(*docs.columns)
