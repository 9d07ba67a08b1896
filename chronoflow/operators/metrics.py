"""Tie-aware metrics of scored rows (y 1 or 0, score), by any grouping columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def _by_score(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives of each distinct score; what follows is as large as the number of distinct scores. A row
    with n_rows stands for so many."""
    n = F.col("n_rows").cast("long") if "n_rows" in scores.columns else F.lit(1)
    return scores.groupBy(*keys, "score").agg(F.sum(F.col("y") * n).alias("p"), F.sum((1 - F.col("y")) * n).alias("n"))


STEPS = 4096  # blocks of scores between a power of two and the next


def _block(score):
    """A number that does not fall as the score rises: its sign, power of two and step above that. Null stays null, and
    NaN is above all, as in Spark's order."""
    x = score.cast("double")
    power = F.least(F.floor(F.log2(F.abs(x))), F.lit(1025))
    step = F.floor(F.abs(x) / F.pow(F.lit(2.0), power) * STEPS)
    place = F.signum(x).cast("long") * ((power + 1100) * 4 * STEPS + step)
    return F.when(F.isnan(x), F.lit((1 << 63) - 1)).when(x == 0, F.lit(0)).otherwise(place).cast("long")


def _cumulated(scores: DataFrame, keys: list[str], down: bool = False) -> DataFrame:
    """The distinct scores with p and n, both summed up to each score (to_p, to_n) and over all (all_p, all_n). Without
    keys the scores are ordered in blocks and only the blocks' sums in one task: at most ``STEPS`` an octave of scores."""
    b, far = _by_score(scores, keys), (W.unboundedPreceding, 0)
    order = lambda c: F.desc(c) if down else F.asc(c)
    if keys:
        to, every = W.partitionBy(*keys).orderBy(order("score")).rowsBetween(*far), W.partitionBy(*keys)
        return b.withColumns({f"to_{c}": F.sum(c).over(to) for c in "pn"} | {f"all_{c}": F.sum(c).over(every) for c in "pn"})
    b = b.withColumn("_block", _block(F.col("score")))
    to = W.orderBy(order("_at")).rowsBetween(*far)
    blocks = b.groupBy(F.col("_block").alias("_at")).agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    blocks = blocks.withColumns({f"before{c}": F.sum(c).over(to) - F.col(c) for c in ("_p", "_n")} | {f"all{c}": F.sum(c).over(W.partitionBy()) for c in ("_p", "_n")})
    inside = W.partitionBy("_block").orderBy(order("score")).rowsBetween(*far)
    b = b.withColumns({f"in_{c}": F.sum(c).over(inside) for c in "pn"}).join(blocks, F.col("_block").eqNullSafe(F.col("_at")))
    return b.select("score", "p", "n", *[(F.col(f"before_{c}") + F.col(f"in_{c}")).alias(f"to_{c}") for c in "pn"], "all_p", "all_n")


def auroc(scores: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The area under the ROC curve, ties counted half; null without both kinds."""
    b = _cumulated(scores, keys).withColumn("w", F.col("p") * (F.col("to_n") - F.col("n") / 2.0))
    return b.groupBy(*keys).agg(F.try_divide(F.sum("w"), (F.sum("p") * F.sum("n")).cast("double")).alias("auroc"))


def average_precision(scores: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Precision summed over the steps of recall, read at the end of each block of ties."""
    b = _cumulated(scores, keys, down=True)
    return b.groupBy(*keys).agg(F.try_divide(F.sum(F.col("p") * F.col("to_p") / (F.col("to_p") + F.col("to_n"))), F.sum("p").cast("double")).alias("ap"))


def batch_auroc(scores: DataFrame, keys: list[str] = [], clock: str = "clock") -> DataFrame:  # noqa: B006
    """The unweighted mean of the batches' areas; batches without both kinds don't count."""
    return auroc(scores, [*keys, clock]).where("auroc IS NOT NULL").groupBy(*keys).agg(F.avg("auroc").alias("auroc"), F.count("*").alias("batches"))


def strata(scores: DataFrame, flag: str = "seen") -> DataFrame:
    """Each row once under 'all' and once under 'seen' or 'unseen'."""
    return scores.withColumn("stratum", F.explode(F.array(F.lit("all"), F.when(F.col(flag), "seen").otherwise("unseen"))))


def errors(rows: DataFrame, truth: str, guess: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    e = F.col(guess) - F.col(truth)
    return rows.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def rank_metrics(ranks: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """MRR and hits at 1, 10 and 100, by stratum; null for a stratum without rows."""
    hit = lambda k: F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)).alias(f"hits{k}")
    return strata(ranks).groupBy(*keys, "stratum").agg(F.count("*").alias("n"), F.avg(1.0 / F.col("rank")).alias("mrr"), hit(1), hit(10), hit(100))


BINS, FEW = 4096, 10_000


def exact_median(rows: DataFrame, column: str) -> float | None:
    """The median of finite numbers (mean of the middle two), null without any. Each pass counts the values that may hold
    the middle in ``BINS`` bins between their bounds and goes on with the bin of the middle, until it has ``FEW`` values
    or one; the driver gets a histogram, never the values. ``rows`` are read once a pass, two or three times as a rule."""
    v = rows.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL")
    n, low, high = v.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    first, last, inside = (n - 1) // 2, n // 2, n
    while low < high and inside > FEW:
        place = F.least(F.floor((F.col("v") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = v.where(F.col("v").between(low, high)).groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("b").collect()
        ahead = 0
        for k, x in enumerate(bins):
            if first < ahead + x["n"]:
                break
            ahead += x["n"]
        if last >= ahead + x["n"]:  # the middle two stand at a border
            return (x["high"] + bins[k + 1]["low"]) / 2
        first, last, inside, low, high = first - ahead, last - ahead, x["n"], x["low"], x["high"]
    if low == high:
        return low
    values = sorted(r["v"] for r in v.where(F.col("v").between(low, high)).collect())  # at most ``FEW``
    return (values[first] + values[last]) / 2


def youden(scores: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """The threshold with the largest true less false positive rate, read at the ends of ties (largest if equal)."""
    b = _cumulated(scores, keys, down=True)
    b = b.withColumn("j", F.try_divide("to_p", "all_p") - F.try_divide("to_n", "all_n"))
    return b.groupBy(*keys).agg(F.max(F.struct("j", "score")).alias("m")).select(*keys, F.col("m.score").alias("threshold"), F.col("m.j").alias("j"))


def fdr_npv(scores: DataFrame, threshold: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """False discovery rate and negative predictive value at a frozen threshold (score >= it is positive), and
    prevalence; a rate without cases is 0."""
    r = scores.join(F.broadcast(threshold), keys) if keys else scores.crossJoin(F.broadcast(threshold))
    count = lambda c: F.sum(F.when(c, 1).otherwise(0))
    up, pos = F.col("score") >= F.col("threshold"), F.col("y") == 1
    rate = lambda a, b: F.coalesce(F.try_divide(count(a).cast("double"), count(b).cast("double")), F.lit(0.0))
    return r.groupBy(*keys).agg(rate(up & ~pos, up).alias("fdr"), rate(~up & ~pos, ~up).alias("npv"), F.avg("y").alias("prevalence"))


def spearman(rows: DataFrame, a: str, b: str, keys: list[str], least: int = 5, order: str = "id") -> DataFrame:
    """Correlation of ordinal ranks within each key with ``least`` rows or more; ties go by ``order``."""
    rank = lambda c: F.row_number().over(W.partitionBy(*keys).orderBy(c, order))
    r = rows.withColumns({"_a": rank(a), "_b": rank(b)})
    return r.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_a", "_b").alias("rho")).where(F.col("n") >= least)


def z_mean(scores: DataFrame, model: str = "model", keys: list[str] = ["id"]) -> DataFrame:  # noqa: B006
    """The average over models of scores standardised by model (a deviation of 0 counts as 1)."""
    w = scores.groupBy(model).agg(F.avg("score").alias("_m"), F.stddev_pop("score").alias("_s"))
    z = (F.col("score") - F.col("_m")) / F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s"))
    return scores.join(F.broadcast(w), model).groupBy(*keys).agg(F.avg(z).alias("score"))


def over_seeds(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of ``value`` over seeds."""
    return metrics.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("seeds"))


def epoch_means(history: DataFrame) -> DataFrame:
    """The mean of ``value`` at each epoch over the seeds that reached it."""
    return history.groupBy("epoch").agg(F.avg("value").alias("value"), F.count("value").alias("seeds"))


def seed_deltas(metrics: DataFrame, reference: DataFrame, model: str = "model") -> DataFrame:
    """The difference of each model's value to that of the reference model (one row) with the same seed and metric."""
    ref = metrics.join(F.broadcast(reference.select(model)), model, "left_semi").select("seed", "metric", F.col("value").alias("_ref"))
    rest = metrics.join(F.broadcast(reference.select(model)), model, "left_anti")
    return rest.join(ref, ["seed", "metric"]).select(model, "seed", "metric", (F.col("value") - F.col("_ref")).alias("delta"))


def selected(history: DataFrame, patience: int) -> DataFrame:
    """Of each seed's epochs (seed, epoch, value) up to where ``patience`` epochs brought nothing better: the best epoch
    (the first of equals), its value, and the last epoch that ran."""
    w = W.partitionBy("seed").orderBy("epoch")
    best = F.max("value").over(w.rowsBetween(W.unboundedPreceding, -1))
    h = history.withColumn("_since", F.when(best.isNull() | (F.col("value") > best), F.col("epoch")))
    h = h.withColumn("_since", F.max("_since").over(w)).withColumn("_stop", F.min(F.when(F.col("epoch") - F.col("_since") >= patience, F.col("epoch"))).over(W.partitionBy("seed")))
    h = h.where("_stop IS NULL OR epoch <= _stop")
    return h.groupBy("seed").agg(F.max(F.struct("value", (-F.col("epoch")).alias("e"))).alias("m"), F.max("epoch").alias("last")).select("seed", (-F.col("m.e")).alias("epoch"), F.col("m.value").alias("value"), "last")


def combined(mrr, ap):
    """The geometric mean of two metrics, negative ones counted as 0."""
    return F.sqrt(F.greatest(mrr, F.lit(0.0)) * F.greatest(ap, F.lit(0.0)))


def binary_auroc(p, q):
    """The area for scores 0 and 1 that a share p of positives and q of negatives has."""
    return 0.5 + (p - q) / 2.0
