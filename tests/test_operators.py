"""Hand-computed cases, leakage properties and invariants of the temporal operators."""

import math
import random
import warnings

import pytest
from pyspark.sql import functions as F

from chronoflow.functions.vectors import logsumexp, time_encoding
from chronoflow.operators import asof, daily, features as feat, graph, memory, metrics, ranking, sampling

LN = [math.log(k) if k else 0 for k in range(10)]


def events(spark, rows):
    return spark.createDataFrame(rows, "s long, d long, day int")


def asked(spark, s, d, day):
    return spark.createDataFrame([(0, s, d, day)], "query_id long, s long, d long, day int")


def values(df):
    return [pytest.approx(x) if isinstance(x, float) else x for x in df.drop("query_id").first()]


def of(spark, rows, q, columns):
    return [float(x) for x in feat.features(events(spark, rows), asked(spark, *q), columns).drop("query_id").first()]


def test_base_features(spark):
    rows = [(0, 2, 4), (1, 3, 4)]
    assert of(spark, rows, (0, 2, 7), feat.BASE4) == pytest.approx([1, LN[4], 1, LN[4]])
    assert of(spark, rows, (0, 3, 7), feat.BASE4) == pytest.approx([0, 0, 1, LN[4]])
    assert of(spark, [(0, 1, 1), (0, 1, 5)], (0, 1, 6), feat.BASE4) == pytest.approx([1, LN[2], 1, LN[2]])


def test_global_features(spark):
    rows = [(0, 1, 0), (2, 1, 0), (0, 1, 1)]
    assert of(spark, rows, (0, 1, 2), feat.GLOBAL11) == pytest.approx([1, LN[2], 1, LN[2], 1, LN[2], LN[3], LN[4], LN[4], LN[2], LN[3]])


def test_window_edge_counts_the_day_exactly_w_back(spark):
    assert of(spark, [(0, 1, 0)], (0, 1, 30), ("dst_freq30", "dst_freq")) == pytest.approx([LN[2], LN[2]])
    assert of(spark, [(0, 1, 0)], (0, 1, 31), ("dst_freq30", "dst_freq")) == pytest.approx([0, LN[2]])


def test_wide_features(spark):
    rows = [(0, 1, 0), (2, 1, 0), (0, 1, 5), (0, 3, 5)]
    assert of(spark, rows, (0, 1, 6), feat.WIDE) == pytest.approx([LN[3], LN[7], LN[4], LN[4], LN[4], LN[3], LN[3], 0, LN[3]])
    assert of(spark, rows, (0, 1, 6), feat.BUCKETS) == [1, 0, 1]
    assert of(spark, rows, (0, 4, 6), ("rec_rank",)) == pytest.approx([LN[3] + 1])


def test_buckets(spark):
    for day, expected in ((5, [1, 0, 1]), (6, [0, 1, 1]), (20, [0, 0, 0])):
        assert of(spark, [(0, 2, 4)], (0, 2, day), feat.BUCKETS) == expected


def test_no_leak_from_the_same_day_or_later(spark):
    rows = [(0, 1, 1), (1, 2, 3)]
    base = of(spark, rows, (0, 1, 3), feat.WIDE23)
    assert of(spark, [*rows, (0, 1, 3)], (0, 1, 3), feat.WIDE23) == base
    assert of(spark, [*rows, (0, 1, 8)], (0, 1, 3), feat.WIDE23) == base
    assert of(spark, [*rows, (0, 1, 2)], (0, 1, 3), feat.WIDE23) != base


def edge_table(spark, rows, train_end=None, val_end=None):
    n = len(rows)
    full = [(k, s, d, day, "train" if k < (train_end if train_end is not None else n) else "val" if k < (val_end if val_end is not None else n) else "test") for k, (s, d, day) in enumerate(rows)]
    return spark.createDataFrame(full, "event_idx long, src long, dst long, day int, split string")


def test_neighbours(spark):
    inc = asof.incidence(edge_table(spark, [(0, 1, 1), (0, 1, 2), (2, 0, 4), (0, 1, 5)]))
    ask = lambda node, day, k: asof.recent_neighbors(inc, spark.createDataFrame([(0, node, day)], "query_id long, node long, day int"), k).collect()
    assert len(ask(0, 4, 20)) == 2
    assert {x.dt for x in ask(0, 6, 2)} == {1, 2}
    assert sum(x.dir for x in ask(0, 6, 3)) == 1
    assert ask(2, 1, 5) == []


def test_neighbours_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = sorted([(rnd.randrange(30), rnd.randrange(30), rnd.randrange(40)) for _ in range(400)], key=lambda x: x[2])
    inc = asof.incidence(edge_table(spark, rows))
    queries = [(k, rnd.randrange(30), rnd.randrange(45)) for k in range(60)]
    got = {}
    for x in asof.recent_neighbors(inc, spark.createDataFrame(queries, "query_id long, node long, day int"), 7).collect():
        got.setdefault(x.query_id, []).append((x.pos, x.other, x.dt, x.dir))
    for k, node, day in queries:
        seen = [y for s, d, t in rows if t < day for y in ([(d, t, 0)] if s == node else []) + ([(s, t, 1)] if d == node else [])]
        assert sorted(got.get(k, [])) == [(p + 1, o, day - t, r) for p, (o, t, r) in enumerate(seen[::-1][:7])]


def test_spread_keeps_short_histories_whole(spark):
    inc = asof.incidence(edge_table(spark, [(0, 1, k) for k in range(20)]))
    q = spark.createDataFrame([(0, 0, 5), (1, 0, 20)], "query_id long, node long, day int")
    got = asof.spread_neighbors(inc, q, 7)
    assert got.where("query_id = 0").count() == 5
    assert sorted(x.pos for x in got.where("query_id = 1").collect()) == [1, 2, 3, 4, 10, 15, 20]


def test_split_is_by_whole_days(spark):
    rnd = random.Random(1)
    flow = spark.createDataFrame([(f"a{rnd.randrange(20)}", f"b{rnd.randrange(20)}", f"2026-05-{rnd.randrange(28) + 1:02d} 00:00:00", rnd.choice("XY"), str(rnd.random())) for _ in range(500)] + [("a1", None, "2026-05-01 00:00:00", "X", "1"), ("a1", "b1", None, "X", "1"), ("a1", "b2", "2026-05-01 00:00:00", "X", "none")], "source_eoa string, target_eoa string, block_timestamp string, asset string, amount_human string").withColumn("block_timestamp", F.col("block_timestamp").cast("timestamp"))
    e = daily.numbered_edges(daily.daily_edges(flow, ("X", "Y")))
    rows = e.orderBy("event_idx").collect()
    assert [x.event_idx for x in rows] == list(range(len(rows)))
    assert [(x.day, x.s, x.d) for x in rows] == sorted((x.day, x.s, x.d) for x in rows)
    assert e.groupBy("day").agg(F.countDistinct("split").alias("n")).where("n > 1").isEmpty()
    assert sum(x.txn for x in rows) == 501


def score(spark, y, s):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, score double")


def test_auroc_and_ap(spark):
    assert metrics.auroc(score(spark, [1, 1, 0, 0], [0.9, 0.4, 0.5, 0.1])).first()[0] == 0.75
    assert metrics.auroc(score(spark, [1, 0], [0.5, 0.5])).first()[0] == 0.5
    assert metrics.auroc(score(spark, [1], [0.5])).first()[0] is None
    assert metrics.average_precision(score(spark, [1, 0], [0.5, 0.5])).first()[0] == 0.5
    assert metrics.average_precision(score(spark, [1, 1, 0, 0], [1, 0, 1, 0])).first()[0] == 0.5


def test_blocks_of_scores(spark):
    draw = random.Random(3)
    odd = [0.0, -0.0, 1.0, -1.0, 2.0, 5e-324, -5e-324, 2.2e-308, 1.8e308, -1.8e308, float("inf"), float("-inf"), float("nan"), 4095 / 4096, 1 - 2**-53, 1 + 2**-52]
    values = odd + [x * k for x in (draw.random() for _ in range(300)) for k in (1.0, -1.0, 1e-9, 1e6)] + [2.0**k for k in range(-40, 40)]
    df = score(spark, [draw.random() < 0.4 for _ in values], values).unionByName(score(spark, [1, 0, 1], [0.5] * 3))
    df = df.unionByName(spark.createDataFrame([(1, None), (0, None)], df.schema)).withColumn("k", F.lit(1))
    rows = df.select("score", metrics._block(F.col("score")).alias("b")).orderBy("score").collect()
    known = [r.b for r in rows if r.score is not None]
    assert known == sorted(known) and all(r.b is None for r in rows if r.score is None) and len(set(known)) > 1000
    for f, c in ((metrics.auroc, "auroc"), (metrics.average_precision, "ap"), (metrics.youden, "j"), (metrics.youden, "threshold")):
        assert f(df.drop("k")).first()[c] == pytest.approx(f(df, ["k"]).first()[c], rel=1e-12, nan_ok=True), c
    assert metrics.youden(score(spark, [1, 1], [0.5, 0.1])).first()["j"] is None


def test_batch_auroc(spark):
    rows = [(k // 2, 1, s) for k, s in enumerate([2.0, 2.0, 0.0, 0.0])] + [(k // 2, 0, 1.0) for k in range(4)]
    df = spark.createDataFrame(rows, "clock long, y int, score double")
    assert tuple(metrics.batch_auroc(df).first()) == (0.5, 2)


def test_youden_and_rates(spark):
    s = score(spark, [1, 1, 0, 0], [0.9, 0.6, 0.6, 0.1])
    t = metrics.youden(s)
    assert t.first()["j"] == 0.5
    assert tuple(metrics.fdr_npv(s, spark.createDataFrame([(0.6,)], "threshold double")).first()) == (pytest.approx(1 / 3), 1.0, 0.5)
    assert metrics.binary_auroc(0.7, 0.2) == 0.75


@pytest.mark.parametrize(("rows", "val_end", "mrr"), [([(0, 1, 0), (0, 2, 2), (0, 1, 4)], 2, 0.5), ([(0, 1, 0), (0, 2, 2), (0, 1, 4), (0, 2, 4)], 2, 1.0), ([(0, 1, 0), (0, 3, 4)], 1, 1 / 3)])
def test_recency_ranking(spark, rows, val_end, mrr):
    e = edge_table(spark, rows, val_end, val_end)
    r = ranking.recency_ranks(e, spark.createDataFrame([(4,)], "n_nodes long")).orderBy("event_idx").first()
    assert 1 / r["rank"] == pytest.approx(mrr)


def test_filtered_rank(spark):
    rows = lambda out: spark.createDataFrame([(0, s, k == 1, k in out) for k, s in enumerate([0.9, 0.5, 0.5, 0.5, 0.1])], "event_idx long, score double, is_target boolean, left_out boolean")
    assert ranking.filtered_ranks(rows([])).first()["rank"] == 3.0
    assert ranking.filtered_ranks(rows([0])).first()["rank"] == 2.0


def toy(spark):
    rnd = random.Random(5)
    return edge_table(spark, [(rnd.randrange(10), rnd.randrange(10), k // 30) for k in range(240)], 140, 170)


def test_batch_negatives(spark):
    e = toy(spark)
    pos = {(x.clock, x.src, x.dst) for x in sampling.batches(e, "test", 20).collect()}
    pads = {}
    for strategy in ("random", *sampling.STRATEGIES):
        rows = sampling.batch_negatives(e, strategy, 1, size=20).collect()
        assert len(rows) == 70 and len({(x.clock, x.k) for x in rows}) == 70
        assert not pos & {(x.clock, x.src, x.dst) for x in rows}
        pads[strategy] = [x.is_pad for x in rows]
        assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.batch_negatives(e, strategy, 1, size=20).collect()))
        drawn = [(x.clock, x.src, x.dst) for x in rows if not x.is_pad]
        assert strategy == "random" or len(set(drawn)) == len(drawn)
    assert not any(pads["random"])
    assert all(x.is_pad for x in sampling.batch_negatives(e, "inductive", 1, size=20).where("clock = 0").collect())
    assert sum(pads["recurring"]) <= sum(pads["inductive"])


def test_frozen_memory_never_knows_new_pairs(spark):
    e = edge_table(spark, [(0, 1, 0), (3, 9, 5), (3, 9, 6)], 1, 1).withColumn("clock", F.col("event_idx") - 1)
    q = spark.createDataFrame([(0, 3, 9, 0, 5), (1, 3, 9, 1, 6)], "query_id long, src long, dst long, clock long, day int")
    assert [x.score for x in memory.edgebank(e.where("clock < 0"), q, "clock").orderBy("query_id").collect()] == [0, 0]
    assert [x.score for x in memory.edgebank(e, q, "clock").orderBy("query_id").collect()] == [0, 1]


def transfers(spark, pairs):
    rows = [(a, b, f"2026-05-{k % 28 + 1:02d} 00:00:00", f"0xhash{k}", 1.0 + k) for k, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "from_address string, to_address string, ts string, transaction_hash string, value_eth double").withColumn("block_timestamp", F.col("ts").cast("timestamp")).drop("ts")


def test_snowball(spark):
    with pytest.raises(ValueError, match="no edges"):
        graph.snowball(transfers(spark, [("a", "b")]), "zzz")
    with pytest.warns(UserWarning, match="exhausted"):
        assert graph.snowball(transfers(spark, [("hub", f"leaf{k}") for k in range(100)]), "hub", 1000, 5).count() <= 6
    assert graph.snowball(transfers(spark, [("seed", f"n{k}") for k in range(50)]), "seed", 10).count() == 10
    t = transfers(spark, [("s", "a"), ("s", "b"), ("a", "b")])
    n = graph.snowball(t, "s", 3)
    assert n.count() == 3 and graph.induced(t, n).count() == 3
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert {x.address for x in graph.snowball(transfers(spark, [("s", "a"), ("s", None), ("a", "b")]), "s").collect()} == {"a", "b", "s"}


def test_pick_seeds(spark):
    t = transfers(spark, [("mid", f"x{k}") for k in range(3)] + [("hub", f"y{k}") for k in range(30)])
    assert [tuple(x) for x in graph.pick_seeds(t, 2, 10).collect()] == [("mid", 3)]


def test_components(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("q", "q")], "s string, d string")
    assert {tuple(x) for x in graph.components(e).collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x"), ("q", "q")}


def test_scalar_functions(spark):
    r = spark.range(1).select(logsumexp(F.array(F.lit(0.0), F.lit(0.0))).alias("a"), time_encoding(F.lit(0.0), 3).alias("b")).first()
    assert r.a == pytest.approx(math.log(2)) and r.b == [1, 1, 1]


def test_sources(spark, tmp_path):
    from chronoflow.sources import transfers as source

    raw = spark.createDataFrame([("2026-05-01 00:00:00", "h1", "a", "b", "1500000000000000000"), ("2026-06-01 00:00:00", "h2", "a", "b", "1"), ("2026-05-02 00:00:00", "h3", "a", None, "0")], "ts string, transaction_hash string, from_address string, to_address string, value_lossless string").withColumn("block_timestamp", F.col("ts").cast("timestamp"))
    rows = source.window_of(raw, "2026-05-01", "2026-06-01")
    assert [(x.transaction_hash, x.value_eth) for x in rows.collect()] == [("h1", 1.5)]
    path = str(tmp_path / "out")
    assert source.save(rows, path, {"seed": 1})["rows"] == 1
    assert source.reconciled(spark, path)["rows"] == 1
    with pytest.raises(Exception, match="(?i)exist"):
        source.save(rows, path)
    rows.createOrReplaceTempView("tx")
    assert source.run_query(spark, "SELECT count(*) AS n FROM tx").first().n == 1
    with pytest.raises(ValueError, match="would read"):
        source.run_query(spark, "SELECT * FROM tx", max_gb=-1)
    assert source.tables(spark).where("table_name = 'tx'").count() == 6


@pytest.mark.parametrize("strategy", ("random", "historical"))
@pytest.mark.parametrize("rows, filled", [([(0, 5, 1)] * 3, 0), ([(0, 5, 0), (0, 5, 1), (0, 6, 1), (0, 7, 1)], 0), ([(0, 5, 0), (0, 6, 1), (1, 5, 1)], 2)])
def test_batches_in_which_a_source_meets_all_targets(spark, strategy, rows, filled):
    """Slots to which nothing is allowed stay empty; the others are filled, and nothing ends the query."""
    ahead = sum(day == 0 for *_, day in rows)
    got = sampling.batch_negatives(edge_table(spark, rows, ahead, ahead), strategy, 7).collect()
    assert not {(x.src, x.dst) for x in got} & {(s, d) for s, d, day in rows if day == 1}
    assert len(got) == filled
