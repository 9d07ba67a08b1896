"""Fitted scorers against their definitions: Newton's method in numpy, and a forward pass by the network's weights."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoflow.operators import scorer
from chronoflow.streaming import replay

RNG = np.random.default_rng(9)
X = RNG.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 3, 1]
Y = (1 / (1 + np.exp(-(X @ [1.0, -0.3, 2.0] - 1))) > RNG.random(300)).astype(int)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*map(float, x), int(y), k) for k, (x, y) in enumerate(zip(X, Y, strict=True))], "a double, b double, c double, y int, k int")


def test_logistic_equals_newton(rows):
    z = np.c_[(X - X.mean(0)) / X.std(0, ddof=1), np.ones(len(X))]
    w = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]), z.T @ (Y - p))
    model = scorer.fit(rows, ["a", "b", "c"], steps=500)
    got = [r.score for r in scorer.scored(model, rows).orderBy("k").collect()]
    assert got == pytest.approx(1 / (1 + np.exp(-z @ w)), abs=2e-3)
    assert [v for _, v in scorer.importance(model, ["a", "b", "c"])] == pytest.approx(w[:3], abs=1e-2)


def test_logistic_steps_go_over_distinct_rows(spark, rows, monkeypatch):
    names = ["a", "b", "c"]
    many = rows.where("k % 3 > 0").unionByName(rows.crossJoin(spark.range(40).select("id")).drop("id")).drop("k")
    small = scorer.distinct_rows(many, names)
    assert small.count() == len(X) and small.agg(F.sum("n_rows")).first()[0] == many.count()
    seen = []
    ask = scorer.LogisticRegression.fit
    monkeypatch.setattr(scorer.LogisticRegression, "fit", lambda self, df: seen.append(df.count()) or ask(self, df))
    model = scorer.fit(many, names, steps=500)
    assert seen == [len(X)]
    scaled = model.transform(many)
    plain = ask(scorer.LogisticRegression(featuresCol="x", labelCol="y", maxIter=500), scaled.select("x", "y"))
    assert list(model.stages[-1].coefficients) == pytest.approx(list(plain.coefficients), abs=2e-4)


def test_network_equals_its_weights_and_fits_better(rows):
    z = (X - X.mean(0)) / X.std(0, ddof=1)
    model = scorer.fit(rows, ["a", "b", "c"], (6, 5), seed=2)
    w, layers, h = model.stages[-1].weights.toArray(), [3, 6, 5, 2], z
    for k, (a, b) in enumerate(zip(layers[:-1], layers[1:], strict=True)):
        m, w = w[: a * b].reshape(b, a, order="F"), w[a * b :]
        h, w = h @ m.T + w[:b], w[b:]
        h = 1 / (1 + np.exp(-h)) if k < 2 else np.exp(h) / np.exp(h).sum(1, keepdims=True)
    score = [r.score for r in scorer.scored(model, rows).orderBy("k").collect()]
    assert score == pytest.approx(h[:, 1], abs=1e-6)
    loss = lambda m: -np.mean([np.log(max(r.score if r.y else 1 - r.score, 1e-9)) for r in scorer.scored(m, rows).collect()])
    assert loss(model) < loss(scorer.fit(rows, ["a", "b", "c"]))


def test_network_steps_go_over_distinct_rows(spark, rows, monkeypatch):
    names, seen = ["a", "b", "c"], []
    many = rows.where("k % 3 > 0").unionByName(rows.crossJoin(spark.range(40).select("id")).drop("id")).drop("k")
    ask = scorer.MultilayerPerceptronClassifier.fit
    monkeypatch.setattr(scorer.MultilayerPerceptronClassifier, "fit", lambda self, df: seen.append(df.count()) or ask(self, df))
    model = scorer.fit(many, names, (6, 5), seed=2)
    assert max(seen) <= 300
    loss = lambda m: many.sparkSession.createDataFrame(m.transform(many).select("y", "probability").toPandas().assign(p=lambda x: [float(p[int(y)]) for p, y in zip(x.probability, x.y)])[["p"]]).agg(F.avg(-F.log("p"))).first()[0]
    scaled = model.transform(many)
    plain = ask(scorer.MultilayerPerceptronClassifier(featuresCol="x", labelCol="y", layers=[3, 6, 5, 2], seed=2, maxIter=100), scaled.select("x", "y"))
    whole = scorer.PipelineModel(stages=[*model.stages[:-1], plain])
    assert loss(model) < loss(whole) + 1e-2


def test_network_gradient_is_that_of_its_loss():
    layers, n, w = [3, 4, 2], RNG.integers(1, 9, len(X)).astype(float), RNG.normal(size=26)
    loss, g = scorer._network(X, Y, n, layers, w)
    for k in range(len(w)):
        step = np.eye(len(w))[k] * 1e-5
        up, down = (scorer._network(X, Y, n, layers, w + s)[0] for s in (step, -step))
        assert (up - down) / 2e-5 == pytest.approx(g[k], rel=1e-4, abs=1e-3)


def test_days_are_counted_once_the_watermark_has_passed(spark, tmp_path):
    for name, days in (("a", (1, 1, 2)), ("b", (2, 4, 5))):
        spark.createDataFrame([(f"2024-01-0{d} 10:00:00",) for d in days], "ts string").select(F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in/{name}")
    stream = spark.readStream.schema("ts timestamp").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = replay.daily_counts(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination()
    got = {str(r.dt): r.n for r in spark.read.schema("dt date, n long").parquet(f"{tmp_path}/out").collect()}
    assert got == {"2024-01-01": 2, "2024-01-02": 2}


@pytest.mark.parametrize("hidden", ((), (4,)))
def test_counted_rows_are_as_many(spark, rows, hidden):
    from chronoflow.operators import metrics

    names = ["a", "b", "c"]
    many = rows.where("k % 3 > 0").unionByName(rows.where("k % 2 = 0").crossJoin(spark.range(30).select("id")).drop("id")).drop("k")
    counted = scorer.distinct_rows(many, names)
    one, other = scorer.fit(many, names, hidden, 3), scorer.fit(counted, names, hidden, 3)
    for c in ("mean", "std"):
        assert list(getattr(other.stages[1], c)) == pytest.approx(list(getattr(one.stages[1], c)))
    area = lambda model, df: metrics.auroc(scorer.scored(model, df)).first()[0]
    assert area(other, counted) == pytest.approx(area(other, many), abs=1e-12)
    if hidden:
        return  # a hundred steps of a network end elsewhere after the last digits of a scale
    assert area(other, counted) == pytest.approx(area(one, many), abs=1e-4)
    score = lambda model: [r.score for r in scorer.scored(model, rows).orderBy("k").collect()]
    assert score(other) == pytest.approx(score(one), abs=1e-4)
