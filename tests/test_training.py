"""Training of graph networks: numerical gradients, the forward pass of the library, a single process, and learning."""

import dataclasses
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoflow.operators import asof, graphnet as net, training

RNG = random.Random(11)
MEMORY = net.Shape(dim=4, edge=3, heads=2, layers=2, stack=1, k=4, k_inner=2, head="bilinear", pair=2, memory=True)
PLAIN = net.Shape(dim=4, edge=3, heads=2, layers=2, k=3, memory=False)
ROWS = [(i, RNG.randrange(6), RNG.randrange(6, 11), day, "train" if day < 7 else "val", [RNG.random(), RNG.random()]) for i, day in enumerate(sorted(RNG.randrange(9) for _ in range(60)))]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(ROWS, "event_idx long, src long, dst long, day int, split string, feat array<double>").cache()


@pytest.fixture(scope="module")
def n_nodes(spark):
    return spark.createDataFrame([(11,)], "n_nodes long")


def random_tree(r, shape, level=0):
    if level == shape.layers:
        return r.normal(size=training.leaf_width(shape)) * np.r_[np.ones(max(training.leaf_width(shape) - 1, 0)), [1.0] if shape.memory else []] if shape.memory else np.zeros(0)
    own = np.r_[r.normal(size=training.leaf_width(shape) - 1), [float(r.random() < 0.7)]] if shape.memory else random_tree(r, shape, level + 1)
    k, out = training._k(shape, level), [own]
    for j in range(k):
        size = 2 + shape.edge + training.width(shape, level + 1)
        there = j < r.integers(0, k + 1)
        out.append(np.r_[1.0, r.normal(size=shape.edge), abs(r.normal()) * 3, random_tree(r, shape, level + 1)] if there else np.zeros(size))
    # Places are filled from the first.
    slots = sorted(out[1:], key=lambda x: -x[0])
    return np.concatenate([out[0], *slots])


PLANS = [training.Plan(), training.Plan(loss="ce", negatives=2), training.Plan(loss="ce", hard=2, beta=0.7), training.Plan(loss="ce", hard=1, beta=0.5, margin=0.8)]


@pytest.mark.parametrize("shape", (MEMORY, PLAIN), ids=("memory", "plain"))
@pytest.mark.parametrize("plan", PLANS, ids=("bce", "ce", "two terms", "hinge"))
def test_gradients_equal_differences(shape, plan):
    r = np.random.default_rng(3)
    n, pairs = 3, 1 + plan.negatives + plan.hard
    x = np.stack([random_tree(r, shape) for _ in range(n * pairs * 2)]).reshape(n, pairs, 2, -1)
    y, pair = r.normal(size=n) * 2, r.normal(size=(n, pairs, shape.pair)) if shape.pair else None
    w = net.random_weights(shape, 1)
    value = lambda v: sum(training.gradients(v, shape, plan, x, y, pair)[:2])
    grad = training.gradients(w, shape, plan, x, y, pair)[2]
    assert set(grad) == set(w)
    for name, a in w.items():
        for at in {tuple(r.integers(0, s) for s in a.shape) for _ in range(4)}:
            near = []
            for sign in (1, -1):
                v = {k: b.copy() for k, b in w.items()}
                v[name][at] += sign * 1e-6
                near.append(value(v))
            assert grad[name][at] == pytest.approx((near[0] - near[1]) / 2e-6, rel=2e-4, abs=2e-6), name


@pytest.mark.parametrize("shape", (net.Shape(dim=4, edge=3, heads=2, layers=2, stack=1, k=4, k_inner=2, memory=True), PLAIN), ids=("memory", "plain"))
def test_arrays_embed_as_the_network_does(edges, shape):
    w, inc = net.random_weights(shape, 2), asof.incidence(edges, ("feat",))
    log = net.memory_log(edges, w, shape) if shape.memory else None
    asked = edges.where("day > 2").select(F.col("src").alias("node"), "day")
    inputs = training.memory_inputs(edges, log, shape) if shape.memory else None
    rows = training.trees(inc, asked, shape, inputs).collect()
    x = np.array([r["x"] for r in rows])
    assert x.shape == (len(rows), training.width(shape))
    h = training.Pass(w, shape).embed(x)[0]
    other = {(r["node"], r["day"]): r["h"] for r in net.embeddings(inc, asked, w, shape, log).collect()}
    assert len(other) == len(rows)
    for r, z in zip(rows, h, strict=True):
        assert z == pytest.approx(other[r["node"], r["day"]])


def test_steps_equal_a_single_process(edges, n_nodes):
    plan = training.Plan(epochs=1, step=15, rate=0.01, loss="ce", negatives=2, train_sample=20)
    inc = asof.incidence(edges, ("feat",))
    table = training.examples(edges, inc, training.negatives(edges, n_nodes, plan, 0), PLAIN, plan).orderBy("event_idx").collect()
    w, adam = net.random_weights(PLAIN, plan.seed), training.Adam(plan.rate)
    for step in sorted({r["step"] for r in table}):
        rows = [r for r in table if r["step"] == step]
        x = np.array([r["x"] for r in rows]).reshape(len(rows), 3, 2, -1)
        grad = training.gradients(w, PLAIN, plan, x, np.array([r["y"] for r in rows]))[2]
        w = adam.move(w, {k: g / len(rows) for k, g in grad.items()})
    got = training.train(edges, n_nodes, PLAIN, plan)
    assert len(got.history) == 1 and set(got.weights) == set(w)
    for k in w:
        assert got.weights[k] == pytest.approx(w[k], abs=1e-9)


def test_a_step_is_one_stage(edges, n_nodes):
    plan = training.Plan(epochs=1, step=15, rate=0.01, loss="ce", negatives=2)
    rows = training.examples(edges, asof.incidence(edges, ("feat",)), training.negatives(edges, n_nodes, plan, 0), PLAIN, plan)
    table, w, sc = training.Steps(rows, plan.tasks), net.random_weights(PLAIN, 1), edges.sparkSession.sparkContext
    sc.setJobGroup("one step", "")
    n, link, huber, grad = training.step_gradient(table.rows(table.steps[0]), w, PLAIN, plan)
    jobs = sc.statusTracker().getJobIdsForGroup("one step")
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs) == 1
    levels = training.step_gradient(table.rows(table.steps[0]), w, PLAIN, dataclasses.replace(plan, tasks=training.BRANCHES + 1))
    assert levels[:3] == pytest.approx((n, link, huber)) and set(levels[3]) == set(grad)
    for k, g in grad.items():
        assert levels[3][k] == pytest.approx(g)


def test_memory_network_learns_and_stops(edges, n_nodes, tmp_path):
    shape = net.Shape(dim=4, edge=3, heads=2, layers=1, k=4, head="bilinear", memory=True)
    plan = training.Plan(epochs=3, patience=1, step=30, rate=0.02, select="combo", probe_events=5, probe_candidates=4, train_sample=20)
    got = training.train(edges, n_nodes, shape, plan, folder=f"file://{tmp_path}")
    h = got.history
    assert h[-1]["train_loss"] < h[0]["train_loss"] or len(h) < 3
    values = [training.chosen(x, "combo") for x in h]
    best = max(range(len(h)), key=lambda k: (values[k], -k))
    assert len(h) == min(3, best + 2)
    kept = net.load_weights(edges.sparkSession, f"file://{tmp_path}/epoch={best}")
    assert all(np.allclose(kept[k], got.weights[k]) for k in kept)
    assert not np.allclose(got.weights["gru.x"], net.random_weights(shape, 0)["gru.x"])


def test_a_step_opens_its_own_files_and_gives_the_same(edges, n_nodes):
    plan = training.Plan(epochs=1, step=15, rate=0.01, loss="ce", negatives=2)
    rows = training.examples(edges, asof.incidence(edges, ("feat",)), training.negatives(edges, n_nodes, plan, 0), PLAIN, plan)
    table, w = training.Steps(rows, plan.tasks), net.random_weights(PLAIN, 1)
    seen = 0
    for step in table.steps:
        mine, planned = training.step_sums(table, step, w, PLAIN, plan), training.step_gradient(table.rows(step), w, PLAIN, plan)
        assert mine[:3] == pytest.approx(planned[:3]) and set(mine[3]) == set(w)
        for k, g in planned[3].items():
            assert mine[3][k] == pytest.approx(g)
        seen += mine[0]
    assert seen == edges.where("split = 'train'").count()
    assert training.step_sums(table, max(table.steps) + 1, w, PLAIN, plan) == (0, 0.0, 0.0, {})


def test_a_history_may_begin_before_training(edges, n_nodes):
    plan = training.Plan(epochs=1, step=30, rate=0.01, train_sample=20)
    first, then = training.train(edges, n_nodes, PLAIN, plan, start=True).history
    inc, held = asof.incidence(edges, ("feat",)), training.held_pairs(edges, n_nodes, plan)
    network = training.judged(training.pair_logits(edges, inc, held, net.random_weights(PLAIN, plan.seed), PLAIN), plan)
    assert (first["epoch"], then["epoch"]) == (-1, 0) and {k: first[k] for k in network} == pytest.approx(network)
