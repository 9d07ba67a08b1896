"""Training of the temporal graph networks of ``graphnet`` by data-parallel gradients.

What a loss needs of an edge, its negatives and their neighbourhoods does not hang on the weights, so it is laid out once
an epoch: each (node, day) as one array of fixed length, its neighbours and theirs inside, each pair of nodes as two of
them. A step reads the files of a stretch of consecutive edges, laid out by step and task; every task adds up the gradients
of its rows and emits their sums, as large as the model (beyond ``BRANCHES`` tasks, summed in two levels), and the driver
moves the weights by Adam. Steps follow each other, so a step is a job that plans and lists nothing. Nothing that the driver
holds grows with the graph.

Memory is refreshed at the start of an epoch with the weights of that moment. In a row a node's state is not a number but
the input of its last step, so gradients reach the recurrent unit through that step and stop there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Window as W, functions as F

from chronoflow.functions.hashing import hash_key
from chronoflow.operators import graphnet as net, metrics, sampling
from chronoflow.operators.asof import incidence, recent_neighbors
from chronoflow.operators.graphnet import Shape
from chronoflow.operators.scorer import labelled
from chronoflow.sources.shared import cut, cut_folder, drop, drop_folder

Weights = dict[str, np.ndarray]
BRANCHES = 32  # partial sums of gradients per weight
DECAY = (0.9, 0.999)


@dataclass(frozen=True)
class Plan:
    """``loss``: bce, or ce, the cross-entropy of a positive against its negatives. With ``hard`` negatives of the
    source's own past a second term stands beside the first, times ``beta``: cross-entropy again, or with ``margin`` a hinge.
    ``amount`` weighs the Huber loss of the amount. A step is ``step`` consecutive edges in ``tasks`` tasks. ``select``: ap, mrr or combo of the validation span."""

    epochs: int = 50
    patience: int = 5
    step: int = 200
    tasks: int = 4
    rate: float = 1e-4
    loss: str = "bce"
    negatives: int = 1
    hard: int = 0
    beta: float = 1.0
    margin: float = 0.0
    amount: float = 1.0
    select: str = "ap"
    probe_events: int = 500
    probe_candidates: int = 100
    train_sample: int = 3000
    seed: int = 0


@dataclass
class Fitted:
    weights: Weights
    history: list[dict] = field(default_factory=list)


# Layout of a row


def leaf_width(shape: Shape) -> int:
    """Own state, mean message, time since the step before, and whether there was a step; nothing without memory."""
    return 2 * shape.dim + shape.edge + 2 if shape.memory else 0


def width(shape: Shape, level: int = 0) -> int:
    """The length of a node's array: itself, then a place for each neighbour: present, edge, time, the neighbour."""
    if level == shape.layers:
        return leaf_width(shape)
    own = leaf_width(shape) if shape.memory else width(shape, level + 1)
    return own + _k(shape, level) * (2 + shape.edge + width(shape, level + 1))


def _k(shape: Shape, level: int) -> int:
    return shape.k_inner if level and shape.k_inner else shape.k


def memory_inputs(edges: DataFrame, log: DataFrame, shape: Shape) -> DataFrame:
    """What each step in a memory log was made of: node, clock, and x, the node's array. Edges are (src, dst, feat, day)."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other"), F.lit(1.0).alias("out")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other"), F.lit(0.0).alias("out"))))
    m = edges.select("feat", F.col("day").cast("int").alias("now"), ends.alias("e")).select("feat", "now", "e.*")
    state = net.memory_at(log, m.select(F.col("other").alias("node"), "now"), shape.dim).select(F.col("node").alias("other"), "now", F.col("h").alias("o"))
    m = m.join(state, ["other", "now"]).select("node", "now", F.concat("o", "feat", F.array("out")).alias("m"))
    m = m.groupBy("node", "now").agg(F.array(*[F.avg(F.col("m")[i]) for i in range(shape.dim + shape.edge)]).alias("m"))
    before = W.partitionBy("node").orderBy("clock")
    own = log.select("node", "clock", F.lag("h").over(before).alias("h"), (F.col("clock") - F.coalesce(F.lag("clock").over(before), F.lit(0))).cast("double").alias("dt"))
    zero = net._vector(np.zeros(shape.dim))
    x = F.concat(F.coalesce("h", zero), "m", F.array(F.col("dt"), F.lit(1.0)))
    return own.join(m.withColumnRenamed("now", "clock"), ["node", "clock"]).select("node", "clock", x.alias("x"))


def trees(inc: DataFrame, asked: DataFrame, shape: Shape, inputs: DataFrame | None = None) -> DataFrame:
    """node, day, x for each distinct (node, day) of ``asked``: its array. ``inputs``: those of the memory."""
    now = F.col("day") if shape.memory else F.lit(0)
    want = [cut(asked.select(F.col("node").cast("long"), F.col("day").cast("int"), now.cast("int").alias("now")).distinct())]
    found = []
    for level in range(shape.layers):
        found.append(cut(recent_neighbors(inc, want[-1].withColumn("query_id", F.struct("node", "day", "now")), _k(shape, level))))
        below = found[-1].select(F.col("other").cast("long").alias("node"), F.col("eday").cast("int").alias("day"), "query_id.now")
        if shape.memory or level < shape.layers - 1:
            want.append(cut((below if shape.memory else below.unionByName(want[-1])).distinct()))

    def leaves(rows: DataFrame) -> DataFrame:
        if not shape.memory:
            return rows.withColumn("x", F.array().cast("array<double>"))
        ask = rows.select("node", "now").distinct().withColumn("x", F.lit(None).cast("array<double>")).withColumn("ask", F.lit(True))
        both = inputs.select("node", F.col("clock").alias("now"), "x").unionByName(ask, allowMissingColumns=True)
        last = F.last("x", ignorenulls=True).over(W.partitionBy("node").orderBy("now").rangeBetween(W.unboundedPreceding, -1))
        return rows.join(both.withColumn("x", F.coalesce(last, net._vector(np.zeros(leaf_width(shape))))).where("ask").drop("ask"), ["node", "now"])

    x = leaves(want[-1])
    for level in reversed(range(shape.layers)):
        same = not shape.memory and level == shape.layers - 1  # every leaf is the same, so none is looked up
        states = x.select(F.col("node").alias("other"), F.col("day").alias("eday"), "now", "x")
        place = F.concat(F.array(F.lit(1.0)), "feat", F.array((1 - F.col("dir")).cast("double"), F.col("dt").cast("double")), "x")
        near = found[level].withColumn("now", F.col("query_id.now"))
        near = (near.withColumn("x", F.array().cast("array<double>")) if same else near.join(states, ["other", "eday", "now"])).select("query_id", F.struct("pos", place.alias("x")).alias("x"))
        near = near.groupBy("query_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list("x")), lambda y: y["x"])).alias("near"))
        own = (leaves(want[level]) if shape.memory or same else want[level].join(x, ["node", "day", "now"])).withColumnRenamed("x", "own")
        size = _k(shape, level) * (2 + shape.edge + width(shape, level + 1))
        near = own.withColumn("query_id", F.struct("node", "day", "now")).join(near, "query_id", "left")
        some = F.coalesce("near", F.array().cast("array<double>"))
        x = cut(near.select("node", "day", "now", F.concat("own", some, F.array_repeat(F.lit(0.0), size - F.size(some))).alias("x")))
    drop(*found, *want)
    out = x.select("node", "day", "x")
    out.__dict__["_cut_folder"] = x.__dict__["_cut_folder"]
    return out


# Algebra: forward with what the way back needs, and the way back


class Pass:
    """A forward pass over one batch; ``back`` functions run in reverse and add to ``grad``."""

    def __init__(self, w: Weights, shape: Shape):
        self.w, self.shape, self.grad = w, shape, {k: np.zeros_like(v, float) for k, v in w.items()}

    def dense(self, name: str, x: np.ndarray):
        def back(g):
            flat = g.reshape(-1, g.shape[-1])
            self.grad[name] += x.reshape(-1, x.shape[-1]).T @ flat
            self.grad[f"{name}.b"] += flat.sum(0)
            return g @ self.w[name].T

        return x @ self.w[name] + self.w[f"{name}.b"], back

    def mlp(self, name: str, x: np.ndarray):
        y, one = self.dense(f"{name}1", x)
        z, two = self.dense(f"{name}2", np.maximum(y, 0))
        return z, lambda g: one(two(g) * (y > 0))

    def times(self, dt: np.ndarray):
        at = dt[..., None] * self.w["time"] + self.w["time.b"]

        def back(g):
            s = -np.sin(at) * g
            self.grad["time"] += (s * dt[..., None]).reshape(-1, s.shape[-1]).sum(0)
            self.grad["time.b"] += s.reshape(-1, s.shape[-1]).sum(0)

        return np.cos(at), back

    def attend(self, block: str, own: np.ndarray, around: np.ndarray, mask: np.ndarray):
        heads = self.shape.heads
        split = lambda x: x.reshape(*x.shape[:-1], heads, -1)
        (q, bq), (k, bk), (v, bv) = self.dense(f"{block}.q", own), self.dense(f"{block}.k", around), self.dense(f"{block}.v", around)
        q, k, v = split(q), split(k), split(v)
        scale = np.sqrt(q.shape[-1])
        s = np.where(mask[:, None, :], np.einsum("nhp,nkhp->nhk", q, k) / scale, -1e30)
        a = np.exp(s - s.max(-1, keepdims=True)) * mask[:, None, :]
        a /= np.maximum(a.sum(-1, keepdims=True), 1e-300)
        out, bo = self.dense(f"{block}.o", np.einsum("nhk,nkhp->nhp", a, v).reshape(own.shape))
        some = mask.any(1)[:, None]
        y, merge = self.mlp(f"{block}.merge", np.concatenate([np.where(some, out, 0.0), own], 1))

        def back(g):
            g = merge(g)
            g_own = g[:, own.shape[1] :]
            g_ctx = split(bo(np.where(some, g[:, : own.shape[1]], 0.0)))
            g_a, g_v = np.einsum("nhp,nkhp->nhk", g_ctx, v), np.einsum("nhk,nhp->nkhp", a, g_ctx)
            g_s = a * (g_a - (a * g_a).sum(-1, keepdims=True)) / scale
            g_q, g_k = np.einsum("nhk,nkhp->nhp", g_s, k), np.einsum("nhk,nhp->nkhp", g_s, q)
            return g_own + bq(g_q.reshape(own.shape)), bk(g_k.reshape(*around.shape[:2], -1)) + bv(g_v.reshape(*around.shape[:2], -1))

        return y, back

    def gru(self, x: np.ndarray, h: np.ndarray):
        (gx, bx), (gh, bh) = self.dense("gru.x", x), self.dense("gru.h", h)
        (xr, xz, xn), (hr, hz, hn) = np.split(gx, 3, 1), np.split(gh, 3, 1)
        gate = lambda y: 1 / (1 + np.exp(-y))
        r, z = gate(xr + hr), gate(xz + hz)
        n = np.tanh(xn + r * hn)

        def back(g):
            g_n = g * (1 - z) * (1 - n * n)
            g_z = g * (h - n) * z * (1 - z)
            g_r = g_n * hn * r * (1 - r)
            bh(np.concatenate([g_r, g_z, g_n * r], 1))
            return bx(np.concatenate([g_r, g_z, g_n], 1))

        return (1 - z) * n + z * h, back

    def leaf(self, x: np.ndarray):
        d = self.shape.dim
        if not self.shape.memory:
            def start(g):
                self.grad["start"] += g.sum(0)

            return np.broadcast_to(self.w["start"], (len(x), d)), start
        h, m, dt, on = x[:, :d], x[:, d : 2 * d + self.shape.edge], x[:, -2], x[:, -1:] > 0
        code, times = self.times(dt)
        y, step = self.gru(np.concatenate([h, m[:, :d], code, m[:, d:]], 1), h)

        def back(g):
            times(step(np.where(on, g, 0.0))[:, 2 * d : 3 * d])

        return np.where(on, y, 0.0), back

    def embed(self, x: np.ndarray, level: int = 0):
        """The embeddings of nodes from their arrays."""
        shape, d = self.shape, self.shape.dim
        if level == shape.layers:
            return self.leaf(x)
        first = leaf_width(shape) if shape.memory else width(shape, level + 1)
        own, b_own = self.leaf(x[:, :first]) if shape.memory else self.embed(x[:, :first], level + 1)
        slots = x[:, first:].reshape(len(x), _k(shape, level), -1)
        mask = slots[..., 0] > 0
        used = max(int(mask.sum(1).max(initial=0)), 1)
        slots, mask = slots[:, :used], mask[:, :used]
        below, b_below = self.embed(slots[mask][:, 2 + shape.edge :], level + 1)
        state = np.zeros((*mask.shape, d))
        state[mask] = below
        code, b_time = self.times(slots[..., 1 + shape.edge])
        around = np.concatenate([state, slots[..., 1 : 1 + shape.edge], code], 2)
        h, b_hop = self.attend(f"hop{level + 1}", own, around, mask)
        more = []
        for j in range(shape.stack if level == 0 else 0):
            y, b = self.attend(f"stack{j + 1}", h, around, mask)
            h = h + y
            more.append(b)

        def back(g):
            g_around = np.zeros_like(around)
            for b in reversed(more):
                g_h, g_x = b(g)
                g, g_around = g + g_h, g_around + g_x
            g_own, g_x = b_hop(g)
            g_around += g_x
            b_time(np.where(mask[..., None], g_around[..., d + shape.edge :], 0.0))
            b_below(g_around[..., :d][mask])
            b_own(g_own)

        return h, back

    def link(self, zs: np.ndarray, zd: np.ndarray, pair: np.ndarray | None):
        if self.shape.head == "bilinear":
            u, v = zs @ self.w["link.u"], zd @ self.w["link.v"]
            logit, scale = (u * v).sum(1) / np.sqrt(self.shape.dim), np.sqrt(self.shape.dim)
            more = self.mlp("pair", pair) if self.shape.pair else None

            def back(g):
                g_u, g_v = g[:, None] * v / scale, g[:, None] * u / scale
                self.grad["link.u"] += zs.T @ g_u
                self.grad["link.v"] += zd.T @ g_v
                if more:
                    more[1](g[:, None])
                return g_u @ self.w["link.u"].T, g_v @ self.w["link.v"].T

            return logit + (more[0][:, 0] if more else 0.0), back
        d = self.shape.dim
        y, b = self.mlp("link", np.concatenate([zs, zd] + ([pair] if self.shape.pair else []), 1))

        def back(g):
            g = b(g[:, None])
            return g[:, :d], g[:, d : 2 * d]

        return y[:, 0], back


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _bce(z, y):
    return np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z)))


def _softmax_loss(pos: np.ndarray, neg: np.ndarray):
    """Cross-entropy of each positive against its row of negatives, and its slopes."""
    z = np.concatenate([pos[:, None], neg], 1)
    top = z.max(1, keepdims=True)
    e = np.exp(z - top)
    p = e / e.sum(1, keepdims=True)
    return np.log(e.sum(1)) + top[:, 0] - pos, p[:, 0] - 1, p[:, 1:]


def link_loss(plan: Plan, pos: np.ndarray, neg: np.ndarray):
    """The loss of each positive [n] with its negatives [n, k], uniform ones first, and its slopes."""
    easy, hard = neg[:, : plan.negatives], neg[:, plan.negatives :]
    g_neg = np.zeros_like(neg)
    if plan.loss == "bce":
        g_neg[:, : plan.negatives] = _sigmoid(easy) / easy.shape[1] / 2
        loss, g_pos = (_bce(pos, 1.0) + _bce(easy, 0.0).mean(1)) / 2, (_sigmoid(pos) - 1) / 2
    else:
        loss, g_pos, g_neg[:, : plan.negatives] = _softmax_loss(pos, easy)
    if plan.hard and plan.margin:
        gap = plan.margin - (pos[:, None] - hard)
        on = (gap > 0) * (plan.beta / hard.shape[1])
        return loss + (np.maximum(gap, 0) * plan.beta).mean(1), g_pos - on.sum(1), np.concatenate([g_neg[:, : plan.negatives], on], 1)
    if plan.hard:
        more, g, g_hard = _softmax_loss(pos, hard)
        g_neg[:, plan.negatives :] = plan.beta * g_hard
        return loss + plan.beta * more, g_pos + plan.beta * g, g_neg
    return loss, g_pos, g_neg


def gradients(w: Weights, shape: Shape, plan: Plan, x: np.ndarray, y: np.ndarray, pair: np.ndarray | None = None) -> tuple[float, float, Weights]:
    """Sums over rows of the link loss, of the amount's Huber loss, and of the gradient. x [n, pairs, 2, width]: the
    arrays of the true pair and of the negative ones; pair [n, pairs, features of a pair]."""
    n, pairs = x.shape[:2]
    run = Pass(w, shape)
    # Rows are told apart by their bytes: comparing them number by number took longer than the network.
    flat = np.ascontiguousarray(x.reshape(n * pairs * 2, -1), float)
    found: dict[bytes, int] = {}
    where = np.array([found.setdefault(row.tobytes(), len(found)) for row in flat])
    flat = flat[np.unique(where, return_index=True)[1]]
    h, b_embed = run.embed(flat)
    z = h[where].reshape(n * pairs, 2, -1)
    logit, b_link = run.link(z[:, 0], z[:, 1], None if pair is None else pair.reshape(n * pairs, -1))
    logit = logit.reshape(n, pairs)
    true = z.reshape(n, pairs, 2, -1)[:, 0]
    guess, b_amount = run.mlp("amount", true.reshape(n, -1))
    gap = guess[:, 0] - y
    huber = np.where(np.abs(gap) <= 1, 0.5 * gap * gap, np.abs(gap) - 0.5)
    loss, g_pos, g_neg = link_loss(plan, logit[:, 0], logit[:, 1:])
    g_z = np.stack(b_link(np.concatenate([g_pos[:, None], g_neg], 1).ravel()), 1).reshape(n, pairs, 2, -1)
    g_z[:, 0] += b_amount(plan.amount * np.clip(gap, -1, 1)[:, None]).reshape(n, 2, -1)
    g_h = np.zeros_like(h)
    np.add.at(g_h, where, g_z.reshape(n * pairs * 2, -1))
    b_embed(g_h)
    return float(loss.sum()), float(plan.amount * huber.sum()), run.grad


# The tables of an epoch


def negatives(edges: DataFrame, n_nodes: DataFrame, plan: Plan, epoch: int) -> DataFrame:
    """event_idx, k, src, dst: the negatives of training edges, drawn anew each epoch: uniform targets, then pairs of the
    past (half of them of the same source)."""
    train = edges.where("split = 'train'").select("event_idx", "src", "day")
    drawn = []
    for k in range(plan.negatives):
        u = sampling.uniform_targets(edges, n_nodes, plan.seed, f"train-{epoch}-{k}", train)
        drawn.append(u.select("event_idx", F.lit(k).alias("k"), "src", F.col("neg_dst").alias("dst")))
    for k in range(plan.hard):
        m = sampling.mixture(edges, n_nodes, plan.seed + 7919 * (epoch * plan.hard + k + 1), hard=1.0, popular=0.0, novel=0.0)
        drawn.append(m.select("event_idx", F.lit(plan.negatives + k).alias("k"), "src", "dst").join(train.select("event_idx"), "event_idx", "left_semi"))
    out = drawn[0]
    for d in drawn[1:]:
        out = out.unionByName(d)
    return out


def examples(edges: DataFrame, inc: DataFrame, drawn: DataFrame, shape: Shape, plan: Plan, inputs: DataFrame | None = None, pair_features=None) -> DataFrame:
    """step, part, event_idx, y, x, pair of each training edge with all its negatives; ``y`` is the edge's first feature.
    ``pair_features``: rows (query_id, s, d, day) -> query_id and an array ``pair``. An edge to which a negative is
    lacking has none that it could have, and is left out. Arrays are shuffled once, by step and the
    task of the step: each node of an edge is a row at its place, a negative's source only where it is not the edge's own."""
    n = 1 + plan.negatives + plan.hard
    train = edges.where("split = 'train'").select("event_idx", "src", "dst", "day", F.col("feat")[0].alias("y"))
    mine = train.select("event_idx", "day", F.col("src").alias("own"))
    none = F.lit(None)
    pairs = train.select("event_idx", F.lit(-1).alias("k"), "src", "dst", "day", "y", none.cast("long").alias("own"))
    pairs = cut(pairs.unionByName(drawn.join(mine, "event_idx").select("event_idx", "k", "src", "dst", "day", none.cast("double").alias("y"), "own")))
    at = lambda c: F.col("k") * 2 + c
    source = F.when(~F.col("src").eqNullSafe(F.col("own")), F.struct(at(2).alias("at"), F.col("src").alias("node")))
    ends = F.filter(F.array(source, F.struct(at(3).alias("at"), F.col("dst").alias("node"))), lambda x: x.isNotNull())
    ends = pairs.select("event_idx", F.col("day").cast("int").alias("day"), "y", F.explode(ends).alias("e")).select("event_idx", "day", "y", "e.at", F.col("e.node").cast("long").alias("node"))
    t = trees(inc, ends.select("node", "day"), shape, inputs)
    p = ends.join(t, ["node", "day"]).select("event_idx", "at", "y", "x")
    if pair_features:
        asked = pairs.withColumn("query_id", F.col("event_idx") * (1 + n) + F.col("k") + 1)
        made = pair_features(asked.select("query_id", F.col("src").alias("s"), F.col("dst").alias("d"), "day"))
        p = p.unionByName(asked.join(made.select("query_id", "pair"), "query_id").select("event_idx", (F.col("k") + 1 + 2 * n).alias("at"), "y", F.col("pair").alias("x")))
    first = train.agg(F.min("event_idx")).first()[0]
    step = F.floor((F.col("event_idx") - F.lit(first)) / plan.step).cast("long")
    p = p.withColumns({"step": step, "part": F.pmod("event_idx", F.lit(plan.tasks)).cast("int")}).repartition("step", "part")
    p = p.groupBy("step", "part", "event_idx").agg(F.max("y").alias("y"), F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    whole = [F.col("m")[2 * k + 1].isNotNull() for k in range(n)] + [F.col("m")[2 * n + k].isNotNull() for k in range(n if pair_features else 0)]
    for there in whole:
        p = p.where(there)
    x = F.flatten(F.array(*[F.coalesce(F.col("m")[k], F.col("m")[0]) if k % 2 == 0 else F.col("m")[k] for k in range(2 * n)]))
    pair = F.flatten(F.array(*[F.col("m")[2 * n + k] for k in range(n)])) if pair_features else F.array().cast("array<double>")
    return p.select("step", "part", "event_idx", "y", x.alias("x"), pair.alias("pair"))


class Steps:
    """Rows in a folder for each step and task of it; there are as many steps as training edges by ``Plan.step``."""

    def __init__(self, rows: DataFrame, tasks: int):
        self.spark, self.schema, self.path, self.tasks = rows.sparkSession, rows.drop("step", "part").schema, cut_folder(rows.sparkSession, "steps"), tasks
        rows.write.partitionBy("step", "part").parquet(self.path)
        names = self.spark.read.schema("step long").parquet(self.path).select("step").distinct().orderBy("step").collect()
        self.steps = [r["step"] for r in names]

    def rows(self, step: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/step={step}")

    def drop(self) -> None:
        drop_folder(self.spark, self.path)


def _of_batch(w: Weights, shape: Shape, plan: Plan, b: pa.RecordBatch) -> tuple[float, float, Weights]:
    pairs, size = 1 + plan.negatives + plan.hard, width(shape)
    x = net._matrix(b.column("x"), pairs * 2 * size).reshape(b.num_rows, pairs, 2, size)
    pair = net._matrix(b.column("pair"), pairs * shape.pair).reshape(b.num_rows, pairs, shape.pair) if shape.pair else None
    return gradients(w, shape, plan, x, b.column("y").to_numpy(zero_copy_only=False), pair)


def _partial(w: Weights, shape: Shape, plan: Plan):
    def run(batches):
        total, n, losses = {k: np.zeros(v.size) for k, v in w.items()}, 0, np.zeros(2)
        for b in net._slices(batches):
            link, huber, grad = _of_batch(w, shape, plan, b)
            losses, n = losses + (link, huber), n + b.num_rows
            for k, g in grad.items():
                total[k] += g.ravel()
        if n:
            total[""] = np.array([n, *losses])
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()), pa.list_(pa.float64()))], ["name", "value"])

    return run


def _summed(table: pa.Table) -> pa.Table:
    total = np.sum(table["value"].to_pylist(), axis=0)
    return pa.table({"name": table["name"][:1], "value": pa.array([total], pa.list_(pa.float64()))})


def step_gradient(rows: DataFrame, w: Weights, shape: Shape, plan: Plan) -> tuple[int, float, float, Weights]:
    """Rows, mean losses and the mean gradient over ``rows``, in at most ``Plan.tasks`` tasks. The driver gets an array per
    weight and task; beyond ``BRANCHES`` tasks, an array per weight. Few tasks need no shuffle, and a step is one stage."""
    parts = rows.select("y", "x", "pair").coalesce(plan.tasks).mapInArrow(_partial(w, shape, plan), "name string, value array<double>")
    for keys in (["name", "branch"], ["name"]) if plan.tasks > BRANCHES else ():
        parts = parts.withColumn("branch", F.spark_partition_id() % BRANCHES).groupBy(*keys).applyInArrow(_summed, "name string, value array<double>")
    got: dict[str, np.ndarray] = {}
    for r in parts.collect():  # an array per weight and task
        got[r["name"]] = got.get(r["name"], 0.0) + np.array(r["value"])
    if not got:
        return 0, 0.0, 0.0, {}
    n, link, huber = got.pop("")
    return int(n), link / n, huber / n, {k: v.reshape(w[k].shape) / n for k, v in got.items()}


def _files(path: str) -> tuple[pafs.FileSystem, list[str]]:
    fs, path = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return fs, sorted(f.path for f in found if f.path.endswith(".parquet"))


def step_sums(table: Steps, step: int, w: Weights, shape: Shape, plan: Plan) -> tuple[int, float, float, Weights]:
    """What ``step_gradient`` gives, without a plan: each task opens the step's files that are its own."""
    if table.tasks > BRANCHES:
        return step_gradient(table.rows(step), w, shape, plan)
    path = f"{table.path}/step={step}"

    def run(parts):
        for part in parts:
            fs, names = _files(f"{path}/part={part}")
            total = np.zeros(3 + sum(a.size for a in w.values()))
            for name in names:
                with fs.open_input_file(name) as f:
                    for b in net._slices(pq.ParquetFile(f).iter_batches(columns=["y", "x", "pair"])):
                        link, huber, grad = _of_batch(w, shape, plan, b)
                        total += np.concatenate([[b.num_rows, link, huber], *[grad[k].ravel() for k in w]])
            yield total

    total = np.sum(table.spark.sparkContext.parallelize(range(table.tasks), table.tasks).mapPartitions(run).collect(), axis=0)  # an array per task
    n, link, huber = total[:3]
    if not n:
        return 0, 0.0, 0.0, {}
    ends = np.cumsum([a.size for a in w.values()])
    return int(n), link / n, huber / n, {k: x.reshape(a.shape) / n for (k, a), x in zip(w.items(), np.split(total[3:], ends[:-1]), strict=True)}


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def move(self, w: Weights, grad: Weights) -> Weights:
        self.t += 1
        out = {}
        for k, g in grad.items():
            self.m[k] = DECAY[0] * self.m.get(k, 0.0) + (1 - DECAY[0]) * g
            self.v[k] = DECAY[1] * self.v.get(k, 0.0) + (1 - DECAY[1]) * g * g
            m, v = self.m[k] / (1 - DECAY[0] ** self.t), self.v[k] / (1 - DECAY[1] ** self.t)
            out[k] = w[k] - self.rate * m / (np.sqrt(v) + 1e-8)
        return out


# Validation and the loop


def laid_embeddings(laid: DataFrame, w: Weights, shape: Shape) -> DataFrame:
    """node, day, h from ``trees``: the embeddings that ``graphnet.embeddings`` gives."""

    def run(batches):
        for b in net._slices(batches):
            h = Pass(w, shape).embed(net._matrix(b.column("x"), width(shape)))[0]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("day"), net._lists(h)], names=["node", "day", "h"])

    return laid.select("node", "day", "x").mapInArrow(run, "node long, day int, h array<double>")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("src", "dst")).alias("node"), "day")


def pair_logits(edges: DataFrame, inc: DataFrame, pairs: DataFrame, w: Weights, shape: Shape, pair_features=None, laid: DataFrame | None = None) -> DataFrame:
    """``pairs`` (query_id, src, dst, day and more) with logit and amount, each strictly as of its day. ``laid``: the
    arrays of their ends, which without memory are the same for all weights."""
    log = net.memory_log(edges, w, shape) if shape.memory else None
    z = net.embeddings(inc, ends_of(pairs), w, shape, log) if laid is None else cut(laid_embeddings(laid, w, shape))
    rows = pairs.join(z.select(F.col("node").alias("src"), "day", F.col("h").alias("zs")), ["src", "day"]).join(z.select(F.col("node").alias("dst"), "day", F.col("h").alias("zd")), ["dst", "day"])
    if pair_features:
        rows = rows.join(pair_features(pairs.select("query_id", F.col("src").alias("s"), F.col("dst").alias("d"), "day")).select("query_id", "pair"), "query_id")
    return net.pair_scores(rows, w, shape, pairs.columns)


def held_pairs(edges: DataFrame, n_nodes: DataFrame, plan: Plan) -> DataFrame:
    """The fixed pairs that an epoch is judged by: kind (train, val, probe), query_id, event_idx, src, dst, day, y. All
    validation edges and a sample of ``train_sample`` training edges, each with a uniform negative, and the probe's
    candidates of validation edges; the two samples are what their metrics ask for."""
    neg = sampling.uniform_targets(edges, n_nodes, plan.seed + 10_000, "held")
    t = edges.where("split = 'train'").orderBy(hash_key(plan.seed, "train-metric", F.col("event_idx")), "event_idx").limit(plan.train_sample)
    base = t.unionByName(edges.where("split = 'val'")).select("event_idx", "src", "dst", "day", F.col("split").alias("kind"))
    both = labelled(base, base.drop("dst").join(neg.select("event_idx", F.col("neg_dst").alias("dst")), "event_idx").select(*base.columns))
    if plan.select != "ap":
        c = sampling.probe(edges, n_nodes, plan.seed, plan.probe_events, plan.probe_candidates)
        e = edges.select("event_idx", "src", "dst", "day")
        asked = c.join(e.drop("dst"), "event_idx").select("event_idx", "src", F.col("node").alias("dst"), "day", F.lit("probe").alias("kind"), F.lit(0).alias("y"))
        own = e.join(c.select("event_idx").distinct(), "event_idx", "left_semi").select("event_idx", "src", "dst", "day", F.lit("probe").alias("kind"), F.lit(1).alias("y"))
        both = both.unionByName(asked).unionByName(own)
    return cut(both.withColumn("query_id", F.monotonically_increasing_id()))


def judged(scored: DataFrame, plan: Plan) -> dict[str, float]:
    """train_ap, train_auroc, val_ap, val_auroc, and where asked val_mrr of scored pairs."""
    s = scored.where("kind <> 'probe'").select("kind", "y", F.col("logit").alias("score"))
    out: dict[str, float] = {}
    for name, table in (("ap", metrics.average_precision(s, ["kind"])), ("auroc", metrics.auroc(s, ["kind"]))):
        out |= {f"{r['kind']}_{name}": r[name] for r in table.collect()}
    if plan.select != "ap":
        p = scored.where("kind = 'probe'")
        mine = p.where("y = 1").select("event_idx", F.col("logit").alias("_t"))
        count = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
        ranks = p.where("y = 0").join(mine, "event_idx").groupBy("event_idx").agg((1 + count(F.col("logit") > F.col("_t")) + 0.5 * count(F.col("logit") == F.col("_t"))).alias("rank"))
        out["val_mrr"] = ranks.agg(F.avg(1.0 / F.col("rank"))).first()[0]
    return out


def chosen(metric: dict[str, float], select: str) -> float:
    ap, mrr = metric.get("val_ap") or 0.0, metric.get("val_mrr") or 0.0
    return {"ap": ap, "mrr": mrr, "combo": (max(mrr, 0.0) * max(ap, 0.0)) ** 0.5}[select]


def train(edges: DataFrame, n_nodes: DataFrame, shape: Shape, plan: Plan, weights: Weights | None = None, pair_features=None, folder: str | None = None, start: bool = False) -> Fitted:
    """Weights with the best validation metric, and the history of epochs. Edges are (event_idx, src, dst, day, split,
    feat). Ends after ``patience`` epochs without a better one. With a ``folder`` the weights of each epoch are kept there
    by epoch. With ``start`` the history begins with epoch -1, the network before training, which is never chosen."""
    w = weights or net.random_weights(shape, plan.seed)
    inc = cut(incidence(edges, ("feat",)))
    seen = edges.where("split = 'train'")
    held = held_pairs(edges, n_nodes, plan)
    laid = None if shape.memory else trees(inc, ends_of(held), shape)
    judge = lambda at: judged(cut(pair_logits(edges, inc, held, at, shape, pair_features, laid)), plan)
    adam, out, best, bad = Adam(plan.rate), Fitted(w), -1.0, 0
    if start:
        out.history.append({"epoch": -1, "train_loss": None} | judge(w))
    for epoch in range(plan.epochs):
        inputs = None
        if shape.memory:
            log = net.memory_log(seen, w, shape)
            inputs = cut(memory_inputs(seen, log, shape))
        drawn = negatives(edges, n_nodes, plan, epoch)
        table, losses = Steps(examples(edges, inc, drawn, shape, plan, inputs, pair_features), plan.tasks), []
        for step in table.steps:
            n, link, huber, grad = step_sums(table, step, w, shape, plan)
            if n:
                w = adam.move(w, grad)
                losses.append((link, huber))
        table.drop()
        drop(*([inputs] if inputs is not None else []))
        row = {"epoch": epoch, "train_link": float(np.mean([x for x, _ in losses])), "train_huber": float(np.mean([x for _, x in losses]))}
        row["train_loss"] = row["train_link"] + row["train_huber"]
        row |= judge(w)
        out.history.append(row)
        if folder:
            net.save_weights(edges.sparkSession, w, f"{folder}/epoch={epoch}")
        value = chosen(row, plan.select)
        if value > best:
            best, out.weights, bad = value, w, 0
        else:
            bad += 1
            if bad >= plan.patience:
                break
    drop(inc, held, *([laid] if laid is not None else []))
    return out
