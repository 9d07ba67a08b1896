"""Near-duplicate detection with SetSketch registers.

A document is the set of its distinct word shingles (A-Z lower-cased). Register i of its sketch is
``floor(1 - log_b(min over shingles of x_i))``, cut off below 0, where x_i hashes a shingle to an exponential
distribution of rate ``A``. Sketches merge by the maximum, and two registers are equal with about the probability of the
sets' Jaccard similarity (b = 1.001). ``BANDS`` bands of ``ROWS`` registers find the candidates: at similarity 0.85 a pair
is missed with probability (1 - 0.85**5)**20 = 8e-6. Candidates whose joint maximum-likelihood similarity (from the
counts of larger, smaller and equal registers, and the set sizes) is more than five standard errors under the
threshold go; the others are confirmed on the full sets: 100 * intersection >= threshold * union.

Documents with the same words in the same order are one node from the start, with a number of its own; its text is that of
the row with the smallest doc_id. In a
bucket of many nodes not all pairs are compared. First every node is confirmed or refuted against the bucket's centre,
the node that meets most others over all buckets, and what is linked is joined into components. A bucket within one
component is done, as further links in it change nothing. In the others the nodes outside the centre's component are compared
with all nodes of those buckets, blocks of one side with slices of the other and through an index of the block's
shingles, so that pairs never become rows and a task's unit is bounded whatever a group's size.
Before that, nodes go that cannot be linked at all: the shingles that a node shares with any other bound the size of the
sets it can be linked with. So every candidate pair is confirmed, refuted, impossible, or inside a component.

A centre with many members is compared with them in groups of ``MEMBERS``, its text repeated for each group.

Edge cases: null and empty texts and texts without words have an empty set and are linked with nothing; texts with
fewer words than a shingle are one shingle; equal rows are linked and kept alike; a null doc_id is linked like any other
but never names a component that has an id (a component without ids has a null name, and of its rows those with its first
text are kept); rows of one doc_id with different texts are documents of their own, each in the component of its text; an
empty table gives an empty result; other columns are ignored. Where ``kept_documents`` meets equal rows of a document that
stays, one stays. Names that start with ``__d_`` are reserved.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoflow.llm.store import dropped, written
from chronoflow.llm.textkit import U64, frugal, hash_words, lower_ascii, mix64, shingles

BANDS, ROWS = 20, 5
REGISTERS = BANDS * ROWS
BASE, A = 1.001, 20.0
ERRORS = 5.0  # standard errors of the estimate
MEMBERS = 200
BLOCK, SLICE = 250, 500

_FACTOR = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_SHIFT = mix64(np.arange(1, REGISTERS + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F))
_CHUNK = 512


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    return np.unique(shingles(hash_words(lower_ascii(text)), width))


def registers(values: np.ndarray) -> np.ndarray:
    """The sketch of a set of hashes."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, U64)
    for at in range(0, len(values), _CHUNK):
        np.minimum(least, ((values[at : at + _CHUNK, None] ^ _SHIFT) * _FACTOR).min(axis=0), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / A
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 65535).astype("<u2")


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def likely_similarity(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of pairs of sketches (rows) of sets with n and m elements."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u, v = n / (n + m), m / (n + m)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    tiny = 1e-12

    def value(j):
        x, y = p(u - v * j), p(v - u * j)
        return more * np.log(np.maximum(x, tiny)) + less * np.log(np.maximum(y, tiny)) + same * np.log(np.maximum(1 - x - y, tiny))

    low, high = np.zeros(len(n)), np.minimum(u / v, v / u)
    for _ in range(40):
        third = (high - low) / 3
        left = value(low + third) < value(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


_KEY = ("doc_id", "h", "len")
_SKETCH = "doc_id long, h long, len int, n_shingles long, digest binary, sketch binary"


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, and hash and length of the text, which tell rows of one doc_id apart."""
    x = F.col(text).cast("string")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), x.alias("text"), F.xxhash64(F.coalesce(x, F.lit(""))).alias("h"), F.length(F.coalesce(x, F.lit(""))).alias("len"))


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h")) & (F.col(f"{a}.len") == F.col(f"{b}.len"))


def _sketcher(width: int):
    def sketch(batches):
        for batch in batches:
            n, digest, sketches = [], [], []
            for x in batch.column("text"):
                data = lower_ascii(x.as_py())
                values = np.unique(shingles(hash_words(data), width))
                n.append(len(values))
                digest.append(hashlib.blake2b(b" ".join(data.split()), digest_size=16).digest())
                sketches.append(registers(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in _KEY), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(sketches, pa.binary())], [*_KEY, "n_shingles", "digest", "sketch"])

    return sketch


def sketches(rows: DataFrame, width: int) -> DataFrame:
    """The key, n_shingles, digest of the word sequence and sketch (null for an empty set) of ``keyed`` rows."""
    return rows.mapInArrow(frugal(_sketcher(width)), _SKETCH)


def _probable(threshold: float):
    least = threshold - ERRORS * (threshold * (1 - threshold) / REGISTERS) ** 0.5

    def keep(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            col = lambda k: batch.column(k).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            regs = lambda k: np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, REGISTERS)  # noqa: B023, E731
            n, m = col(3).astype(float), col(5).astype(float)
            ok = np.minimum(n, m) >= threshold * np.maximum(n, m)
            ok &= likely_similarity(regs(2), n, regs(4), m) >= least
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return keep


def _confirmer(width: int, percent: int):
    """Rows come by centre and group, the centre's text first."""

    def confirm(batches):
        at, centre = None, None
        for batch in batches:
            found = []
            for a, salt, b, text in zip(*(batch.column(k) for k in range(4))):
                key = (a.as_py(), salt.as_py())
                values = shingle_set(text.as_py(), width)
                if b.as_py() is None:
                    at, centre = key, values
                elif key == at:
                    both = len(np.intersect1d(centre, values, assume_unique=True))
                    if 100 * both >= percent * (len(centre) + len(values) - both):
                        found.append((key[0], b.as_py()))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return confirm


def confirmed(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough; a is the side with many pairs."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "s_a", "n_a", "s_b", "n_b")
    likely = written(both.mapInArrow(frugal(_probable(percent / 100)), "a long, b long"), "likely")
    groups = likely.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).alias("groups"))
    members = likely.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), F.col("groups")).alias("salt"), "b", F.col("b").alias("node"))
    centres = groups.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), F.col("a").alias("node"))
    rows = members.unionByName(centres).join(texts, "node").select("a", "salt", "b", "text")
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return rows.mapInArrow(frugal(_confirmer(width, percent)), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and the smallest node it is connected with, for all nodes of the edges (a, b). Each round maps every node to
    its smallest neighbour's smallest neighbour and the edges with it, until none joins two nodes."""
    edges = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("component", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("to")).withColumnRenamed("a", "from"), "hook")
        jump = hook.alias("x").join(hook.select(F.col("from").alias("to"), F.col("to").alias("next")).alias("y"), "to", "left").select("from", F.coalesce("next", "to").alias("to"))
        jump = written(jump, "jump")
        old = (labels, edges, hook, jump)
        labels = written(labels.join(jump, labels["component"] == jump["from"], "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        a, b = jump.select(F.col("from").alias("a"), F.col("to").alias("c")), jump.select(F.col("from").alias("b"), F.col("to").alias("d"))
        edges = written(edges.join(a, "a").join(b, "b").select(F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")).filter("a <> b").distinct(), "edges")
        dropped(*old)
    dropped(edges)
    return labels


def _band(k: int) -> Column:
    return F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS))


def _hashes(width: int):
    def explode(batches):
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                values = shingle_set(text.as_py(), width)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node)), pa.array(values.view(np.int64))], ["node", "h"])

    return explode


def reaches(nodes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node and reach, the size of the largest set among these nodes that it can be linked with. Of a linked pair the
    intersection is at least percent / (100 + percent) of both sizes together, and it holds only shingles that more than
    one node has. Nodes that can be linked with no set of a fitting size are left out. Nothing that could be linked is
    lost."""
    each = written(texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(frugal(_hashes(width)), "node long, h long"), "shingles")
    common = each.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    cover = each.join(common, "h").groupBy("node").agg(F.count("*").alias("cover"))
    reach = F.floor(F.col("cover") * (100 + percent) / percent) - F.col("n_shingles")
    return nodes.join(cover, "node").select("node", "n_shingles", reach.alias("reach")).filter(100 * F.col("reach") >= percent * F.col("n_shingles"))


def linked_components(nodes: DataFrame, texts_of, width: int, percent: int) -> DataFrame:
    """node and component for the nodes (node, n_shingles, sketch) that share a bucket with another; ``texts_of`` gives
    the texts (node, text) of a table of nodes."""
    rows = written(nodes.select("node", F.explode(F.array(*[_band(k) for k in range(BANDS)])).alias("bucket")), "bands")
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    met_rows = written(rows.join(shared, "bucket"), "members")
    dropped(rows)
    # How many others a node meets over all its buckets: the one that most others are close to makes the best centre.
    met = written(met_rows.groupBy("node").agg(F.sum("n").alias("met")), "met")
    texts = written(texts_of(met.select("node")), "texts")
    sketched = written(nodes.join(met.select("node"), "node", "left_semi"), "nodes")
    centre = F.min(F.struct((-F.col("met")).alias("o"), F.col("node").alias("centre"))).alias("c")
    centres = met_rows.join(met, "node").groupBy("bucket").agg(centre).select("bucket", "c.centre")
    members = written(met_rows.join(centres, "bucket").select("bucket", "node", "centre"), "members")
    dropped(met_rows)
    pairs = written(members.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    links = written(confirmed(pairs, sketched, texts, width, percent), "links")
    labels = written(_labels(met, components(links)), "labels")
    # Buckets that still hold several components.
    placed = members.join(labels, "node")
    inside = F.first(F.when(F.col("node") == F.col("centre"), F.col("component")), ignorenulls=True).alias("inside")
    open_ = placed.groupBy("bucket").agg(inside, F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi")
    placed = written(placed.join(open_.select("bucket", "inside"), "bucket").select("bucket", "node", "component", "inside"), "open")
    dropped(members, pairs)
    if placed.isEmpty():
        dropped(placed, links, texts, sketched)
        return labels
    near = sketched.join(placed.select("node").distinct(), "node", "left_semi").select("node", "n_shingles")
    able = written(reaches(near, texts, width, percent).select("node"), "reaches")
    group = written(placed.select(F.col("inside").alias("g"), "node", "component").distinct().join(able, "node"), "groups")
    more = written(compared(group, texts, width, percent), "links")
    if not more.isEmpty():
        old, labels = labels, written(_labels(met, components(links.unionByName(more))), "labels")
        dropped(old)
    dropped(placed, links, texts, sketched, able, group, more)
    return labels


def _searcher(width: int, percent: int):
    """Rows come by group, block and slice, the block's own nodes first: these are indexed by shingle, and every node of
    the slice gets its intersections with all of them from the index at once."""

    def search(batches):
        at, own, index, root = None, [], None, {}

        def find(x):
            while root.setdefault(x, x) != x:
                x = root[x]
            return x

        for batch in batches:
            found = []
            for g, block, piece, part, node, component, text in zip(*(batch.column(k) for k in range(7))):
                key, node, component = (g.as_py(), block.as_py(), piece.as_py()), node.as_py(), component.as_py()
                if key != at:
                    at, own, index, root = key, [], None, {}
                values = shingle_set(text.as_py(), width)
                if part.as_py() == 0:
                    own.append((node, component, values))
                    continue
                if not own:
                    continue
                if index is None:
                    every, owner = np.concatenate([v for *_, v in own]), np.repeat(np.arange(len(own)), [len(v) for *_, v in own])
                    order = np.argsort(every, kind="stable")
                    index = (every[order], owner[order], np.array([len(v) for *_, v in own]))
                every, owner, n = index
                first, last = np.searchsorted(every, values, "left"), np.searchsorted(every, values, "right")
                k = last - first
                both = np.bincount(owner[np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(first, k)], minlength=len(own))
                for q in np.flatnonzero(100 * both >= percent * (n + len(values) - both)).tolist():
                    # A link within what is already joined here changes nothing.
                    x, y = find(own[q][1]), find(component)
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((own[q][0], node))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return search


def compared(group: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components, from groups (g, node, component): the nodes outside component g, in blocks of
    about ``BLOCK``, against all nodes of the group, in slices of about ``SLICE``. Pairs are counted inside a task, a block
    against a slice, and never become rows."""
    outside = F.col("component") != F.col("g")
    size = group.groupBy("g").agg(F.ceil(F.sum(outside.cast("int")) / BLOCK).alias("blocks"), F.ceil(F.count("*") / SLICE).alias("slices")).filter("blocks > 0")
    dealt = group.join(size, "g").withColumns({"block": F.pmod(F.xxhash64("node"), F.col("blocks")), "slice": F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices"))})
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = dealt.filter(outside).select("g", "block", each("slices").alias("slice"), F.lit(0).alias("part"), "node", "component")
    others = dealt.select("g", each("blocks").alias("block"), "slice", F.lit(1).alias("part"), "node", "component")
    rows = own.unionByName(others).join(texts, "node").select("g", "block", "slice", "part", "node", "component", "text")
    rows = rows.repartition("g", "block", "slice").sortWithinPartitions("g", "block", "slice", "part")
    return rows.mapInArrow(frugal(_searcher(width, percent)), "a long, b long")


def _labels(nodes: DataFrame, joined: DataFrame) -> DataFrame:
    return nodes.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def classified(docs: DataFrame, doc_id: str, text: str, width: int, percent: int) -> DataFrame:
    """Of every row the key (doc_id, h, len), n_shingles, component_id and ``first``, whether its key is the component's
    first: the smallest doc_id, then hash and length of the text."""
    rows = keyed(docs, doc_id, text)
    sketched = written(sketches(rows, width), "sketches")
    order = F.struct(F.isnull("doc_id").alias("n"), *_KEY)
    nodes = sketched.filter("n_shingles > 0").groupBy("digest").agg(F.min(order).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    # Numbers that hold once the table is written.
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keys = nodes.select("node", *[F.col(f"rep.{k}").alias(k) for k in _KEY])
    texts_of = lambda wanted: rows.alias("r").join(keys.join(wanted, "node", "left_semi").alias("k"), _same("r", "k")).select("k.node", "r.text").dropDuplicates(["node"])
    labels = linked_components(nodes.select("node", "n_shingles", "sketch"), texts_of, width, percent)
    placed = written(nodes.select("digest", "node", "rep").join(labels, "node", "left").select("digest", "rep", F.coalesce("component", "node").alias("component")), "placed")
    firsts = placed.groupBy("component").agg(F.min("rep").alias("rep"))
    classes = written(placed.select("digest", "component").join(firsts, "component").select("digest", "rep"), "classes")
    dropped(nodes, labels, placed)
    out = sketched.drop("sketch").join(classes, "digest", "left").drop("digest")
    is_first = F.isnull("rep") | (F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("h") == F.col("rep.h")) & (F.col("len") == F.col("rep.len")))
    component = F.when(F.col("n_shingles") > 0, F.col("rep.doc_id")).otherwise(F.col("doc_id"))
    return out.select(*_KEY, "n_shingles", component.alias("component_id"), is_first.alias("first"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable over links) and kept (whether it is that one)."""
    rows = classified(docs, doc_id, text, width, percent)
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("first") & F.col("component_id").isNull()).alias("kept"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, one of each group, whole and with their columns as they were. Documents without words are
    linked with nothing; equal rows of them are one document."""
    columns = docs.columns
    rows = classified(docs, doc_id, text, width, percent).groupBy(*_KEY).agg(F.first("first").alias("first"), F.count("*").alias("n"))
    rows = written(rows.filter("NOT first OR n > 1"), "gone")
    own = docs.withColumns({"__d_doc_id": F.col(doc_id).cast("long"), "__d_h": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))), "__d_len": F.length(F.coalesce(F.col(text).cast("string"), F.lit("")))})
    kept = _without(own, rows, "left_anti").select(*columns)
    again = rows.filter("first")
    if again.isEmpty():
        return kept
    return kept.unionByName(_without(own, again, "left_semi").dropDuplicates([f"__d_{k}" for k in _KEY]).select(*columns))


def _without(own: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """The rows of ``own`` by whether their key (``__d_*``) is among those of ``rows``."""
    r = rows.select(*[F.col(k).alias(f"__r_{k}") for k in _KEY])
    return own.join(r, F.col("__d_doc_id").eqNullSafe(F.col("__r_doc_id")) & (F.col("__d_h") == F.col("__r_h")) & (F.col("__d_len") == F.col("__r_len")), how)
