"""Removal of repeated byte strings: every byte covered by a string of ``LENGTH`` bytes that also starts earlier.

1. Shards. Each window of ``LENGTH`` bytes has a smallest gram (``GRAM`` bytes, by hash, the leftmost of equal ones); windows
   next to each other with the same one are a segment, about 35 windows. Equal windows have equal grams, so the segments of
   a gram are a class that can be judged alone. Segments are dealt by ranges of (gram, content, place), so that a class
   with a third of all rows is many chunks. A segment alone in its class repeats nothing; one that has an equal segment
   before it is a repeat as a whole; of the others, distinct segments of one gram, the bytes are fetched.
2. Suffix arrays. Classes are put together to shards of bounded size; each is one text of which the suffix array is made by
   induced sorting, then the common prefixes in text order. Suffixes next to each other that share ``LENGTH`` bytes are
   equal windows; all but the earliest are repeats. A class with more than ``LARGE`` distinct segments goes through step 1
   again, each segment cut by where the gram is in its windows: first into two halves, with the 66 bytes that all windows
   of a half share as their gram, and those classes that are still so large by ``WIDTHS`` finer. In the end a segment is a
   window and its gram the window's hash: then equal windows are equal segments.
3. Each document's repeats are laid over its bytes.

Texts are written once, in parts, to the shared folder; tasks fetch segments and documents from there, so texts are never
shuffled. Order is by doc_id, then start. Null text is empty; a null doc_id comes first. Rows of one doc_id with different
texts are ordered by a hash of the text; equal rows count as one document and get equal results. Texts of any length go
by pieces. Extra columns are not read; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoflow.llm.store import Output, fresh_folder, open_input, written
from chronoflow.llm.suffix_arrays import common_prefixes, suffix_array
from chronoflow.llm.textkit import frugal, mix64

LENGTH = 100
GRAM = 32
SPAN = LENGTH - GRAM + 1  # grams in a window
PART = 16 << 20
PIECE = 1 << 18
CHUNK = 500_000
LARGE = 5000
WIDTHS = (35, 6, 1)  # places of the gram in the windows that a cut of a large class puts together
SHARD = 4 << 20
NONE = -(1 << 63)  # the key of a null doc_id
TIE = 40  # bits of a place; above them the hash of the text
U64 = np.uint64
_STEPS = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_BYTE = mix64(np.arange(1, 257, dtype=U64) * _STEPS[0])
_LOW = U64((1 << 24) - 1)

SEGMENT = "gram long, content long, doc long, place long, n int, part long"
JUDGED = "gram long, doc long, place long, n int, part long, repeat boolean"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _grams(data: np.ndarray) -> np.ndarray:
    """Hashes of all runs of 32 bytes."""
    h = _BYTE[data]
    for k, c in enumerate(_STEPS[:5]):
        h = h[: -(1 << k)] * c + h[1 << k :]
        h ^= h >> U64(31)
    return h


def segments(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Segments of texts laid one after the other (``ends``: where each ends): gram, content, first window, number of
    windows."""
    if len(data) < LENGTH:
        return (np.empty(0, np.int64),) * 4
    hashes = _grams(data)
    low = (hashes & ~_LOW) | np.arange(len(hashes), dtype=U64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < SPAN:
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
    best = (low & _LOW).astype(np.int64)
    # Windows that reach beyond their text do not count.
    begin = np.r_[0, ends[:-1]]
    edge = np.zeros(len(best) + 1, np.int64)
    np.add.at(edge, begin[begin < len(best)], 1)
    last = np.maximum(ends - LENGTH + 1, begin)
    np.add.at(edge, np.minimum(last, len(best)), -1)
    edge[-1] += int((begin >= len(best)).sum())
    inside = np.cumsum(edge[:-1]) > 0
    new = np.r_[True, best[1:] != best[:-1]] & inside
    new[1:] |= inside[1:] & ~inside[:-1]
    cut = begin[(begin < len(best)) & (last > begin)]
    new[cut] = True
    at = np.flatnonzero(new)
    stop = np.flatnonzero(inside & np.r_[new[1:] | ~inside[1:], True]) + 1
    n = stop - at
    z = at + n + LENGTH - 1
    return mix64(hashes[best[at]]).view(np.int64), _digest(hashes, at, z).view(np.int64), at, n


def _digest(hashes: np.ndarray, at: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Hashes of the bytes from ``at`` to before ``z``, 64 to 176 of them, by the hashes of all runs of 32."""
    whole = lambda x: hashes[x] * _STEPS[5] + hashes[x + 32]
    n = (z - at - LENGTH + 1).astype(U64)
    return mix64(mix64(mix64(whole(at)) + whole(np.minimum(at + 48, z - 64))) + whole(z - 64) + n)


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts as pieces of about ``PIECE`` bytes: data, ends, and of each text in it its number and the first byte's
    place. Long texts are cut, with ``LENGTH`` - 1 bytes shared between neighbours."""
    held: list[tuple[int, int, bytes]] = []
    size = 0
    out = lambda: (np.frombuffer(b"".join(x for *_, x in held), np.uint8), np.cumsum([len(x) for *_, x in held]), np.array([k for k, *_ in held]), np.array([a for _, a, _ in held]))
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - LENGTH + 1), PIECE):
            piece = text[a : a + PIECE + LENGTH - 1]
            if held and size + len(piece) > PIECE:
                yield out()
                held, size = [], 0
            held.append((k, a, piece))
            size += len(piece)
    if held:
        yield out()


# Parts of texts in the shared folder


def _write_parts(folder: str):
    """doc_id, tie, text -> parts of about ``PART`` bytes in files named by their number; part and n_bytes of each."""
    kind = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("text", pa.large_binary())])

    def run(batches):
        rows, size = [], 0

        def out():
            part, sink = uuid.uuid4().int >> 65, pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, kind, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(pa.table(dict(zip(kind.names, zip(*rows, strict=True), strict=True)), kind))
            file = Output(f"{folder}/{part:x}")
            file.write(sink.getvalue())
            file.close()
            return pa.RecordBatch.from_pydict({"part": [part], "n_bytes": [size]}, pa.schema([("part", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(2)), batch.column(2).cast(pa.binary()).to_pylist(), strict=True):
                rows.append((row[0], row[1], row[2] or b""))
                size += len(rows[-1][2])
                if size >= PART:
                    yield out()
                    rows, size = [], 0
        if rows:
            yield out()

    return run


def _read_part(folder: str, part: int) -> tuple[np.ndarray, np.ndarray, list[bytes], list]:
    """Key (doc_id, ``NONE`` for null) and tie of each document, texts, doc_ids."""
    with open_input(f"{folder}/{part:x}") as f:
        table = pa.ipc.open_stream(f).read_all()
    docs = table["doc"].to_pylist()
    return np.array([NONE if d is None else d for d in docs], np.int64), table["tie"].to_numpy(), table["text"].to_pylist(), docs


def _part_segments(folder: str):
    """Numbers of parts -> the segments of their texts."""

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                doc, tie, texts, _ = _read_part(folder, part)
                for data, ends, which, first in _pieces(texts):
                    gram, content, at, n = segments(data, ends)
                    own = np.searchsorted(ends, at, "right")
                    place = (tie[which[own]] << TIE) + first[own] + at - np.r_[0, ends[:-1]][own]
                    yield pa.RecordBatch.from_arrays([pa.array(gram), pa.array(content), pa.array(doc[which[own]]), pa.array(place), pa.array(n.astype(np.int32)), pa.array(np.full(len(n), part))], ["gram", "content", "doc", "place", "n", "part"])

    return run


# Step 1: classes of segments in sorted chunks


def _judge(batches):
    """A chunk of segments sorted by (gram, content, doc, place) -> those that are not alone in their class, with
    ``repeat``: whether an equal segment is before. Classes with a single content show no other than repeats. The first
    and the last class of a chunk may go on in the next ones: their first segments are kept in any case."""
    names = ["gram", "doc", "place", "n", "part"]
    held: pa.Table | None = None
    first = True

    def settled(rows: pa.Table, opening: bool, closing: bool):
        c = {k: rows[k].to_numpy() for k in [*names, "content"]}
        new = np.r_[True, c["gram"][1:] != c["gram"][:-1]]
        lead = new | np.r_[True, c["content"][1:] != c["content"][:-1]]
        again = ~lead & np.r_[False, (c["doc"][1:] == c["doc"][:-1]) & (c["place"][1:] == c["place"][:-1])]
        group = np.cumsum(new) - 1
        several = np.bincount(group, weights=lead) > 1
        if opening:
            several[0] = True
        if closing:
            several[-1] = True
        # Equal rows of the table are judged alike.
        lead = lead[np.maximum.accumulate(np.where(again, 0, np.arange(len(lead))))]
        keep = several[group] | ~lead
        return pa.RecordBatch.from_arrays([pa.array(c[k][keep]) for k in names] + [pa.array(~lead[keep])], [*names, "repeat"])

    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        gram = held["gram"].to_numpy()
        if len(gram) < 50_000:
            continue
        cut = int(np.searchsorted(gram, gram[-1], "left")) if len(gram) else 0
        if cut:
            yield settled(held.slice(0, cut), first, False)
            held, first = held.slice(cut).combine_chunks(), False
    if held is not None and held.num_rows:
        yield settled(held, first, True)


def _classes(rows: DataFrame, parts: int) -> DataFrame:
    order = ["gram", "content", "doc", "place"]
    dealt = rows.repartitionByRange(max(1, parts), *order).sortWithinPartitions(*order)
    return written(dealt.mapInArrow(frugal(_judge), JUDGED), "classes")


# Step 2: suffix arrays


def _fetch(folder: str):
    """Segments of one part -> the same with their bytes."""

    def run(table: pa.Table) -> pa.Table:
        doc, tie, texts, _ = _read_part(folder, table["part"][0].as_py())
        where = {key: k for k, key in enumerate(zip(doc.tolist(), tie.tolist(), strict=True))}
        low = (1 << TIE) - 1
        data = [texts[where[d, p >> TIE]][(p & low) : (p & low) + n + LENGTH - 1] for d, p, n in zip(table["doc"].to_pylist(), table["place"].to_pylist(), table["n"].to_pylist(), strict=True)]
        return table.select(["gram", "doc", "place", "part"]).append_column("bytes", pa.array(data, pa.binary()))

    return run


def repeats(doc: np.ndarray, place: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows in ``texts`` that occur in one of them at an earlier place: the text and the place of each. ``doc``,
    ``place``: of the first byte of each text."""
    data = np.frombuffer(b"\xff".join(texts), np.uint8)  # no byte of UTF-8
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes + 1) - sizes - 1
    array = suffix_array(data, 256)
    shared = common_prefixes(data, array) >= LENGTH
    own = np.repeat(np.arange(len(texts)), sizes + 1)[: len(data)]
    offset = np.arange(len(data)) - begin[own]
    valid = offset + LENGTH <= sizes[own]
    group = np.cumsum(~shared[array])  # equal first bytes, in the order of the array
    ok = valid[array]
    at, group = array[ok], group[ok]
    text, p = own[at], place[own[at]] + offset[at]
    by = np.lexsort((p, doc[text], group))
    text, p, group = text[by], p[by], group[by]
    d = doc[text]
    head = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], np.arange(len(d)), 0)) if len(d) else np.arange(0)
    later = (d != d[head]) | (p != p[head])
    return text[later], p[later]


def _shard_repeats(table: pa.Table) -> pa.Table:
    doc, part = table["doc"].to_numpy(), table["part"].to_numpy()
    text, place = repeats(doc, table["place"].to_numpy(), table["bytes"].to_pylist())
    doc, part = doc[text], part[text]
    by = np.lexsort((place, doc))
    doc, place, part = doc[by], place[by], part[by]
    at = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 1)]) if len(doc) else by
    stop = np.r_[at[1:], len(doc)] - 1 if len(at) else at
    return pa.table({"doc": doc[at], "place": place[at], "n": (place[stop] - place[at] + 1).astype(np.int32), "part": part[at]})


def _cut(width: int):
    """Segments with their bytes -> segments of windows that have the gram within the same ``width`` places, by what these
    windows share. Equal windows have the gram at the same place."""

    def run(batches):
        for batch in batches:
            rows = [[] for _ in range(6)]
            for doc, place, part, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                h = _grams(np.frombuffer(text, np.uint8))
                at = np.arange(len(text) - LENGTH + 1)
                best = int(np.argmin(h & ~_LOW))  # every window of a segment has it, the leftmost of equal ones
                cut = (best - at) // width
                at = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
                low = cut[at] * width
                n = np.diff(np.r_[at, len(cut)])
                gram = mix64(_digest(h, best - low, best - np.minimum(low + width, SPAN) + LENGTH + 1) + low.astype(U64))
                columns = gram.view(np.int64), _digest(h, at, at + n + LENGTH - 1).view(np.int64), np.full(len(at), doc), place + at, n.astype(np.int32), np.full(len(at), part)
                for held, column in zip(rows, columns, strict=True):
                    held.append(column)
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in rows], ["gram", "content", "doc", "place", "n", "part"])

    return run


# Step 3: documents


def _documents(folder: str):
    """Repeats of one part (and a row without any) -> its documents' results."""

    def run(table: pa.Table) -> pa.Table:
        keys, ties, texts, docs = _read_part(folder, table["part"][0].as_py())
        doc, place, n = (table[c].to_numpy() for c in ("doc", "place", "n"))
        by = np.lexsort((place, doc))
        by = by[n[by] > 0]
        doc, place, n = doc[by], place[by], n[by]
        low, rows = (1 << TIE) - 1, []
        for key, t, text, d in zip(keys, ties.tolist(), texts, docs, strict=True):
            a, z = np.searchsorted(doc, key, "left"), np.searchsorted(doc, key, "right")
            a, z = a + np.searchsorted(place[a:z], [t << TIE, (t + 1) << TIE], "left")
            depth = np.zeros(len(text) + 1, np.int32)
            np.add.at(depth, place[a:z] & low, 1)
            np.add.at(depth, (place[a:z] & low) + n[a:z] + LENGTH - 1, -1)
            gone = np.cumsum(depth[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if a < z else text
            rows.append((d, len(text), len(text) - len(kept), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
        ids, *counts, sha = zip(*rows, strict=True)
        return pa.table([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def repeated_bytes(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, text): the size of its text as UTF-8, how many bytes repeats cover, in how many maximal
    runs, and the sha256 of the rest."""
    folder = fresh_folder(docs.sparkSession, "texts")
    text = F.coalesce("text", F.lit(""))
    tie = F.shiftrightunsigned(F.xxhash64(text), TIE + 1).alias("tie")
    parts = written(docs.select(F.col("doc_id").cast("long").alias("doc"), tie, text.alias("text")).mapInArrow(frugal(_write_parts(folder)), "part long, n_bytes long"), "parts")
    size = parts.agg(F.sum("n_bytes")).first()[0] or 0
    names = parts.select("part").repartition(max(1, -(-size // PART)), "part")
    found = _classes(names.mapInArrow(frugal(_part_segments(folder)), SEGMENT), -(-size // 34 // CHUNK))
    answer = ["doc", "place", "n", "part"]

    def with_bytes(rows: DataFrame) -> DataFrame:
        return rows.select("part", "gram", "doc", "place", "n").groupBy("part").applyInArrow(_fetch(folder), "gram long, doc long, place long, part long, bytes binary")

    def in_shards(rows: DataFrame, n: int) -> DataFrame:
        shards = max(1, -(-n * (LENGTH + SPAN // 2) // SHARD))
        return with_bytes(rows).withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(shards))).groupBy("shard").applyInArrow(_shard_repeats, "doc long, place long, n int, part long")

    every = found.where("repeat").select(*answer)
    for width in (*WIDTHS, None):
        first = found.where("NOT repeat")
        counts = first.groupBy("gram").agg(F.count("*").alias("m"))
        large = F.col("m") > LARGE if width else F.lit(False)
        n, over = counts.agg(*[F.coalesce(F.sum(F.when(c, F.col("m"))), F.lit(0)) for c in (~large, large)]).first()
        if not over:
            every = every.unionByName(in_shards(first, n))
            break
        # Their rows are dealt by gram without their bytes.
        grams = counts.where(large).select("gram")
        every = every.unionByName(in_shards(first.join(grams, "gram", "left_anti"), n))
        cuts = with_bytes(first.join(grams, "gram", "left_semi")).select("doc", "place", "part", "bytes").mapInArrow(frugal(_cut(width)), SEGMENT)
        found = _classes(cuts, -(-over * min(SPAN // width + 1, SPAN // 2) // CHUNK))
        every = every.unionByName(found.where("repeat").select(*answer))
    none = parts.select(F.lit(0).cast("long").alias("doc"), F.lit(0).cast("long").alias("place"), F.lit(0).alias("n"), "part")
    return every.unionByName(none).groupBy("part").applyInArrow(_documents(folder), RESULT)
