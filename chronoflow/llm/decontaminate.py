"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact verification.

Texts are lower-cased, ASCII punctuation counts as white space, and shingles are runs of five words (an item or
text with fewer words is a single shingle of them all). For each benchmark item a window with as many shingles slides
over every text, one word at a time. A window's 128-bit SimHash sums its shingles' bit vectors, each as often as it
occurs; an item's is made alike. The index cuts fingerprints into eight blocks of 16 bits and lists for each block
value the items within three bits of it; a window asks for all values within one bit of its own. Of two fingerprints
within ``RADIUS`` = 39 bits one block differs in four at most, so all of them meet. Pairs within the radius are
verified by the exact weighted Jaccard similarity of their shingles (weight: how often a shingle occurs), which must be
``threshold`` or more.

What the radius means for the threshold: bags of equal size at similarity 0.8 have a cosine of 0.889, so a bit differs
with probability 0.152, and more than 39 of 128 do for about one window in a million (of 31 it would be 1 in 400).

A window without any shingle of the item has similarity 0; such windows get no fingerprint. This skips nothing
that could be found and makes the work follow the benchmark's traces, not the corpus.

The benchmark is the stated query set. It is written in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_WORDS``
words, a file each, and each block is compared with all documents, so no block's size grows with either table. A task
reads its block's file and builds the index for itself; nothing outlives it.

Edge cases: a null or empty text or item matches nothing; equal items are compared each under its id; a null id
stays null; equal rows give equal results; without items all documents stay; an empty table gives an empty result;
other columns pass through ``decontaminated`` untouched and are ignored by ``leaks``.
"""

from __future__ import annotations

import hashlib
import string
import struct
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from chronoflow.llm.store import Output, fresh_folder, open_input, written
from chronoflow.llm.textkit import U64, frugal, hash_words, mix64, shingles

WIDTH, THRESHOLD, RADIUS = 5, 0.8, 39
BLOCKS, LISTED, ASKED = 8, 3, 1  # blocks of 16 bits; LISTED + ASKED = RADIUS // BLOCKS
BLOCK_ITEMS, BLOCK_WORDS = 2000, 400_000

_BLANK = bytes(32 if chr(c) in string.punctuation else c for c in range(256))


def word_hashes(text: str | None) -> np.ndarray:
    return hash_words((text or "").lower().encode("utf-8", "replace").translate(_BLANK))


def _bits(values: np.ndarray) -> np.ndarray:
    """The 128 signs of each shingle, as an (n, 128) array of -1 and 1."""
    both = np.stack([values, mix64(values ^ U64(0x5851F42D4C957F2D))], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(values), 16), axis=1).astype(np.int8) * 2 - 1


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def fingerprint(values: np.ndarray) -> np.ndarray:
    """The SimHash of a bag of shingles, as eight 16-bit blocks."""
    return _packed(_bits(values).sum(axis=0, dtype=np.int32)[None])[0]


def window_fingerprints(values: np.ndarray, size: int) -> np.ndarray:
    """The SimHash of every run of ``size`` shingles."""
    total = np.zeros((len(values) + 1, 128), np.int32)
    np.cumsum(_bits(values), axis=0, out=total[1:])
    return _packed(total[size:] - total[:-size])


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard of two bags of shingles."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = int(np.minimum(n[i], m[j]).sum())
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 0.0


def _masks(bits: int) -> np.ndarray:
    """All changes of at most so many bits of a block."""
    return np.array([sum(1 << k for k in c) for r in range(bits + 1) for c in combinations(range(16), r)], np.uint16)


_LISTED, _ASKED = _masks(LISTED), _masks(ASKED)


class Index:
    """A block of items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.ids = [i for i, w in items if len(w)]
        words = [w for _, w in items if len(w)]
        self.width = [min(WIDTH, len(w)) for w in words]
        self.bags = [shingles(w, WIDTH) for w in words]
        self.size = np.array([len(x) for x in self.bags], np.int64)
        self.prints = np.array([fingerprint(x) for x in self.bags], np.uint16).reshape(-1, BLOCKS)
        # For each window size, of each block: the values within reach, sorted, and whose they are.
        self.lists = {}
        for size in set(self.size.tolist()):
            who = np.flatnonzero(self.size == size).astype(np.int32)
            owners = np.repeat(who, len(_LISTED))
            self.lists[size] = []
            for k in range(BLOCKS):
                values = (self.prints[who, k, None] ^ _LISTED).ravel()
                order = np.argsort(values, kind="stable")
                self.lists[size].append((values[order], owners[order]))
        # Which items hold a shingle: for each width, the sorted shingles and their items.
        self.traces = {}
        for width in set(self.width):
            who = [k for k in range(len(words)) if self.width[k] == width]
            pairs = [(np.unique(self.bags[k]), k) for k in who]
            values = np.concatenate([v for v, _ in pairs])
            owners = np.concatenate([np.full(len(v), k, np.int32) for v, k in pairs])
            order = np.argsort(values, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[(values >> U64(42)).astype(np.int64)] = True
            self.traces[width] = (values[order], owners[order], seen)

    def near(self, prints: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of all fingerprints within the radius, among the items of this window size."""
        windows, items = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for low in range(0, len(prints), _SOME):
            some, found = prints[low : low + _SOME], []
            for k, (values, owners) in enumerate(self.lists[size]):
                asked = (some[:, k, None] ^ _ASKED).ravel()
                first = np.searchsorted(values, asked, "left")
                n = np.searchsorted(values, asked, "right") - first
                window = np.repeat(np.arange(len(asked)) // len(_ASKED), n)
                found.append(window * len(self.ids) + owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)])
            pairs = np.unique(np.concatenate(found))
            window, item = pairs // len(self.ids), pairs % len(self.ids)
            close = np.bitwise_count(some[window] ^ self.prints[item]).sum(axis=1) <= RADIUS
            windows.append(window[close] + low)
            items.append(item[close])
        return np.concatenate(windows), np.concatenate(items)

    def search(self, text: str | None, threshold: float) -> list[tuple[int, float, int, int]]:
        """(item number, similarity, first word, words) of the best window of each item that the text holds."""
        words, best = word_hashes(text), {}
        for width, (values, owners, seen) in self.traces.items():
            bag = shingles(words, width)
            if not len(bag) or len(words) < width:
                continue
            at = np.flatnonzero(seen[(bag >> U64(42)).astype(np.int64)])
            at = at[np.isin(bag[at], values)] if len(at) else at
            if not len(at):
                continue
            # Each trace as (place, item), then the starts of all windows of the item's size that hold it.
            first, last = np.searchsorted(values, bag[at], "left"), np.searchsorted(values, bag[at], "right")
            n = last - first
            item = owners[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
            place = np.repeat(at, n)
            for size in np.unique(self.size[item]).tolist():
                span = min(size, len(bag))
                near = np.unique(place[self.size[item] == size])
                for low, high in _stretches(np.maximum(near - span + 1, 0), np.minimum(near, len(bag) - span)):
                    prints = window_fingerprints(bag[low : high + span], span)
                    for w, k in zip(*(x.tolist() for x in self.near(prints, size))):
                        if self.width[k] != width:
                            continue
                        s = similarity(bag[low + w : low + w + span], self.bags[k])
                        if s >= threshold and s > best.get(k, (0.0,))[0]:
                            best[k] = (s, low + w, span + width - 1)
        return [(k, *best[k]) for k in sorted(best)]


_LONGEST = 1 << 14
_SOME = 256


def _stretches(low: np.ndarray, high: np.ndarray):
    """The union of the intervals [low, high], in pieces of bounded length."""
    begin, end = int(low[0]), int(high[0])
    for a, b in zip(low.tolist()[1:] + [None], high.tolist()[1:] + [None]):
        if a is None or a > end + 1:
            for x in range(begin, end + 1, _LONGEST):
                yield x, min(end, x + _LONGEST - 1)
            begin, end = a, b
        else:
            end = max(end, b)


def item_blocks(benchmark: DataFrame, item_id: str, text: str) -> list[str]:
    """Writes the benchmark in blocks of bounded size, of which the driver holds one at a time: the files' names."""
    rows = benchmark.select(F.col(item_id).cast("long"), F.col(text).cast("string")).distinct()
    folder, uris, block, words = fresh_folder(benchmark.sparkSession, "items"), [], [], 0

    def close():
        out = Output(f"{folder}/{len(uris):06d}")
        out.write(b"".join(struct.pack("<?qQ", i is None, i or 0, len(w)) + w.tobytes() for i, w in block))
        out.close()
        uris.append(f"{folder}/{len(uris):06d}")

    for i, x in rows.toLocalIterator():
        w = word_hashes(x)
        if block and (len(block) == BLOCK_ITEMS or words + len(w) > BLOCK_WORDS):
            close()
            block, words = [], 0
        block.append((i, w))
        words += len(w)
    if block:
        close()
    return uris


def index_of(uri: str) -> Index:
    """The index of a written block."""
    with open_input(uri) as f:
        data = f.read()
    at, items = 0, []
    while at < len(data):
        null, i, n = struct.unpack_from("<?qQ", data, at)
        items.append((None if null else i, np.frombuffer(data, U64, n, at + _ITEM_HEAD)))
        at += _ITEM_HEAD + 8 * n
    return Index(items)


_ITEM_HEAD = struct.calcsize("<?qQ")
_LEAK = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def _finder(uri: str, threshold: float):
    def find(batches):
        index = index_of(uri)
        for batch in batches:
            rows = [(i, index.ids[k], s, at, n) for i, x in zip(batch.column(0).to_pylist(), batch.column(1)) for k, s, at, n in index.search(x.as_py(), threshold)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return find


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, similarity of the best window and
    where that begins (in words) and how long it is."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    parts = [rows.mapInArrow(frugal(_finder(uri, threshold)), _LEAK) for uri in item_blocks(benchmark, item_id, item_text)]
    return reduce(DataFrame.unionAll, parts) if parts else docs.sparkSession.createDataFrame([], _LEAK)


def _digests(uri: str, threshold: float):
    """Texts -> the SHA-256 of those that hold an item of the block."""

    def held(batches):
        index = index_of(uri)
        for batch in batches:
            texts = [x.as_py() for x in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"digest": pa.array([hashlib.sha256(x.encode("utf-8", "replace")).digest() for x in texts if x and index.search(x, threshold)], pa.binary())})

    return held


def _filter(uri: str, text: str, threshold: float):
    def clean(batches):
        index = index_of(uri)
        for batch in batches:
            free = [not index.search(x.as_py(), threshold) for x in batch.column(batch.schema.get_field_index(text))]
            yield batch.filter(pa.array(free, pa.bool_()))

    return clean


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item. One block of items is a filter. Of several each task holds
    one; they find the digests of the texts that hold an item, and these texts go in one join."""
    uris = item_blocks(benchmark, item_id, item_text)
    if len(uris) < 2:
        return docs.mapInArrow(frugal(_filter(uris[0], text, threshold)), docs.schema) if uris else docs
    found = [docs.select(text).mapInArrow(frugal(_digests(uri, threshold)), "digest binary") for uri in uris]
    digests = written(reduce(DataFrame.unionAll, found).distinct(), "digests")
    return docs.join(digests, F.unhex(F.sha2(F.col(text), 256)) == digests["digest"], "left_anti")
