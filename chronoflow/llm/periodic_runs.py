"""Maximal periodic runs of words, by Crochemore's partition refinement.

Positions of equal factors of length L are one class. From length L to L + 1 a class falls apart by the classes of the
positions behind its members; only the smaller parts of what fell apart before need to be looked at, so a position is moved
O(log n) times. The members of a class are a linked list in order of position. Neighbours at distance L while the length
is L are a square with a primitive root, and squares of one period at consecutive positions are one run. Many documents
go through each step together as numpy arrays.

Before that, words that cannot be in a run are set aside, exactly: a run of at least four periods in a stretch of m words
has a period of at most m / 4, and each of its words has its like within that distance in the stretch. Words without such
a like cut their stretch in two, and so on until nothing changes; what is left is refined.

A null or empty text has no words and no runs. Equal rows give equal rows, a null doc_id is passed on, extra columns are not
read, an empty table gives an empty one. A document is handled whole, by one task; the memory is bounded by a batch of
documents or the longest one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoflow.llm.textkit import frugal, hash_words, mix64

EXPONENT = 4
SHORTEST = 6
POOL = 1_000_000
WORDS = 2_000_000
RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_LOW = np.uint64(24)
_BITS = np.uint64((1 << 24) - 1)
U64 = np.uint64


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of each range [start, start + size), one after the other."""
    total = np.cumsum(size)
    return np.arange(total[-1] if len(size) else 0) + np.repeat(start - total + size, size)


def stretches(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positions that can be in a run, ascending, and the number of the stretch of each. ``hashes``: of words, equal
    for equal ones; ``doc``: of each position, ascending. Of more than 2**24 positions all are kept."""
    pos, part = np.arange(len(doc)), doc
    if len(pos) > int(_BITS) + 1:
        return pos, part
    while len(pos):
        new = np.r_[True, (np.diff(pos) > 1) | (np.diff(part) != 0)]
        part = np.cumsum(new) - 1
        size = np.bincount(part)
        limit = np.where(size >= SHORTEST, size // EXPONENT, 0)
        with np.errstate(over="ignore"):
            key = mix64(hashes[pos] + part.astype(U64) * U64(0x9E3779B97F4A7C15))
        key = np.sort((key & ~_BITS) | np.arange(len(pos), dtype=U64))
        at = (key & _BITS).astype(np.int64)
        near = ((key[1:] ^ key[:-1]) >> _LOW == 0) & (pos[at[1:]] - pos[at[:-1]] <= limit[part[at[1:]]])
        keep = np.zeros(len(pos), bool)
        keep[at[1:][near]] = True
        keep[at[:-1][near]] = True
        if keep.all():
            break
        pos, part = pos[keep], part[keep]
    return pos, part


def squares(word: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and periods of all primitively rooted squares with a period of at most ``limit`` (of each position).
    ``word``: numbers, equal for equal words of one stretch only; each stretch ends with a number of its own and a limit
    of 0 there, and limits within a stretch are equal."""
    n = len(word)
    arr = np.argsort(word, kind="stable")  # the members of a class stand together
    head = np.flatnonzero(np.r_[True, word[arr[1:]] != word[arr[:-1]]])
    count = len(head)
    start, size, cls, loc = np.zeros(n, np.int64), np.zeros(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    start[:count], size[:count] = head, np.diff(np.r_[head, n])
    cls[arr] = np.repeat(np.arange(count), size[:count])
    loc[arr] = np.arange(n)
    nxt, prv, since = np.full(n + 1, n), np.full(n + 1, n), np.ones(n + 1, np.int64)
    linked = cls[arr[1:]] == cls[arr[:-1]]
    nxt[arr[:-1][linked]], prv[arr[1:][linked]] = arr[1:][linked], arr[:-1][linked]
    moved = np.zeros(n, bool)
    found_at, found_period = [], []

    def note(x: np.ndarray, upto: np.ndarray) -> None:
        """Squares among neighbours x, nxt[x] that were so from length since[x] to ``upto``."""
        gap = nxt[x] - x
        ok = (nxt[x] < n) & (since[x] <= gap) & (gap <= upto)
        if ok.any():
            found_at.append(x[ok])
            found_period.append(gap[ok])

    # At first the largest class of each stretch is left out.
    stretch = np.cumsum(np.r_[0, (limit[:-1] == 0)])[arr[head]] if n else head
    by = np.lexsort((size[:count], stretch))
    splitters = by[:-1][stretch[by[1:]] == stretch[by[:-1]]] if count else by
    ends = np.flatnonzero(limit == 0)  # the ends of stretches always split
    splitters = np.union1d(splitters, cls[ends])
    length = 0
    while len(splitters):
        length += 1
        s = arr[_ranges(start[splitters], size[splitters])] - 1
        cause = np.repeat(splitters, size[splitters])
        ok = s >= 0
        s, cause = s[ok], cause[ok]
        ok = (limit[s] > length) & (size[cls[s]] > 1)
        s, cause = s[ok], cause[ok]
        old = cls[s]
        by = np.lexsort((s, cause, old))
        s, cause, old = s[by], cause[by], old[by]
        splitters = s[:0]
        if not len(s):
            break
        # Groups of one class and cause. Where a whole class goes, its largest group stays.
        g = np.flatnonzero(np.r_[True, (old[1:] != old[:-1]) | (cause[1:] != cause[:-1])])
        gsize, gold = np.diff(np.r_[g, len(s)]), old[g]
        c = np.flatnonzero(np.r_[True, gold[1:] != gold[:-1]])
        which = np.repeat(np.arange(len(c)), np.diff(np.r_[c, len(g)]))
        went, most = np.add.reduceat(gsize, c), np.maximum.reduceat(gsize, c)
        whole = went == size[gold[c]]
        largest = np.flatnonzero(gsize == most[which])
        largest = largest[np.r_[True, which[largest[1:]] != which[largest[:-1]]]]  # the first of each class
        stay = np.zeros(len(g), bool)
        stay[largest[whole]] = True
        if stay.any():
            keep = ~np.repeat(stay, gsize)
            s, gsize, gold = s[keep], gsize[~stay], gold[~stay]
            if not len(s):
                break
            c = np.flatnonzero(np.r_[True, gold[1:] != gold[:-1]])
            which = np.repeat(np.arange(len(c)), np.diff(np.r_[c, len(gsize)]))
            went, most = np.add.reduceat(gsize, c), np.maximum.reduceat(gsize, c)
            largest = np.flatnonzero(gsize == most[which])
            largest = largest[np.r_[True, which[largest[1:]] != which[largest[:-1]]]]
        classes = gold[c]
        new = count + np.arange(len(gsize))
        count += len(gsize)
        # Out of the old lists: chains of neighbours that go together.
        x = s[np.lexsort((s, np.repeat(gold, gsize)))]
        apart = nxt[x[:-1]] != x[1:]
        first, last = x[np.r_[True, apart]], x[np.r_[apart, True]]
        p, q = prv[first], nxt[last]
        inner = p[p < n]
        note(np.r_[x, inner], length)
        nxt[p], prv[q], since[p] = q, p, length + 1
        # Into lists of their own.
        bounds = np.cumsum(gsize)
        same = np.ones(len(s), bool)
        same[bounds - 1] = False
        nxt[s] = np.where(same, np.r_[s[1:], n], n)
        same = np.r_[False, same[:-1]]
        prv[s] = np.where(same, np.r_[n, s[:-1]], n)
        since[s] = length + 1
        # To the tails of the classes' places.
        tail_at = start[classes] + size[classes] - went
        tail = _ranges(tail_at, went)
        moved[s] = True
        there = arr[tail]
        back = there[~moved[there]]
        holes = loc[s]
        holes = holes[holes < np.repeat(tail_at, went)]
        arr[holes], loc[back] = back, holes
        arr[tail], loc[s] = s, tail
        moved[s] = False
        cls[s] = np.repeat(new, gsize)
        start[new], size[new] = tail[bounds - gsize], gsize
        size[classes] -= went
        # The largest part of each class is not looked at again.
        rest = size[classes]
        smaller = rest < most
        chosen = np.ones(len(new), bool)
        chosen[largest[smaller]] = False
        splitters = np.r_[new[chosen], classes[smaller]]
    every = np.arange(n)
    note(every, limit)
    if not found_at:
        return every[:0], every[:0]
    return np.concatenate(found_at), np.concatenate(found_period)


def runs_of(word: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (first place, length, period) among words in stretches: equal numbers for equal words; places count from the
    first row of ``word``, no run crosses stretches."""
    n = len(word)
    if not n:
        return (np.empty(0, np.int64),) * 3
    size = np.bincount(part)
    own = part * (word.max() + 1) + word
    ends = np.cumsum(size) + np.arange(len(size))
    place = np.arange(n) + part
    laid, limit = np.empty(n + len(size), np.int64), np.zeros(n + len(size), np.int64)
    laid[place], limit[place] = own, (size // EXPONENT)[part]
    laid[ends] = own.max() + 1 + np.arange(len(size))
    at, period = squares(laid, limit)
    by = np.lexsort((at, period))
    at, period = at[by], period[by]
    first = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(period) != 0)]) if len(at) else at
    start, q = at[first], period[first]
    length = np.diff(np.r_[first, len(at)]) - 1 + 2 * q
    ok = length >= np.maximum(SHORTEST, EXPONENT * q)
    back = np.empty(n + len(size), np.int64)
    back[place] = np.arange(n)
    return back[start[ok]], length[ok], q[ok]


class Pool:
    """Documents whose words may be in runs, refined together."""

    def __init__(self) -> None:
        self.docs: list[tuple] = []
        self.size = 0

    def add(self, doc_id, words: list[bytes], pos: np.ndarray, part: np.ndarray) -> None:
        self.docs.append((doc_id, words, pos, part))
        self.size += len(pos)

    def flush(self) -> list[tuple]:
        numbers: list[int] = []
        for _, words, pos, _ in self.docs:
            known: dict[bytes, int] = {}
            numbers += [known.setdefault(words[k], len(known)) for k in pos]
        if not self.docs:
            return []
        cut = np.cumsum([0, *(len(pos) for _, _, pos, _ in self.docs)])
        part = np.cumsum(np.concatenate([np.r_[1, np.diff(p) != 0] for *_, p in self.docs])) - 1
        at, length, period = runs_of(np.array(numbers), part)
        doc = np.searchsorted(cut, at, "right") - 1
        by = np.lexsort((period, at))
        edge = np.searchsorted(doc[by], np.arange(len(self.docs) + 1))
        rows = []
        for k, (doc_id, words, pos, _) in enumerate(self.docs):
            own = by[edge[k] : edge[k + 1]]
            start = pos[at[own] - cut[k]]
            rows.append(finished(doc_id, words, start, length[own], period[own]))
        self.docs, self.size = [], 0
        return rows


def finished(doc_id, words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """A row of ``RUNS``. Of each run the words behind its first period are dropped."""
    if len(start):
        depth = np.zeros(len(words) + 1, np.int64)
        np.add.at(depth, start + period, 1)
        np.add.at(depth, start + length, -1)
        words = [words[k] for k in np.flatnonzero(np.cumsum(depth)[:-1] == 0)]
    runs = [{"start": a, "length": b, "period": c} for a, b, c in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)]
    return doc_id, runs, b" ".join(words)


def _batches(docs):
    """Lists of (doc_id, words) with up to ``WORDS`` words, or one longer document."""
    held, n = [], 0
    for doc_id, data in docs:
        words = data.split()  # bytes split at blank, tab, line feed, vertical tab, form feed and carriage return only
        if held and n + len(words) > WORDS:
            yield held
            held, n = [], 0
        held.append((doc_id, words))
        n += len(words)
    if held:
        yield held


def find_runs(batches):
    """Arrow batches of doc_id, text -> batches of ``RUNS``."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def batch(rows: list[tuple], counts: list[int]) -> pa.RecordBatch:
        ids, runs, texts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(runs, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    pool = Pool()
    none = np.empty(0, np.int64)
    for arrow in batches:
        docs = zip(arrow.column(0).to_pylist(), (x or b"" for x in arrow.column(1).cast(pa.binary()).to_pylist()), strict=True)
        for held in _batches(docs):
            counts = np.array([len(words) for _, words in held])
            hashes = hash_words(b" ".join(b" ".join(words) for _, words in held))
            pos, part = stretches(hashes, np.repeat(np.arange(len(held)), counts))
            begin = np.cumsum(counts) - counts
            edge = np.searchsorted(pos, np.r_[begin, counts.sum()])
            done, sizes = [], []
            for k, (doc_id, words) in enumerate(held):
                a, z = edge[k], edge[k + 1]
                if a < z:
                    pool.add(doc_id, words, pos[a:z] - begin[k], part[a:z])
                else:
                    done.append(finished(doc_id, words, none, none, none))
                    sizes.append(len(words))
            if done:
                yield batch(done, sizes)
            if pool.size >= POOL:
                sizes = [len(words) for _, words, *_ in pool.docs]
                yield batch(pool.flush(), sizes)
    if pool.docs:
        sizes = [len(words) for _, words, *_ in pool.docs]
        yield batch(pool.flush(), sizes)


def periodic_runs(docs: DataFrame) -> DataFrame:
    """For each document (doc_id, text): its number of words, the runs of at least ``EXPONENT`` smallest periods and
    ``SHORTEST`` words by start and period, and its words without what runs repeat, joined by blanks."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(frugal(find_runs), RUNS)


def repeated_ends(docs: DataFrame) -> DataFrame:
    """doc_id and text, a tenth of the texts with a periodic end: with h the crc32 of the decimal doc_id, g = floor(h / 10)
    and n words, if h % 10 = 0 each word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + floor((n - a) / (3 + g % 8)).
    A null doc_id has no h and keeps its text."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)
    chosen = docs.select("doc_id", "text", g.alias("g"), (h % 10 == 0).alias("hit"))
    words = F.when(F.col("hit"), F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    r = chosen.withColumn("w", words).withColumn("n", F.size("w"))
    r = r.withColumn("a", F.when(F.col("n") > 0, F.try_mod(F.col("g"), F.col("n").cast("long")).cast("int")))
    r = r.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + F.try_mod(i - F.col("a"), F.col("p")))
    made: Column = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", place(i))), " ")
    return r.select("doc_id", F.when(F.col("a").isNotNull(), made).otherwise(F.col("text")).alias("text"))


def digests(runs: DataFrame) -> DataFrame:
    """The columns of the query from those of ``periodic_runs``."""
    order = lambda x, y: F.when(y["length"] * x["period"] != x["length"] * y["period"], F.signum(y["length"] * x["period"] - x["length"] * y["period"])).when(x["start"] != y["start"], F.signum(x["start"] - y["start"])).otherwise(F.signum(x["period"] - y["period"])).cast("int")
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    best = F.get(F.array_sort("runs", order), F.lit(0)).alias("best")
    r = runs.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best, F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(F.expr("(best.length * 1000) div best.period")).alias("exponent_milli")
    return r.select("doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")], milli, "runs_sha256", "collapsed_sha256")
