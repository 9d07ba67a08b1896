"""Scoring by a Katz back-off bigram model over Good-Turing discounted counts.

Tokens are the words of the text with A-Z lower-cased, then one end; the end also stands before a text's first token.
Documents whose crc32(doc_id as text) mod 7 is ``HELD_OUT`` are scored but not learned from.

Model: P(w | v) = d(c) c(v w) / c(v) for a pair seen in training, else alpha(v) P(w); P(w) = d1(c) c(w) / N for a known
word, and what this leaves goes to the one unknown word. d and d1 are Katz's Good-Turing discounts of counts up to
``K`` (counts above are trusted); where the counts of counts don't allow them, (r - D) / r with D = n1 / (n1 + 2 n2).
alpha(v) is the mass that the seen pairs of v leave over the mass that their words leave in P, so that
the probabilities of all words and the unknown one sum to 1 after every v. A v whose pairs leave nothing gets one more
count in its denominator, as has P if all words are frequent.

Evaluation is by exchange, never by collecting the vocabulary. Documents are written as blocks of encoded tokens.
Each block asks the shards of the unigram table, by word hash, for its own words, and the shards of the bigram
table, by the first word, for its own distinct pairs; a shard adds up what all blocks bring, keeps its part of
the table, and answers each block in the order it asked. Pairs of a very frequent first word are dealt over several
shards, whose sums the block adds. A word is asked for once a block, so frequent words are no hot keys, and what is
gathered grows with the corpus. Every stage is a written table, so lost executors repeat only their own tasks.

Edge cases: a null or empty text is its end alone; a null doc_id counts as the empty string in the crc; equal rows are
tokens of their own and get equal scores; without training documents every token is unknown; an empty table gives an
empty result; other columns are ignored. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from chronoflow.llm.store import Output, dropped, fresh_folder, open_input, written
from chronoflow.llm.textkit import U64, hash_words, lower_ascii, mix64

HELD_OUT, FOLDS = 2, 7
K = 5
BLOCK_TOKENS = 3_000_000
SHARD_BYTES = 32 << 20
END = U64(0x0E4D0E4D0E4D0E4D)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def pack(a: np.ndarray) -> bytes:
    """An array, its bytes dealt by place in the value and compressed."""
    return struct.pack("<B", a.dtype.itemsize) + zstandard.compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T).tobytes(), 1)


def unpack(data: bytes, kind) -> np.ndarray:
    width, raw = data[0], np.frombuffer(zstandard.decompress(data[1:]), np.uint8)
    stored = np.dtype({1: "u1", 2: "<u2", 4: "<u4", 8: "<u8"}[width])
    a = np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(stored)
    return a.view(kind) if np.dtype(kind).itemsize == width else a.astype(kind)


def small(a: np.ndarray) -> np.ndarray:
    """The array in the narrowest unsigned type that holds it."""
    top = int(a.max()) if len(a) else 0
    return a.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8")


class Discounts(NamedTuple):
    """Good-Turing discounts of counts 1 to K, from the counts of counts 1 to K + 1."""

    factors: tuple[float, ...]

    @staticmethod
    def of(n: list[int]) -> Discounts:
        n1, n2 = n[0], n[1]
        plain = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        cut = (K + 1) * n[K] / n1 if n1 else 1.0
        out = []
        for r in range(1, K + 1):
            d = ((r + 1) * n[r] / (r * n[r - 1]) - cut) / (1 - cut) if n[r - 1] and cut < 1 else 0.0
            out.append(d if 0 < d < 1 else (r - plain) / r)
        return Discounts(tuple(out))

    def table(self) -> np.ndarray:
        """Discounts by count, the last for all larger ones."""
        return np.array([1.0, *self.factors, 1.0])


class Unigrams(NamedTuple):
    """What the unigram level needs besides a word's count."""

    tokens: int
    types: int
    discounts: Discounts
    kept: float  # the sum of d1(c) c over all words

    @property
    def total(self) -> float:
        return self.tokens if self.tokens - self.kept > 1e-9 * max(1, self.tokens) else self.tokens + 1

    def probability(self, count: np.ndarray) -> np.ndarray:
        d = self.discounts.table()[np.minimum(count, K + 1)]
        unknown = (self.total - self.kept) / self.total if self.tokens else 1.0
        return np.where(count > 0, d * count / max(self.total, 1), unknown)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 1) / (self.tokens + self.types + 1))


class Block(NamedTuple):
    ids: np.ndarray
    null: np.ndarray
    held: np.ndarray
    lengths: np.ndarray
    tokens: np.ndarray  # places in vocab
    vocab: np.ndarray  # sorted hashes

    def write(self, uri: str) -> None:
        parts = [pack(self.ids), pack(self.null), pack(self.held), pack(small(self.lengths)), pack(small(self.tokens)), pack(self.vocab)]
        out = Output(uri)
        out.write(struct.pack("<6Q", *map(len, parts)) + b"".join(parts))
        out.close()

    @staticmethod
    def read(uri: str) -> Block:
        with open_input(uri) as f:
            data = f.read()
        at, parts = 48, []
        for n in struct.unpack("<6Q", data[:48]):
            parts.append(data[at : at + n])
            at += n
        return Block(*(unpack(p, k) for p, k in zip(parts, (np.int64, np.uint8, np.uint8, np.int64, np.int64, np.uint64))))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (previous, word) pairs as one number each, which each token is, and which tokens are learned."""
        end = int(np.searchsorted(self.vocab, END))
        previous = np.empty_like(self.tokens)
        previous[1:] = self.tokens[:-1]
        previous[np.cumsum(self.lengths) - self.lengths] = end
        keys, which = np.unique(previous * len(self.vocab) + self.tokens, return_inverse=True)
        return keys, which, np.repeat(self.held == 0, self.lengths)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Equal stretches of the hash range, so that sorted hashes have sorted shards."""
    return ((hashes >> U64(32)) * U64(shards) >> U64(32)).astype(np.int64)


def _segments(shard: np.ndarray):
    """(shard, start, stop) of the runs of a sorted array."""
    edges = np.flatnonzero(np.diff(shard)) + 1
    starts = np.concatenate([[0], edges]) if len(shard) else []
    for a, b in zip(starts, [*edges, len(shard)]):
        yield int(shard[a]), int(a), int(b)


_ASK = "block string, shard int, a binary, b binary, c binary, d binary"


def _asks(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["block", "shard", "a", "b", "c", "d"])


def _blocks(folder: str, shards: int, size: int):
    def finish(ids, words):
        lengths = np.array([len(w) for w in words], np.int64)
        vocab, tokens = np.unique(np.concatenate(words), return_inverse=True)
        null, held = np.array([i is None for i in ids], np.uint8), np.array([held_out(i) for i in ids], np.uint8)
        block = Block(np.array([i or 0 for i in ids], np.int64), null, held, lengths, tokens.astype(np.int64), vocab)
        name = uuid.uuid4().hex
        block.write(f"{folder}/{name}")
        learned = np.bincount(block.tokens[np.repeat(held == 0, lengths)], minlength=len(vocab))
        yield _asks([(name, s, pack(vocab[a:b]), pack(small(learned[a:b])), None, None) for s, a, b in _segments(shard_of(vocab, shards))])

    def encode(batches):
        ids, words, n = [], [], 0
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                w = hash_words(lower_ascii(x.as_py()))
                words.append(np.append(w, END))
                ids.append(i)
                n += len(w) + 1
                if n >= size:
                    yield from finish(ids, words)
                    ids, words, n = [], [], 0
        if ids:
            yield from finish(ids, words)

    return encode


_ANSWER = "kind string, block string, shard int, a binary, b binary, c binary, d binary, e binary, n array<double>"


def _answers(rows: list[tuple]) -> pa.Table:
    kinds = [pa.string(), pa.string(), pa.int32(), *[pa.binary()] * 5, pa.list_(pa.float64())]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=["kind", "block", "shard", "a", "b", "c", "d", "e", "n"])


def _by_size(counts: np.ndarray) -> list[float]:
    return [float((counts == r).sum()) for r in range(1, K + 2)]


def _merge_words(table: pa.Table) -> pa.Table:
    rows = table.to_pylist()
    asked = [unpack(r["a"], np.uint64) for r in rows]
    words, which = np.unique(np.concatenate(asked), return_inverse=True)
    counts = np.zeros(len(words), np.int64)
    np.add.at(counts, which, np.concatenate([unpack(r["b"], np.int64) for r in rows]))
    shard, at, out = rows[0]["shard"], 0, []
    for r, a in zip(rows, asked):
        place = which[at : at + len(a)]
        at += len(a)
        out.append(("words", r["block"], shard, pack(small(counts[place])), pack(small(np.diff(place, prepend=0))), None, None, None, None))
    known = counts > 0
    n = [float(counts.sum()), float(known.sum()), float(len(words)), *_by_size(counts), *[float(counts[counts == r].sum()) for r in range(1, K + 1)]]
    out.append(("unigrams", None, shard, pack(words[known]), pack(small(counts[known])), None, None, None, n))
    return _answers(out)


def _in_order(rows: list[dict], kind: str) -> list[dict]:
    return sorted((r for r in rows if r["kind"] == kind), key=lambda r: r["shard"])


def _word_answers(rows: list[dict], starts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and global numbers of a block's words."""
    parts = _in_order(rows, "words")
    counts = np.concatenate([unpack(r["a"], np.int64) for r in parts])
    return counts, np.concatenate([np.cumsum(unpack(r["b"], np.int64)) + starts[r["shard"]] for r in parts])


def _pair_shards(previous: np.ndarray, word: np.ndarray, count: np.ndarray, tokens: int, shards: int) -> np.ndarray:
    """The shard of each pair: by its first word, and for one with more than half a shard's share of all tokens by the
    second too."""
    parts = np.maximum(1, -(-2 * shards * count // max(tokens, 1)))
    return ((mix64(previous.astype(U64)) + mix64(word.astype(U64)) % parts.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(33)).astype(np.int64) % shards


def _ordered_pairs(block: Block, counts: np.ndarray, numbers: np.ndarray, uni: Unigrams, shards: int):
    """Distinct pairs in the order in which a block asks: by shard, then by number."""
    keys, which, learned = block.pairs()
    first, second = keys // len(block.vocab), keys % len(block.vocab)
    shard = _pair_shards(numbers[first], numbers[second], counts[first], uni.tokens, shards)
    order = np.lexsort((keys, shard))
    return first, second, which, learned, shard, order


def _ask_pairs(folder: str, starts: dict[int, int], uni: Unigrams, shards: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows, name = table.to_pylist(), key[0].as_py()
        block = Block.read(f"{folder}/{name}")
        counts, numbers = _word_answers(rows, starts)
        first, second, which, learned, shard, order = _ordered_pairs(block, counts, numbers, uni, shards)
        n = np.bincount(which[learned], minlength=len(first))
        out = []
        for s, a, b in _segments(shard[order]):
            o = order[a:b]
            out.append((name, s, pack(small(np.diff(numbers[first[o]], prepend=0))), pack(small(numbers[second[o]])), pack(small(n[o])), pack(small(counts[second[o]]))))
        return pa.Table.from_batches([_asks(out)])

    return ask


def _merge_pairs(uni: Unigrams):
    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        previous = [np.cumsum(unpack(r["a"], np.int64)) for r in rows]
        both, second = np.concatenate(previous), np.concatenate([unpack(r["b"], np.int64) for r in rows])
        count, word = np.concatenate([unpack(r["c"], np.int64) for r in rows]), np.concatenate([unpack(r["d"], np.int64) for r in rows])
        order = np.lexsort((second, both))
        new = np.ones(len(order), bool)
        new[1:] = (both[order][1:] != both[order][:-1]) | (second[order][1:] != second[order][:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        total = np.bincount(which, weights=count).astype(np.int64)
        at = order[new]
        # Of each first word: how often it was followed, by how many words r times, and these words' mass in P.
        heads, head = np.unique(both[at], return_inverse=True)
        seen = total > 0
        add = lambda x: np.bincount(head[seen], weights=x[seen], minlength=len(heads))
        sums = np.stack([add(total), *[add((total == r).astype(float)) for r in range(1, K + 1)], add(uni.probability(word[at]))])
        shard, begin, out = rows[0]["shard"], 0, []
        for r, p in zip(rows, previous):
            place = which[begin : begin + len(p)]
            begin += len(p)
            own = head[place[np.concatenate([[True], p[1:] != p[:-1]])]]
            out.append(("pairs", r["block"], shard, pack(small(total[place])), pack(small(sums[0][own])), pack(small(sums[1 : K + 1][:, own].reshape(-1))), pack(sums[K + 1][own]), None, None))
        out.append(("bigrams", None, shard, pack(small(np.diff(both[at][seen], prepend=0))), pack(small(second[at][seen])), pack(small(total[seen])), None, None, _by_size(total)))
        return _answers(out)

    return merge


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(folder: str, starts: dict[int, int], uni: Unigrams, pair: Discounts, shards: int):
    def score(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        block = Block.read(f"{folder}/{key[0].as_py()}")
        counts, numbers = _word_answers(rows, starts)
        first, second, which, _, shard, order = _ordered_pairs(block, counts, numbers, uni, shards)
        parts = _in_order(rows, "pairs")
        seen = np.empty(len(order), np.int64)
        seen[order] = np.concatenate([unpack(r["a"], np.int64) for r in parts])
        # The sums of each first word over the shards that hold its pairs.
        sums, at = np.zeros((K + 2, len(block.vocab))), 0
        for (s, a, b), r in zip(_segments(shard[order]), parts):
            f = first[order[a:b]]
            f = f[np.concatenate([[True], f[1:] != f[:-1]])]
            sums[0][f] += unpack(r["b"], np.int64)
            sums[1 : K + 1, f] += unpack(r["c"], np.int64).reshape(K, -1)
            sums[K + 1][f] += unpack(r["d"], np.float64)
        d = pair.table()
        # What is left after the seen pairs of each first word, of its count.
        left = sum((1 - d[r]) * r * sums[r] for r in range(1, K + 1))
        total = np.where(left > 1e-9, sums[0], sums[0] + 1)
        alpha = np.where(left > 1e-9, left, 1.0) / total / np.maximum(1 - sums[K + 1], 1e-300)
        alpha = np.where(sums[0] > 0, alpha, 1.0)
        p = np.where(seen > 0, d[np.minimum(seen, K + 1)] * seen / total[first], alpha[first] * uni.probability(counts[second]))
        with np.errstate(divide="ignore"):
            logs = np.log10(p)[which]
        start = np.cumsum(block.lengths) - block.lengths
        known, base = counts > 0, uni.base(counts)
        ids = pa.array(block.ids, pa.int64(), mask=block.null.astype(bool))
        n = len(ids)
        return pa.table(
            {
                "doc_id": ids, "held_out": pa.array(block.held.astype(bool)), "n_tokens": pa.array(block.lengths),
                "n_known": pa.array(np.add.reduceat(known[block.tokens].astype(np.int64), start)), "train_tokens": pa.array(np.full(n, uni.tokens, np.int64)),
                "base_score": pa.array(np.add.reduceat(base[block.tokens], start)), "score": pa.array(np.add.reduceat(logs, start)),
            }
        )

    return score


def _summed(answers: DataFrame, kind: str) -> list[float]:
    """The element-wise sum of a kind's n."""
    rows = answers.filter(F.col("kind") == kind).select(F.posexplode("n").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    return [x for _, x in sorted((r.k, r.x) for r in rows)]


def shards_for(docs: DataFrame) -> int:
    """A shard for each ``SHARD_BYTES`` that the plan reads, where that is known, and at least as many as shuffle
    partitions: what a shard holds does not grow with the corpus."""
    spark = docs.sparkSession
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES) if size < 1 << 50 else 0)


def katz_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS, shards: int | None = None) -> DataFrame:
    """Learns the model and scores every document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score (log10). ``shards``: into how many parts the tables are cut, by default by the size of ``docs``."""
    folder = fresh_folder(docs.sparkSession, "blocks")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    shards = shards or shards_for(rows)
    asked = written(rows.mapInArrow(_blocks(folder, shards, block_tokens), _ASK), "words-asked")
    words = written(asked.repartition(shards, "shard").groupBy("shard").applyInArrow(_merge_words, _ANSWER), "unigrams")
    dropped(asked)
    n = [*_summed(words, "unigrams"), *[0.0] * (2 * K + 4)]
    discounts = Discounts.of([int(x) for x in n[3 : K + 4]])
    in_small = n[K + 4 : 2 * K + 4]
    kept = sum(d * x for d, x in zip(discounts.factors, in_small)) + n[0] - sum(in_small)
    uni = Unigrams(int(n[0]), int(n[1]), discounts, kept)
    # Where each shard's words start in the numbering of all words; a number a shard.
    starts, at = {}, 0
    for r in sorted(words.filter("kind = 'unigrams'").select("shard", F.col("n")[2].alias("n")).collect()):
        starts[r.shard] = at
        at += int(r.n)
    answers = words.filter("kind = 'words'")
    pairs = answers.repartition(shards, "block").groupBy("block").applyInArrow(_ask_pairs(folder, starts, uni, shards), _ASK)
    bigrams = written(pairs.repartition(shards, "shard").groupBy("shard").applyInArrow(_merge_pairs(uni), _ANSWER), "bigrams")
    pair = Discounts.of([int(x) for x in [*_summed(bigrams, "bigrams"), *[0.0] * (K + 1)][: K + 1]])
    both = answers.unionByName(bigrams.filter("kind = 'pairs'"))
    return both.repartition(shards, "block").groupBy("block").applyInArrow(_scored(folder, starts, uni, pair, shards), _SCORE)
