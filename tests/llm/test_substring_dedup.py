"""Suffix arrays against sorting, and removed bytes against all windows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from chronoflow.llm import substring_dedup as sd
from chronoflow.llm.suffix_arrays import common_prefixes, suffix_array

KIND = "doc_id long, text string, n_bytes int, part string"


@pytest.mark.parametrize("symbols", (1, 2, 3, 20, 256))
def test_suffix_arrays_equal_sorting(symbols):
    r = random.Random(symbols)
    for n in [0, 1, 2, 3, *(r.randrange(4, 300) for _ in range(150))]:
        text = bytes(r.randrange(symbols) for _ in range(n))
        text = (text[: n // 5] * 5 + text)[:n] if n % 2 else text
        data = np.frombuffer(text, np.uint8)
        array = suffix_array(data, 256)
        assert array.tolist() == sorted(range(n), key=lambda k: text[k:])  # noqa: B023
        shared = common_prefixes(data, array)
        for a, b in zip(array[:-1], array[1:], strict=True):
            k = 0
            while max(a, b) + k < n and text[a + k] == text[b + k]:
                k += 1
            assert shared[b] == k


def test_segments_cover_each_window_once_and_equal_windows_share_a_gram():
    r = random.Random(4)
    texts = [bytes(r.randrange(97, 123) for _ in range(n)) for n in (0, 5, 99, 100, 101, 700, 3000)] + [b"ab" * 200, b"x" * 400]
    texts += [texts[6][500:900] + texts[5][:300], texts[5]]
    ends = np.cumsum([len(x) for x in texts])
    data = b"".join(texts)
    gram, content, at, n = sd.segments(np.frombuffer(data, np.uint8), ends)
    begin = np.r_[0, ends[:-1]]
    wanted = {b + k for b, x in zip(begin, texts, strict=True) for k in range(len(x) - 99)}
    covered = [int(a) + k for a, m in zip(at, n, strict=True) for k in range(m)]
    assert sorted(covered) == sorted(wanted)
    grams = {}
    for g, a, m in zip(gram, at, n, strict=True):
        for k in range(a, a + m):
            assert grams.setdefault(data[k : k + 100], g) == g
    whole = {}
    for g, c, a, m in zip(gram, content, at, n, strict=True):
        assert whole.setdefault((g, c), data[a : a + m + 99]) == data[a : a + m + 99]


@pytest.mark.parametrize("width", sd.WIDTHS)
def test_cuts_of_large_classes_are_few_and_keep_equal_windows_together(width):
    r = random.Random(width)
    text = lambda n: bytes(r.randrange(97, 123) for _ in range(n))
    middle = text(80)
    texts = [text(120) + middle + text(120) for _ in range(20)]
    texts += [texts[0][:260] + text(30), text(30) + texts[1][60:], b"x" * 300, b"ab" * 90]
    data, ends = b"".join(texts), np.cumsum([len(x) for x in texts])
    _, _, at, n = sd.segments(np.frombuffer(data, np.uint8), ends)
    rows = {"doc": at, "place": at, "part": at, "bytes": [data[a : a + m + 99] for a, m in zip(at, n, strict=True)]}
    (out,) = sd._cut(width)([pa.RecordBatch.from_pydict(rows)])
    assert out.num_rows <= (int(n.sum()) if width == 1 else len(at) * (-(-sd.SPAN // width) + 1))
    assert width < 35 or out.num_rows <= 2 * len(at)
    gram, content, _, place, m, _ = (c.to_pylist() for c in out.columns)
    assert sorted(p + k for p, k_ in zip(place, m, strict=True) for k in range(k_)) == sorted(a + k for a, k_ in zip(at, n, strict=True) for k in range(k_))
    grams, whole = {}, {}
    for g, c, p, k_ in zip(gram, content, place, m, strict=True):
        assert whole.setdefault((g, c), data[p : p + k_ + 99]) == data[p : p + k_ + 99]
        for k in range(k_):
            assert grams.setdefault(data[p + k : p + k + 100], g) == g


def walk(rows):
    """Rows of (doc_id, text), ids different."""
    seen, out = set(), []
    for doc_id, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - 99):
            w = data[k : k + 100]
            if w in seen:
                gone[k : k + 100] = True
            seen.add(w)
        kept = bytes(b for b, x in zip(data, gone, strict=True) if not x)
        out.append((doc_id, len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = [prose(r.randrange(150)) for _ in range(40)]
    notice = prose(40)
    texts = base + [notice[k:] + prose(20) for k in range(5)] + [prose(9) + notice + prose(9) for _ in range(30)]
    for _ in range(30):
        x = r.choice(base)
        a, b = sorted((r.randrange(len(x) + 1), r.randrange(len(x) + 1)))
        texts.append(r.choice((x, x[a:b] + prose(10), prose(3) + x[a:], x[:a] + "Z" + x[a:], x + x)))
    texts += [None, "", "w " * 500, "w " * 300, "abcde" * 60, "É" * 300, "x" * 99, "x" * 100, "x" * 101]
    r.shuffle(texts)
    return [(k * 3, x, 1, "z") for k, x in enumerate(texts)]


@pytest.mark.parametrize("large, chunk", ((sd.LARGE, sd.CHUNK), (4, 60)))
def test_equals_all_windows(spark, monkeypatch, large, chunk):
    monkeypatch.setattr(sd, "LARGE", large)
    monkeypatch.setattr(sd, "CHUNK", chunk)
    monkeypatch.setattr(sd, "SHARD", 1000 * chunk)
    rows = corpus(chunk)
    got = sd.repeated_bytes(spark.createDataFrame(rows, KIND).repartition(3)).collect()
    assert sorted(map(tuple, got)) == walk([x[:2] for x in rows])


def test_repeated_ids_null_ids_and_empty_tables(spark):
    r = random.Random(6)
    text, other = ("".join(chr(r.randrange(97, 123)) for _ in range(300)) for _ in range(2))
    rows = [(None, text), (4, text), (4, text), (4, other), (9, other + "!")]
    got = sorted(map(tuple, sd.repeated_bytes(spark.createDataFrame([(*x, 1, "z") for x in rows], KIND)).collect()), key=str)
    assert [x[:3] for x in got] == [(4, 300, 0), (4, 300, 300), (4, 300, 300), (9, 301, 300), (None, 300, 0)]
    assert sd.repeated_bytes(spark.createDataFrame([], KIND)).collect() == []


def test_pieces_of_long_texts_meet(monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 1000)
    r = random.Random(8)
    text = bytes(r.randrange(97, 123) for _ in range(5300))
    windows = []
    for data, ends, which, first in sd._pieces([text, b"", text[:50], text[:999]]):
        gram, content, at, n = sd.segments(data, ends)
        own = np.searchsorted(ends, at, "right")
        place = first[own] + at - np.r_[0, ends[:-1]][own]
        windows += [(int(which[o]), int(p) + k) for o, p, m in zip(own, place, n, strict=True) for k in range(m)]
    assert sorted(windows) == [(0, k) for k in range(5201)] + [(3, k) for k in range(900)]
