"""Periodic runs against all starts and periods by brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa

from chronoflow.llm import periodic_runs as pr

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words):
    """Every period's maximal stretches; of equal stretches the smallest period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        k = 0
        while k + q < len(words):
            z = k
            while z + q < len(words) and words[z] == words[z + q]:
                z += 1
            if z - k + q >= max(6, 4 * q):
                found.setdefault((k, z - k + q), q)
            k = max(z, k) + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def planted(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
    return words


def expected(doc_id, words):
    runs = brute(words)
    out = {k for a, n, q in runs for k in range(a + q, a + n)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, sha("".join(f"{a},{n},{q}\n" for a, n, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in out)))


def samples():
    r = random.Random(5)
    texts = [["a"] * k for k in (1, 5, 6, 7, 40)] + [list("ab") * 4, list("ab") * 4 + ["a"], list("abc") * 5, ["a"] * 9 + list("ba") * 9]
    fibonacci = ["b", "a"]
    for _ in range(9):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    texts.append(list(fibonacci[-1]))
    for size in (1, 2, 3, 5):
        for n in (8, 30, 90, 200):
            texts.append([r.choice("abcde"[:size]) for _ in range(n)])
    for _ in range(60):
        unit = [r.choice("abcdefgh") for _ in range(r.randrange(1, 9))]
        texts.append([r.choice("abcdefgh") for _ in range(r.randrange(20))] + unit * r.randrange(1, 9) + unit[: r.randrange(len(unit))] + [r.choice("ab") for _ in range(r.randrange(20))])
        texts.append((unit * 5 + ["x"]) * r.randrange(1, 7))
    return texts


def test_runs_of_many_documents_equal_brute_force():
    texts = samples()
    pool = pr.Pool()
    for k, words in enumerate(texts):
        data = [w.encode() for w in words]
        pool.add(k, data, np.arange(len(data)), np.zeros(len(data), np.int64))
    for (k, runs, kept), words in zip(pool.flush(), texts, strict=True):
        assert [tuple(x.values()) for x in runs] == brute(words), words
        out = {i for a, n, q in brute(words) for i in range(a + q, a + n)}
        assert kept.decode().split() == [w for i, w in enumerate(words) if i not in out]


def test_words_set_aside_are_in_no_run():
    texts = samples()
    words = [w for x in texts for w in x]
    doc = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
    numbers = np.unique(words, return_inverse=True)[1].astype(np.uint64)
    pos, _ = pr.stretches(numbers, doc)
    kept, at = set(pos.tolist()), 0
    for x in texts:
        assert all(at + k in kept for a, n, _ in brute(x) for k in range(a, a + n))
        at += len(x)
    r = random.Random(1)
    assert not len(pr.stretches(np.array([r.randrange(3000) for _ in range(5000)], np.uint64), np.zeros(5000, np.int64))[0])


def test_small_pools_and_batches_give_the_same(monkeypatch):
    texts = [" ".join(x) for x in samples()]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    rows = lambda: sorted((x for b in pr.find_runs(iter([batch, batch[:9]])) for x in b.to_pylist()), key=repr)
    whole = rows()
    monkeypatch.setattr(pr, "POOL", 50)
    monkeypatch.setattr(pr, "WORDS", 90)
    assert rows() == whole and len(whole) == len(texts) + 9


def test_query_equals_brute_force(spark):
    texts = [" ".join(x) for x in samples()] + [None, "", " \n\t ", "x", "a  b\na\tb a b a b", "É É É É É É", " q " * 300, "u\x85v " * 7, "a\x1cb " * 6]
    r = random.Random(9)
    texts += [" ".join(r.choice(("so", "it", "is", "not", "all")) for _ in range(r.randrange(400))) for _ in range(60)]
    rows = [(k, x, 1, "z") for k, x in enumerate(texts)] + [(3, texts[3], 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, runs string").repartition(2)
    got = sorted(map(tuple, pr.digests(pr.periodic_runs(pr.repeated_ends(docs))).collect()))
    assert got == sorted(expected(k, planted(k, x)) for k, x, *_ in rows)


def test_null_ids_and_empty_tables(spark):
    kind = "doc_id long, text string"
    got = pr.digests(pr.periodic_runs(pr.repeated_ends(spark.createDataFrame([(None, "a " * 8)], kind)))).collect()
    assert [tuple(x) for x in got] == [expected(None, ["a"] * 8)]
    assert pr.digests(pr.periodic_runs(pr.repeated_ends(spark.createDataFrame([], kind)))).collect() == []


def test_a_long_periodic_text_takes_little_time():
    r = random.Random(2)
    unit = [r.randrange(500) for _ in range(2500)]
    words = np.array(unit * 16 + [0])
    start, length, period = pr.runs_of(words, np.zeros(len(words), np.int64))
    assert (0, 40000, 2500) in {(a, n - n % 2500, q) for a, n, q in zip(start.tolist(), length.tolist(), period.tolist(), strict=True)}
