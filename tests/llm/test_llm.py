"""The operators of the subpackage against brute force, exact round trips and damaged inputs."""

import hashlib
import io
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoflow.llm import chat_format, decontaminate, katz, mix_sources, near_dedup, page_text, pii_spans, quality_lines, textkit, token_records, warc_archive

P = "one two three four five six seven eight nine ten eleven twelve".split()
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "x", "É ß　 \x1c\x85 b", "a" * 300_000, "w " * 60_000, "\U0001f600 \x00 <|endoftext|> don't"]


def prose(seed: int, n: int) -> str:
    r = np.random.default_rng(seed)
    return " ".join("".join(chr(97 + c) for c in r.integers(0, 26, 6)) + ("." if k % 9 == 8 else "") for k in range(n))


def documents(spark, texts, sources=None):
    """Documents with repeated rows' worth of extra columns whose names clash with results."""
    rows = [(k, x, (sources or ["s"] * len(texts))[k], 7, "z") for k, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, n_words long, kept string")


@pytest.fixture(scope="session")
def vocab():
    P = pytest.importorskip("public_tokenizers")
    return P.path("word_bpe_49k.json")


# Words and shingles


def test_word_hashes_tell_words_apart():
    for text in ["a b a", " x\n\ny\tz ", "é e", "", "ab a b", "　 a"]:
        words, h = WORD.findall(text), textkit.hash_words(text.encode())
        assert len(words) == len(h)
        assert all((a == b) == (x == y) for a, x in zip(words, h) for b, y in zip(words, h))
    long = prose(1, 100_000).encode()
    assert (textkit.hash_words(long) == textkit._hash_piece(long)).all()


# 1 Personal data


def base_spans(text):
    """The base patterns by plain search."""
    found = []
    for k, (kind, pattern) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            double = sum(int(x) if i % 2 == 0 else (2 * int(x)) // 10 + (2 * int(x)) % 10 for i, x in enumerate(digits[::-1]))
            if kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and double % 10 == 0) or (kind == "phone" and 9 <= len(digits) <= 15):
                found.append((k, m.start(), m.end()))
    return found


def test_base_spans_equal_plain_search():
    r = np.random.default_rng(2)
    alphabet = list("ab@.-+ 0123456789()%_\n")
    for _ in range(3000):
        text = "".join(r.choice(alphabet, r.integers(0, 60)))
        assert pii_spans.plain_spans(text) == base_spans(text)
    assert len(pii_spans.plain_spans("4111 1111 1111 1111 and +49 30 1234567 at a.b@c.de, 10.0.0.1")) == 4


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("mail mary at mail dot example dot org!", "email", "mary at mail dot example dot org"),
        ("call plus four nine one seven six five five five one two three four ok", "phone", "plus four nine one seven six five five five one two three four"),
        ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("x ４１１１１１１１１１１１１１１１ y", "card", "４１１１１１１１１１１１１１１１"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, part):
    assert [(pii_spans.KINDS[k], text[s:e], b) for k, s, e, b in pii_spans.all_spans(text)] == [(kind, part, False)]


@pytest.mark.parametrize(
    "text",
    ["jean arobase exemple point fr", "jean [arobase] exemple.fr", "ana (arroba) ejemplo.com", "jean@exemple(point)fr", "bob ( at ) example.com", "bob@example point fr", "bob\n@ example.com", "+49 six 30 123 45 67", "4111 1111 1111 1111".replace("4111", "4 un 11", 1), "plus 49 30 1234567"],
)
def test_the_gate_misses_no_disguise(text):
    assert [b for *_, b in pii_spans.all_spans(text) if not b] == [False]


def test_gated_equals_ungated(monkeypatch):
    r = np.random.default_rng(12)
    parts = [*pii_spans.DIGIT_WORDS, *pii_spans.DOT_WORDS, *pii_spans.AT_WORDS, *"plus double + @ . ( ) [ ] - _ , \u201e \u0130 \u00e9 SIX Point AT ( at) (. ) a@b x.de 10.0 30 1234567 4111".split(), "\x85", "\u2028", "\n"]
    few = ["un", "six", "dos", "tres", "point", "at", "arroba", "plus", "+4", "12", "30123", "bob", "exemple", "fr", "@", "(", ")", "."]
    texts = ["".join(x + str(r.choice(["", " ", " ", " ", "  "])) for x in r.choice(few if k % 2 else parts, r.integers(2, 14))) for k in range(30_000)]
    gated = [pii_spans.all_spans(x) for x in texts]
    monkeypatch.setattr(pii_spans, "_hinted", lambda text: True)
    assert gated == [pii_spans.all_spans(x) for x in texts] and sum(not b for x in gated for *_, b in x) > 100


def test_long_runs_cost_one_pass():
    began = time.process_time()
    for run in ("1" * 2_000_000, "1." * 500_000, "1 " * 500_000 + "point one", "+1" + " " * 500_000, "a" * 1_000_000 + "@", "six " * 200_000, "1" * 500_000 + " dot one"):
        pii_spans.all_spans(run)
    assert time.process_time() - began < 30


def test_prose_has_no_disguised_spans():
    for text in ["look at example.com one two", "we met at noon. The dot on the i", "foo @ bar. Baz", "one two three", prose(3, 500)]:
        assert pii_spans.all_spans(text) == []


def test_pii_query(spark):
    df = pii_spans.digests(pii_spans.pii_spans(documents(spark, [*ODD, "a@b.c and a (at) b (dot) c"])))
    last = df.where("doc_id = 8").first()
    assert (last.n_email, last.n_added, last.n_spans, last.spans) == (1, 1, 2, "email:0:5,email:10:26")
    assert last.base_sha256 == hashlib.sha256(b"email:0:5").hexdigest()
    assert df.count() == 9 and df.where("base_sha256 = sha2('', 256)").count() == 8
    assert pii_spans.masked(documents(spark, ["a@b.c x"])).first().text == "<email> x"
    assert pii_spans.pii_spans(documents(spark, ["x"]).limit(0)).count() == 0
    twice = documents(spark, ["a@b.c"]).unionByName(documents(spark, ["a@b.c"])).withColumn("spans", F.lit(1))
    assert [tuple(r) for r in pii_spans.digests(pii_spans.pii_spans(twice)).distinct().select("doc_id", "spans").collect()] == [(0, "email:0:5")]


# 2 Archives


def archive(n=6, size=400):
    return [warc_archive._member(warc_archive.page_record(k, f"http://h/{k}", prose(k, size).encode(), None, False, "2000-01-01T00:00:00Z")) for k in range(n)]


def salvaged(data):
    return list(warc_archive.salvage(io_file(data)))


def io_file(data):
    import pyarrow as pa

    return pa.PythonFile(io.BytesIO(data), mode="r")


def test_damage_costs_only_the_damaged_records():
    parts = archive()
    ids = lambda found: [x[3][0]["warc-record-id"] for x in found if x[0] == "record"]
    whole = salvaged(b"".join(parts))
    assert len(ids(whole)) == 6 and all(x[0] == "record" for x in whole)
    for bad in (parts[2][:50] + b"\0\0\0" + parts[2][53:], parts[2][: len(parts[2]) // 2], b"\x1f\x8b\x08 no member", b"WARC/1.1\r\ncontent-length: 99999999999\r\n\r\n"):
        data = b"".join([*parts[:2], bad, *parts[3:]])
        found = salvaged(data)
        assert ids(found) == [f"<urn:page:{k}>" for k in (0, 1, 3, 4, 5)]
        gap = [x for x in found if x[0] == "gap"]
        assert [(x[1], x[2]) for x in gap] == [(len(parts[0]) + len(parts[1]), len(parts[0]) + len(parts[1]) + len(bad))] and gap[0][3]
        assert sum(x[2] - x[1] for x in found) == len(data)


def test_plain_files_are_salvaged_by_version_lines():
    records = [zlib.decompress(x, 31) for x in archive(4)]
    bad = records[1][:-30] + bytes([records[1][-30] ^ 1]) + records[1][-29:]
    found = salvaged(records[0] + bad + records[2] + records[3])
    assert [x[0] for x in found] == ["record", "gap", "record", "record"] and "digest" in found[1][3]


def test_long_headers_and_forged_lengths():
    parts = [zlib.decompress(x, 31) for x in archive(3)]
    long = warc_archive.record_bytes("response", [("X-Long", "x" * 3_000_000), ("WARC-Record-ID", "<urn:page:9>")], b"block")
    forged = b"WARC/1.1\r\ncontent-length: 2000\r\n\r\n"
    found = salvaged(parts[0] + long + forged + parts[1] + parts[2])
    assert [x[0] for x in found] == ["record", "record", "gap", "record", "record"] and found[2][2] - found[2][1] == len(forged)
    assert [x[0] for x in salvaged(parts[0] + b"WARC/1.1\r\nno end" + b"y" * 3_000_000)] == ["record", "gap"]


def test_archive_of_nulls_and_repeated_rows(spark):
    big = "x" * 1000
    pages = spark.createDataFrame([(None, None, big), (None, None, big), (4, "u", big), (4, "u", big), (2, "u", big), (None, None, None)], "page_id long, url string, html string")
    got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc_archive.archived(pages).collect())
    assert got == {(None, "revisit", 4): 2, (4, "response", None): 2, (2, "revisit", 4): 1, (None, "response", None): 1}


def test_archive_query(spark):
    big, small = "x" * 1000, "y" * 10
    html = [None, "", small, small, big, big, big, "é" * 500, prose(1, 300_0)]
    pages = spark.createDataFrame([(k, None if k == 3 else f"http://h/{k} ü", x, "clash") for k, x in enumerate(html)], "page_id long, url string, html string, digest string")
    rows = {r.page_id: r for r in warc_archive.archived(pages).collect()}
    assert len(rows) == 9
    for k, x in enumerate(html):
        data = (x or "").encode()
        assert (rows[k].payload_bytes, rows[k].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    assert [(rows[k].record_type, rows[k].refers_to) for k in (2, 4, 5, 6)] == [("response", None), ("revisit", 6), ("revisit", 6), ("response", None)]
    assert warc_archive.archived(pages.limit(0)).count() == 0


# 3 Decontamination


def test_index_finds_all_fingerprints_in_the_radius():
    r = np.random.default_rng(0)
    items = [(k, r.integers(0, 1 << 63, 40).astype(np.uint64)) for k in range(50)]
    index = decontaminate.Index(items)
    prints = []
    for k in range(50):
        for flips in (0, 10, 20, 31, 39, 40, 60):
            bits = np.unpackbits(index.prints[k].view(np.uint8))
            bits[r.choice(128, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits).view(np.uint16))
    prints = np.array(prints)
    window, item = index.near(prints, int(index.size[0]))
    brute = np.bitwise_count(prints[:, None, :] ^ index.prints[None]).sum(axis=2) <= decontaminate.RADIUS
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(brute))))


def test_leaks_equal_brute_force(spark):
    items = [prose(100 + k, 20 + 3 * k) for k in range(8)] + ["too short item", "", None]
    texts = list(ODD)
    for k in range(8):
        words = items[k].split()
        texts += [f"{prose(k, 50)} {items[k].upper()}\n{prose(k + 50, 30)}", items[k], " ".join([*words[:-1], "changed", prose(9, 40)]), " ".join([*words[: len(words) // 2], prose(5, 40)])]
    texts += ["we saw too short item here", prose(7, 200)]
    docs, bench = documents(spark, texts), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()}
    expected = set()
    for i, x in enumerate(texts):
        w = decontaminate.word_hashes(x)
        for j, y in enumerate(items):
            v = decontaminate.word_hashes(y)
            if not len(v) or not len(w):
                continue
            a, b = textkit.shingles(w, min(5, len(v))), textkit.shingles(v, 5)
            n = min(len(a), len(b))
            if max(decontaminate.similarity(a[k : k + n], b) for k in range(len(a) - n + 1)) >= 0.8:
                expected.add((i, j))
    assert got == expected and len(got) > 15
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == len(texts)
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0


def test_leaks_by_blocks_with_nulls_ties_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_ITEMS", 2)
    a, b, c = prose(300, 30), prose(301, 40), prose(302, 25)
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (None, f"{prose(303, 9)} {b}", "y"), (3, None, "z"), (4, prose(304, 50), "w"), (5, c, "v")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(0, a), (0, a), (1, a), (None, b), (2, ""), (3, None), (4, c)], "item_id long, text string")
    got = sorted(((x.doc_id, x.item_id) for x in decontaminate.leaks(docs, bench).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (1, 1), (1, 1), (None, None), (5, 4)], key=str)
    assert [x.doc_id for x in decontaminate.decontaminated(docs, bench).orderBy("doc_id").collect()] == [3, 4]
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0 == decontaminate.decontaminated(docs.limit(0), bench).count()


def test_the_radius_holds_windows_at_the_threshold():
    r, missed, tried = np.random.default_rng(6), 0, 3000
    for _ in range(tried):
        values = textkit.mix64(r.integers(0, 1 << 62, 50).astype(np.uint64))
        a, b = values[:45], values[5:]  # 40 shingles of 50 in common: similarity 0.8
        assert decontaminate.similarity(a, b) == 0.8
        missed += int(np.bitwise_count(decontaminate.fingerprint(a) ^ decontaminate.fingerprint(b)).sum()) > decontaminate.RADIUS
    assert missed == 0


# 4 Mixing


def test_mix_meets_targets(spark):
    texts = [*ODD[:6], *[prose(k, 5 + k * 7 % 90) for k in range(600)]]
    sources = ["b" if k % 3 else "a" if k % 2 else None if k % 5 else "c" for k in range(len(texts))]
    docs = documents(spark, texts, sources)
    rows = mix_sources.mix(docs).collect()
    sizes = [len(WORD.findall(x or "")) for x in texts]
    assert sorted((r.doc_id, r["size"]) for r in rows) == list(enumerate(sizes))
    total, names = sum(sizes), sorted({s for s in sources if s}) + [None]
    own = {s: sum(n for n, t in zip(sizes, sources) if t == s) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, full = {}, set()
    while True:  # deal out, stop at the limit, deal the excess out again
        rest = total - sum(3 * own[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[t] for t in names if t not in full) for s in names if s not in full}
        above = {s for s in share if share[s] > 3 * own[s]}
        if not above:
            break
        full |= above
    target = share | {s: 3 * own[s] for s in full}
    taken = Counter()
    for r in rows:
        s = sources[r.doc_id]
        taken[s] += r.taken
        assert 0 <= r.taken <= 3 * r["size"] and r.source_size == own[s] and r.target == pytest.approx(target[s])
    assert all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 5 for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mix_sources.mix(docs.repartition(7)).collect()))
    again = mix_sources.repeated(docs)
    assert again.columns == docs.columns
    assert {r.doc_id: r["count"] for r in again.groupBy("doc_id").count().collect() if sizes[r.doc_id]} == {r.doc_id: r.taken // r["size"] for r in rows if r["size"] and r.taken}


def test_mix_of_nothing(spark):
    assert mix_sources.mix(documents(spark, ["x"]).limit(0)).count() == 0
    assert [tuple(r)[1:] for r in mix_sources.mix(documents(spark, [None, ""])).collect()] == [(0, 0, 0.0, 0)] * 2


# 5 Quality


def counts(text):
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    twice, hit = Counter(grams), set()
    for k, g in enumerate(grams):
        if twice[g] > 1:
            hit |= set(range(k, k + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_counts(spark):
    r = np.random.default_rng(1)
    texts = [*ODD, *["".join(r.choice(["a ", "b ", "c\n", "\n", "# ", "d|e "], r.integers(1, 80))) for _ in range(60)]]
    rows = {x.doc_id: x for x in quality_lines.with_base_counts(documents(spark, texts).drop("n_words")).collect()}
    for k, x in enumerate(texts):
        n = counts(x or "")
        assert (rows[k].n_words, rows[k].word_chars, rows[k].n_symbols, rows[k].n_dup_lines, rows[k].n_repeat_words) == n
        assert rows[k].base_failed == (n[0] < 10 or 100 * n[4] > 20 * n[0])


def test_documents_of_boilerplate_go_and_others_stay(spark):
    line = "all of these rights are reserved by the owner of this very page"
    clean = [f"{prose(k, 40)}\n{line}" for k in range(15)]
    only = [f"{line}\n{prose(90 + k, 2)}" for k in range(15)]
    copies = [f"{prose(500, 40)}\n{prose(501, 20)}"] * 30
    rows = {x.doc_id: x for x in quality_lines.line_verdicts(documents(spark, [*clean, *only, *copies])).collect()}
    assert all(rows[k].kept for k in range(15)) and all(rows[k].kept for k in range(30, 60))
    assert not any(rows[k].kept for k in range(15, 30)) and rows[20].words_left == 2
    docs = documents(spark, [*clean, *only, *copies]).withColumn("n_chars", F.length("text").cast("long"))
    kept = quality_lines.kept_documents(docs)
    assert kept.schema == docs.schema and kept.count() == 45
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert texts == {0: clean[0], **{k: prose(k, 40) for k in range(1, 15)}, **{30 + k: copies[0] for k in range(30)}}
    assert kept.where("n_chars <> length(text)").count() == 0
    assert quality_lines.line_verdicts(docs.limit(0)).count() == 0


def test_lines_are_cut_at_their_places(spark):
    texts = ["a\nb\n\nc\nd", "x", "a", "\n\na\n"]
    for text in texts:
        lines = text.split("\n")
        for cut in ([k for k in range(len(lines)) if m >> k & 1] for m in range(1, 1 << len(lines))):
            got = spark.range(1).select(quality_lines.without_lines(F.lit(text), F.lit(cut)).alias("x")).first().x if len(cut) < 3 else None
            assert got is None or got == "\n".join(x for k, x in enumerate(lines) if k not in cut)


def test_line_counts_with_nulls_and_repeated_rows(spark):
    line = "this very line is on every page of the host and has some words"
    rows = [(k if k % 4 else None, f"{prose(40 + k, 30)}\n{line}", "h" if k % 2 else None) for k in range(44)]
    rows += [(100, f"{prose(99, 30)}\n{line}", "h")] * 3 + [(None, None, None), (7, "", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = quality_lines.line_verdicts(docs).collect()
    assert len(got) == len(rows)
    # In each host one document, with the smallest id, keeps the line; equal rows are alike.
    left = Counter((r.source, r.words_left) for r in got if r.n_words)
    n = 30 + len(line.split())
    assert left == {("h", 30): 24, ("h", n): 1, (None, 30): 21, (None, n): 1}
    assert {r.doc_id for r in got if r.words_left == n} == {1, 2}
    assert sum(r.kept for r in got) == 47


def test_a_shared_longest_line_counts_every_document(spark):
    notice = prose(700, 90)
    dominated = ["\n".join([*(prose(1000 + 3 * k + j, 3) for j in range(3)), notice]) for k in range(30)]
    copies = [f"{prose(800, 40)}\n{prose(801, 20)}", f"{prose(800, 40).upper()} \n\n {prose(801, 20)}"] * 20
    rows = {x.doc_id: x for x in quality_lines.line_verdicts(documents(spark, [*dominated, *copies])).collect()}
    assert rows[0].kept and rows[0].words_left == 99
    assert all(rows[k].words_left == 9 and not rows[k].kept for k in range(1, 30))
    assert all(rows[k].words_left == 60 and rows[k].kept for k in range(30, 70))


# 6 Pages


PAGE = '<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</li></ul></nav><div class="ad">Buy</div>%s<footer>&copy; x</footer>'


def test_article_text(spark):
    html = PAGE % "<article><h1>A &amp; B</h1><p>One <b>two\n three<br><p>a < b &lt; c</p><script>var t='<p>no</p>'</script><aside>side</aside></article><section class='comments'><article class='comment'>me</article></section>"
    assert page_text.extract([html]) == ["A & B\n\nOne two three\n\na < b < c"]
    assert page_text.extract([html] * 50) == ["A & B\n\nOne two three\n\na < b < c"] * 50
    assert page_text.extract(["", "<p", "<!-- x", "plain"]) == ["", "", "", "plain"]


def test_template_without_article():
    make = lambda k: PAGE % f"<div class='top'>Our site</div><div class='content'><h2>Title {k}</h2><p>{prose(k, 30)}</p><p>same start {prose(k + 70, 30)}</p></div><div class='cookie-notice'>We use cookies</div><form><p>mail</p></form><div>Imprint</div>"
    got = page_text.extract([make(k) for k in range(12)])
    assert got == [f"Title {k}\n\n{prose(k, 30)}\n\nsame start {prose(k + 70, 30)}" for k in range(12)]


def test_long_texts_of_the_template_go():
    law = prose(600, 120)
    make = lambda k: PAGE % f"<div class='content'><h2>Title {k}</h2><p>{prose(k, 30)}</p><p>{law}</p></div>"
    assert len(law) > 300 and page_text.extract([make(k) for k in range(12)]) == [f"Title {k}\n\n{prose(k, 30)}" for k in range(12)]


def test_notices_in_articles_go_and_copies_stay():
    notice, copied = prose(610, 12), [prose(620 + k, 20) for k in range(6)]
    article = lambda *parts: PAGE % f"<article>{''.join(f'<p>{x}</p>' for x in parts)}</article>"
    assert page_text.extract([article(prose(k, 30), notice) for k in range(12)]) == [prose(k, 30) for k in range(12)]
    near = [[*copied[:5], f"{copied[5]} {k}"] for k in range(12)]
    assert page_text.extract([article(*x) for x in near]) == ["\n\n".join(x) for x in near]
    few = [[prose(k, 30), *([notice] if k < 4 else [])] for k in range(12)]
    assert page_text.extract([article(*x) for x in few]) == ["\n\n".join(x) for x in few]
    assert page_text.extract([article(notice), *(article(prose(k, 30), notice) for k in range(5))])[0] == notice


def test_classes_nest_and_broken_ones_go():
    pages = [list("ab") + ["r", "s"] * n + list("c") for n in (2, 3, 1)]
    held = page_text.template(pages)
    assert {held[k][0] for k in "abc"} == {held["a"][0]} and held["r"][0] == held["s"][0] != held["a"][0]
    assert page_text.equivalence_classes([list("xy"), list("yx")]) == []


def test_classes_equal_brute_force():
    r = np.random.default_rng(8)
    for _ in range(400):
        pages = [list("".join(r.choice(list("abcdefg"), r.integers(0, 9)))) for _ in range(r.integers(2, 5))]
        if r.random() < 0.7:
            frame = list("PQRS")[: r.integers(1, 5)]
            pages = [[*frame[:1], *p[:2], *frame[1:2], *p[2:], *frame[2:]] for p in pages]
        vector = lambda k: tuple(p.count(k) for p in pages)  # noqa: B023, E731
        keys = sorted({k for p in pages for k in p if sum(n > 0 for n in vector(k)) > 1})
        expected = set()
        for v in {vector(k) for k in keys}:
            own = {k for k in keys if vector(k) == v}
            runs = [[k for k in p if k in own] for p in pages]
            order = next(x for x in runs if x)[: len(own)]
            if len(set(order)) == len(own) and all(x == order * n for x, n in zip(runs, v)):
                expected.add(tuple(order))
        assert {tuple(x) for x in page_text.equivalence_classes(pages)} == expected


def test_pages_with_nulls_repeated_rows_and_clashing_columns(spark):
    html = PAGE % f"<article><p>{prose(1, 9)}</p></article>"
    rows = [(1, "http://h/", html, "t"), (1, "http://h/", html, "t"), (2, "http://h/", None, "t"), (None, None, html, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    assert Counter((r.page_id, r.text) for r in page_text.page_texts(pages).collect()) == {(1, prose(1, 9)): 2, (2, ""): 1, (None, prose(1, 9)): 1}
    assert page_text.page_texts(pages.limit(0)).count() == 0


def test_page_query(spark):
    rows = [(k, f"http://h{k % 2}/x", PAGE % f"<article><p>{prose(k, 9)}</p></article>") for k in range(40)] + [(40, None, None), (41, "odd", ""), (None, "http://h0/", "x" * 200_000)]
    got = page_text.page_texts(spark.createDataFrame(rows, "page_id long, url string, html string"), group=7).collect()
    assert {r.page_id: r.text for r in got if r.page_id is not None and r.page_id < 40} == {k: prose(k, 9) for k in range(40)}
    assert len(got) == 43 and all(r.n_chars == len(r.text) for r in got)


# 7 Records


def test_word_wise_ids_equal_whole_text_ids(vocab, monkeypatch):
    r = np.random.default_rng(4)
    alphabet = list("abAB'sStTrRdDmMvVlLeE019 .,!?-_<|>éß’²µªあ\n\t\x1c\x85 ́")
    texts = [*[x or "" for x in ODD], "don't we'll x<|startoftext|>y ΣΑΣ İ ǅ", *["".join(r.choice(alphabet, r.integers(1, 60))) for _ in range(2000)]]
    enc = token_records.Encoder(vocab)
    whole = [x.ids for x in enc.whole.encode_batch(texts, add_special_tokens=False)]
    for chunk in (token_records.CHUNK, 500, 0):
        monkeypatch.setattr(token_records, "CHUNK", chunk)
        assert [np.frombuffer(x, enc.kind).tolist() for x in enc.encode(pa.array([None, *texts]).slice(1))] == whole
    assert list(enc.encode(pa.array([None, ""]))) == [b"", b""] and list(enc.encode(pa.array([], pa.string()))) == []


def test_records_round_trip(spark, vocab):
    texts = [*ODD, *[prose(k, 30) for k in range(40)]]
    docs = documents(spark, texts).unionByName(documents(spark, ["again"]))
    manifest = token_records.write_records(docs.repartition(5), vocab)
    rows = sorted(token_records.read_digests(manifest).collect(), key=lambda x: (x.doc_id, x.start))
    enc, at = token_records.Encoder(vocab), 0
    for r, (i, x) in zip(rows, sorted([*enumerate(x or "" for x in texts), (0, "again")])):
        ids = np.array([*enc.whole.encode(x, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert len(rows) == len(texts) + 1
    uri = manifest.first().uri
    offsets = token_records.offsets_of(uri)
    with token_records.open_input(uri) as f:
        data = f.read()
    ids = [i for i, _ in token_records.iter_records(uri)]
    assert [token_records.read_record(data, int(k))[0] for k in offsets[::-1]] == ids[::-1]
    with pytest.raises(ValueError, match="damaged"):
        token_records.read_record(data[:20] + bytes([data[20] ^ 1]) + data[21:])
    assert token_records.token_records(docs.limit(0), vocab).count() == 0


# 8 Near duplicates


def edited(text, k, seed):
    w, r = text.split(), np.random.default_rng(seed)
    for p in r.choice(len(w), k, replace=False):
        w[p] = prose(seed * 1000 + int(p), 1)
    return " ".join(w)


def brute_components(texts, width, percent):
    sets = [set() if not (w := WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))) else {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} for x in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def test_near_duplicates_equal_brute_force(spark):
    texts = list(ODD)
    for g in range(6):
        base = prose(g, 150)
        texts += [base, base.upper(), *[edited(base, k % 9, 100 * g + k) for k in range(25)]]
    chain = prose(77, 150)
    for k in range(8):
        chain = edited(chain, 3, 900 + k)
        texts.append(chain)
    texts += [prose(1000 + k, 60) for k in range(40)] + ["two words", "TWO words", "two Words x"]
    for width, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(documents(spark, texts), width=width, percent=percent).collect()
        assert sorted(map(tuple, got)) == brute_components(texts, width, percent)
    docs = documents(spark, texts)
    kept = near_dedup.kept_documents(docs)
    assert kept.columns == docs.columns
    assert {x.doc_id for x in kept.collect()} == {i for i, _, _, k in brute_components(texts, 5, 80) if k}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_null_and_repeated_ids_are_linked(spark):
    a, b = prose(31, 200), prose(32, 200)
    rows = [(5, a, 1), (None, edited(a, 1, 1), 2), (7, prose(33, 40), 3), (7, b, 4), (9, edited(b, 1, 2), 5), (9, edited(b, 1, 2), 5), (None, prose(34, 30), 6), (None, prose(34, 30).upper(), 7), (3, None, 8), (3, None, 8), (None, "", 9), (8, "\n ", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = Counter((r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(docs).collect())
    assert got == {(5, True, 5, True): 1, (None, True, 5, False): 1, (7, True, 7, True): 2, (9, True, 7, False): 2, (None, True, None, True): 1, (None, True, None, False): 1, (3, False, 3, True): 2, (None, False, None, True): 1, (8, False, 8, True): 1}
    kept = near_dedup.kept_documents(docs)
    assert kept.schema == docs.schema
    left = [r.component_id for r in kept.collect()]
    assert len({6, 7} & set(left)) == 1 and sorted(set(left) - {6, 7}) == [1, 3, 4, 8, 9, 10] and len(left) == 7


def test_blocks_and_slices_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    monkeypatch.setattr(near_dedup, "SLICE", 4)
    base = prose(41, 60)
    texts = [edited(base, k % 14, 50 + k) for k in range(70)]
    got = near_dedup.near_duplicates(documents(spark, texts), width=3, percent=70).collect()
    expected = brute_components(texts, 3, 70)
    assert sorted(map(tuple, got)) == expected and len({c for _, _, c, _ in expected}) > 3


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    for j in (0.5, 0.85):
        got = []
        for _ in range(60):
            n = 2000
            x = textkit.mix64(r.integers(0, 1 << 62, 2 * n).astype(np.uint64))
            both = round(j * 2 * n / (1 + j))
            a, b = x[:n], x[n - both : 2 * n - both]
            ra, rb = near_dedup.registers(a), near_dedup.registers(b)
            assert (near_dedup.merged(ra, rb) == near_dedup.registers(np.concatenate([a, b]))).all()
            got.append(near_dedup.likely_similarity(ra[None], np.array([float(n)]), rb[None], np.array([float(n)]))[0])
        assert np.mean(got) == pytest.approx(j, abs=0.02) and np.std(got) < 1.5 * math.sqrt(j * (1 - j) / near_dedup.REGISTERS)


# 9 Katz


def test_katz_equals_brute_force_and_sums_to_one(spark):
    r = np.random.default_rng(3)
    texts = [*ODD[:5], *[" ".join(f"w{min(int(x), 60)}" for x in r.zipf(1.4, r.integers(1, 80))) + " The the" for _ in range(150)]]
    tokens = [[*WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), x or "")), "\0"] for x in texts]
    held = [zlib.crc32(str(k).encode()) % 7 == 2 for k in range(len(texts))]
    uni, pairs = Counter(), Counter()
    for t, h in zip(tokens, held):
        if not h:
            uni.update(t)
            pairs.update(zip(["\0", *t[:-1]], t))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = (katz.Discounts.of([Counter(c.values())[k] for k in range(1, katz.K + 2)]).table() for c in (uni, pairs))
    disc = lambda d, c: d[min(c, katz.K + 1)] * c
    kept = sum(disc(d1, c) for c in uni.values())
    p1 = lambda w: disc(d1, uni[w]) / n if uni[w] else (n - kept) / n
    follow = {}
    for (a, b), c in pairs.items():
        follow.setdefault(a, {})[b] = c

    def p2(a, b):
        seen = follow.get(a, {})
        total = sum(seen.values())
        left = total - sum(disc(d2, c) for c in seen.values())
        total, left = (total, left) if left > 1e-9 else (total + 1, 1)
        if b in seen:
            return disc(d2, seen[b]) / total
        return (left / total / (1 - sum(p1(w) for w in seen)) if seen else 1) * p1(b)

    for a in ("the", "w1", "\0", "never seen"):
        assert sum(p2(a, w) for w in [*uni, "unknown"]) == pytest.approx(1)
    for size, shards in ((katz.BLOCK_TOKENS, 4), (300, 3)):
        rows = {x.doc_id: x for x in katz.katz_scores(documents(spark, texts), block_tokens=size, shards=shards).collect()}
        assert len(rows) == len(texts)
        for k, t in enumerate(tokens):
            x = rows[k]
            assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[k], len(t), sum(uni[w] > 0 for w in t), n)
            assert x.base_score == pytest.approx(sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t))
            assert x.score == pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip(["\0", *t[:-1]], t)))
    assert katz.katz_scores(documents(spark, texts).limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, "a b a"), (3, "a b a")], "doc_id long, text string")
    twice = katz.katz_scores(odd, shards=2).collect()
    assert Counter(x.doc_id for x in twice) == {None: 1, 3: 2} and len({x.score for x in twice if x.doc_id == 3}) == 1


# 10 Chats


def test_format_round_trip(spark):
    texts = [*[x for x in ODD if x is None or "\0" not in x], "### user:\nhi\n</turn>\n", "\\", "\\\\### \\</turn>", "</turn>", "\n</turn>\n### x:\n"]
    roles = ["user", "assistant", None, "odd\n%role###:\n", "assistant"]
    rows = [(k % 3, k, roles[k % 5], x, "clash") for k, x in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    out = chat_format.format_rows(df).collect()
    back = {r.conv_id: r.turns for r in spark.createDataFrame(out).select("conv_id", chat_format.read_back(F.col("formatted")).alias("turns")).collect()}
    for c in range(3):
        assert [(t.role, t.text, t.loss) for t in back[c]] == [(r or "unknown", x or "", r == "assistant") for k, _, r, x, _ in rows if k == c]
    got = {r.conv_id: r for r in chat_format.formatted_conversations(df).collect()}
    assert set(got) == {-7, 0, 1, 2}
    probe = chat_format.EXTRA_TEXT
    assert (got[-7].n_turns, got[-7].loss_chars, got[-7].loss_sha256) == (2, len(probe), hashlib.sha256(probe.encode()).hexdigest())
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest()
    assert chat_format.formatted_conversations(df.limit(0)).count() == 1


def test_fingerprints_select_mappings(spark):
    records = [
        '{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}',
        '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}',
        '{"prompt": "a", "completion": "b"}',
        '{"instruction": "a", "output": "b"}',
        '{"instruction": "a", "input": "x", "output": "b"}',
        '{"unknown": 1}',
        "no json",
        None,
        # Texts that look like lists or objects are texts; lists and objects are none.
        '{"prompt": "[1, 2, 3]", "completion": "{\\"x\\": 1}"}',
        '{"instruction": "sort [{\\"x\\":1}]", "output": "[\\"a\\",\\"b\\"]"}',
        '{"prompt": ["a"], "completion": "b"}',
        '{"prompt": {"x": "a"}, "completion": "b"}',
        '{"messages": "[{\\"role\\": \\"user\\", \\"content\\": \\"a\\"}]"}',
        '{"messages": [{"role": "human", "content": "a", "name": "x"}]}',
        '{"messages": [{"role": "human", "content": "a"}]}',
        '{"prompt": "a", "completion": "b", "id": 7}',
    ]
    df = chat_format.with_turns(spark.createDataFrame([(k, x) for k, x in enumerate(records)], "k long, record string"), "record", "t", "f")
    got = {r.k: r.t and [tuple(x) for x in r.t] for r in df.collect()}
    plain = [("user", "a"), ("assistant", "b")]
    assert [got[k] for k in range(8)] == [plain, plain, plain, plain, [("user", "a\nx"), ("assistant", "b")], None, None, None]
    assert got[8] == [("user", "[1, 2, 3]"), ("assistant", '{"x": 1}')] and got[9] == [("user", 'sort [{"x":1}]'), ("assistant", '["a","b"]')]
    assert [got[k] for k in range(10, 16)] == [None, None, None, None, [("human", "a")], None]
    assert df.where("k in (10, 11, 12, 13, 15)").select("f").distinct().count() == 5
    from pyspark.sql import types as T

    schema = T._parse_datatype_string("messages array<struct<role:string,content:string>>")
    assert df.where("k = 0").first().f == chat_format.fingerprint_of(chat_format.paths(schema))
    typed = spark.createDataFrame([(None, "a", "b", None), ([("user", "x")], None, None, None), (None, "a", None, "z")], "messages array<struct<role:string,content:string>>, prompt string, completion string, other string")
    rows = chat_format.with_turns(typed.select(F.struct("*").alias("record")), "record").collect()
    assert [r.turns and [tuple(x) for x in r.turns] for r in rows] == [plain, [("user", "x")], None]
    assert rows[0].fingerprint == df.where("k = 2").first().f and rows[1].fingerprint == df.where("k = 0").first().f


def test_very_long_and_repeated_turns(spark):
    long = "a" * 21_000_000
    rows = [(1, 0, "user", "[1, 2]"), (1, 1, "assistant", long), (2, None, "assistant", "x"), (2, None, "assistant", "x"), (2, 3, "bot", None), (None, 0, "user", "y")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.formatted_conversations(df).collect()}
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (2, len(long), hashlib.sha256(long.encode()).hexdigest())
    assert got[1].turns_sha256 == hashlib.sha256(f"user\n[1, 2]\nassistant\n{long}\n".encode()).hexdigest()
    assert got[2].turns_sha256 == hashlib.sha256(b"assistant\nx\nassistant\nx\nbot\n\n").hexdigest() and got[2].loss_chars == 2
    assert got[None].n_turns == 1
    json = spark.createDataFrame([('{"prompt": "a", "completion": "' + long + '"}',)], "record string")
    assert chat_format.with_turns(json, "record").select(F.length(F.col("turns")[1]["text"]).alias("n")).first().n == len(long)


# The pipeline


def test_pipeline_equals_its_stages(spark, vocab, tmp_path):
    import corpus_pipeline

    leak = prose(4000, 40)
    texts = [prose(k, 80 + k) for k in range(60)] + [edited(prose(3, 83), 1, 5), prose(4, 84), f"{prose(900, 50)} {leak} {prose(901, 50)}", "short", "w " * 50]
    rows = [(k, x, "en", f"src{k % 4}", len(x)) for k, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = set(range(len(texts)))
    for (name, stage), gone in zip(corpus_pipeline.STAGES[:3], ({63, 64}, {60, 61}, {62})):
        docs = stage(spark, docs, str(tmp_path))
        left -= gone
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert {x.doc_id for x in docs.collect()} == left, name
    taken = {x.doc_id: x["count"] for x in corpus_pipeline.mixing(spark, docs, str(tmp_path)).groupBy("doc_id").count().collect()}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(x.doc_id for x in got) == Counter(taken)
