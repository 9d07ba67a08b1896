"""Lacking records, ties, odd rows and names: what the operators promise about them."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm import PAGE, prose

from chronoflow.llm import chat_format, decontaminate, mix_sources, page_text, pii_spans, warc_archive


def test_records_lacking_at_a_boundary_are_noticed(spark, tmp_path):
    pages = spark.createDataFrame([(k, "u", f"page {k}") for k in range(10)], "page_id long, url string, html string").coalesce(1)
    manifest = warc_archive.write_warc(pages, str(tmp_path)).cache()
    uri = manifest.first().uri
    rows = warc_archive.read_warc(manifest).collect()
    assert warc_archive.shortfalls(manifest, warc_archive.read_warc(manifest)).count() == 0
    cut = sorted(r.start for r in rows)[-3]
    with open(uri, "rb") as f:
        data = f.read(cut)
    with open(uri, "wb") as f:
        f.write(data)
    (tmp_path / f".{uri.rpartition('/')[2]}.crc").unlink(missing_ok=True)
    found = warc_archive.read_warc(manifest)
    assert warc_archive.gaps(found).count() == 0
    assert [tuple(r)[1:] for r in warc_archive.shortfalls(manifest, found).collect()] == [(10, 7)]
    with pytest.raises(Exception, match="records lacking"):
        warc_archive.checked(manifest, found).collect()
    with open(uri, "ab") as f:
        f.write(b"\x1f\x8b\x08 no member")
    (gap,) = warc_archive.gaps(warc_archive.read_warc(manifest)).collect()
    assert (gap.start, gap.end) == (cut, cut + 13)


def test_rates_are_exponential_and_the_gradient_is_zero(spark):
    rows = [("a", n, 1000) for n in (1, 9, 17, 25, 33)] + [("b", n, 4000) for n in (5, 40)]
    mean = {s: sum(n * m for t, n, m in rows if t == s) / sum(m for t, n, m in rows if t == s) for s in "ab"}
    classes = spark.createDataFrame([(s, n, m, n / mean[s]) for s, n, m in rows], "__m_source string, __m_size long, __m_n long, z double")
    words = {s: sum(n * m for t, n, m in rows if t == s) for s in "ab"}
    target = {"a": 1.7 * words["a"], "b": 0.6 * words["b"]}
    wanted = spark.createDataFrame([(s, words[s], target[s]) for s in "ab"], "__m_source string, __m_words long, __m_target double")
    lambdas = mix_sources.multipliers(classes, wanted)
    x = {r["__m_source"]: r["__m_lambda"] for r in lambdas.collect()}
    rate = lambda s, n: min(3.0, math.exp(x[s] * n / mean[s]))
    for s in "ab":
        assert sum(n * m * rate(s, n) for t, n, m in rows if t == s) == pytest.approx(target[s], rel=1e-6)
    for r in mix_sources.class_copies(classes, wanted, lambdas).collect():
        assert r["__m_copies"] / r["__m_n"] == pytest.approx(rate(r["__m_source"], r["__m_size"]), abs=0.01)


def test_equal_ids_with_different_texts_are_taken_alike_in_any_order(spark):
    rows = [(k // 3, f"{prose(k, 4)}", "s") for k in range(30)] + [(90 + k, prose(90 + k, 9), "t") for k in range(20)]
    taken = lambda n: Counter(tuple(r) for r in mix_sources.repeated(spark.createDataFrame(rows[::n], "doc_id long, text string, source string").repartition(5)).collect())
    assert taken(1) == taken(-1)


def test_notices_go_from_articles_of_any_length():
    notice = prose(700, 42)
    for n in (6, 25, 400):
        pages = [PAGE % f"<article><p>{prose(k, n)}</p><p>{notice}</p></article>" for k in range(20)]
        assert page_text.extract(pages) == [prose(k, n) for k in range(20)]


def test_class_names_in_articles_only_break_ties():
    named = lambda name, k: PAGE % f"<article><p>{prose(k, 30)}</p><div class='{name}'><p>{prose(k + 900, 20)}</p></div></article>"
    got = page_text.extract([named("social-history", k) for k in range(20)])
    assert got == [f"{prose(k, 30)}\n\n{prose(k + 900, 20)}" for k in range(20)]
    for name in ("social", "share-buttons", "cookie-notice", "comments", "ad"):
        assert page_text.extract([named(name, k) for k in range(20)]) == [prose(k, 30) for k in range(20)]
    same = [PAGE % f"<article><p>{prose(k, 30)}</p><p>{prose(k + 50, 30)}</p><div class='social-hints'><p>Follow our paper</p></div></article>" for k in range(20)]
    assert page_text.extract(same) == [f"{prose(k, 30)}\n\n{prose(k + 50, 30)}" for k in range(20)]


def test_one_or_two_pages_are_read_by_tags_alone():
    one = PAGE % f"<article><p>{prose(1, 9)}</p><p>{prose(2, 9)}</p></article>"
    two = PAGE % f"<article><p>{prose(3, 9)}</p><p>{prose(2, 9)}</p></article>"
    assert page_text.extract([one]) == [f"{prose(1, 9)}\n\n{prose(2, 9)}"]
    assert page_text.extract([one, two]) == [f"{prose(k, 9)}\n\n{prose(2, 9)}" for k in (1, 3)]


def test_fingerprints_of_rows_as_they_come(spark):
    record = F.struct(F.array(F.struct("role", "text")).alias("turns"))
    rows = spark.createDataFrame([(0, "user", "a"), (1, None, "a"), (2, "user", None), (3, None, None)], "k int, role string, text string")
    got = {r.k: (r.fingerprint, r.turns and tuple(r.turns[0])) for r in chat_format.with_turns(rows.select("k", record.alias("record")), "record").collect()}
    names = (["turns[].role", "turns[].text"], ["turns[].text"], ["turns[].role"], [])
    assert [got[k][0] for k in range(4)] == [chat_format.fingerprint_of(x) for x in names]
    assert [got[k][1] for k in range(4)] == [("user", "a"), (None, "a"), ("user", None), None]
    chats = spark.createDataFrame([(1, k, r, t) for k, (r, t) in enumerate([("user", "a"), (None, "b"), ("assistant", None), (None, None)])], "conv_id long, turn long, role string, text string")
    back = chat_format.format_rows(chats).select(chat_format.read_back(F.col("formatted")).alias("t")).first().t
    assert [(x.role, x.text) for x in back] == [("user", "a"), ("unknown", "b"), ("assistant", ""), ("unknown", "")]


def test_several_blocks_take_what_one_takes(spark, monkeypatch):
    items = spark.createDataFrame([(k, prose(k, 30)) for k in range(5)], "item_id long, text string")
    texts = [None, "", prose(77, 200), *[f"{prose(100 + k, 40)} {prose(k, 30)} {prose(200 + k, 40)}" for k in range(5)]]
    docs = spark.createDataFrame([(k, x, k) for k, x in enumerate(texts)] + [(2, texts[2], 9)], "doc_id long, text string, digest long")
    one = sorted(map(str, decontaminate.decontaminated(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "item_blocks", lambda b, *a, f=decontaminate.item_blocks: [u for k in range(5) for u in f(b.where(F.col("item_id") == k), *a)])
    assert sorted(map(str, decontaminate.decontaminated(docs, items).collect())) == one and len(one) == 4


def test_pipeline_with_odd_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline

    kind = "doc_id long, text string, lang string, source string, n_chars long, size long, kept string, gram long"
    row = lambda k, x, s="s": (k, x, "en", s, len(x or ""), 1, "z", 2)
    rows = [row(k, prose(k, 60)) for k in range(12)] + [row(3, prose(3, 60)), row(None, prose(40, 60)), row(None, None), row(50, ""), row(51, prose(51, 60), None), row(3, prose(52, 60))]
    spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / "a/documents.parquet"))
    spark.createDataFrame([(0, None), (1, prose(5, 60))], "item_id long, text string").write.parquet(str(tmp_path / "a/benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "a/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path / "a"))
        assert docs.columns == [x.split()[0] for x in kind.split(", ")]
    assert Counter(r.doc_id for r in docs.collect()) == Counter([0, 1, 2, 3, 3, 4, 6, 7, 8, 9, 10, 11, None, 51])
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()} and all(r.n_tokens > 1 for r in got)
    spark.createDataFrame([], kind).write.parquet(str(tmp_path / "b/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "b/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []


@pytest.mark.parametrize("text, part", (("von ana arroba ejemplo.com, hoy", "ana arroba ejemplo.com"), ("x Jean Arobase exemple.fr y", "Jean Arobase exemple.fr"), ("meet me at example.com", None), ("ana arroba hoy", None), ("ana at example dot com", "ana at example dot com")))
def test_at_words_before_written_domains(text, part):
    found = [text[s:e] for kind, s, e in pii_spans.disguised_spans(text, pii_spans.plain_spans(text)) if kind == 0]
    assert found == ([part] if part else [])
