"""Quality rules: base counts of a text and cross-document line frequency. Built-in functions only.

Lines are normalised (trimmed, white space runs to one blank, lower case) and hashed. For each host the distinct
documents that hold a line are counted. Documents whose normalised lines are all equal, in order, are copies and count as
one there, so that copies of a document don't make its own lines look like boilerplate. A line that more than
``max_docs`` documents of a host share is removed from all of them but the first (smallest doc_id) and its copies. A
document that loses words is rejected if less than ``min_left`` of its words or fewer than ``min_words`` words remain.
``kept_documents`` returns the others with those lines cut out of their texts.

Edge cases: a null or empty text has no words, fails the base rule and is not kept; a null host is a host of its
own, a null doc_id a document that is the first only where all are null; equal rows get equal verdicts; limits are
strict, so nothing hangs on the order of ties; an empty table gives an empty result. Columns that are already there pass
through, except those with the names of the results, which are replaced. Names that start with ``__q_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoflow.llm.store import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def with_base_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("__q_words", F.transform(words_of(t), lambda w: F.xxhash64(w)))
    df = df.withColumn("__q_lines", lines)
    width = 5

    def window(i: Column) -> Column:
        at = lambda j: F.get("__q_words", i + j)
        return F.xxhash64(*[at(j) for j in range(width)])

    windows = F.when(F.size("__q_words") > width, F.transform(F.sequence(F.lit(0), F.size("__q_words") - width), window)).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("__q_windows", windows)
    df = df.withColumn("__q_twice", F.size(F.array_distinct("__q_windows")) < F.size("__q_windows"))
    # Of a text with a repeated window: the windows in order of hash and place, then the places of those with an
    # equal neighbour, then how many words these windows cover together.
    ranked = F.when(F.col("__q_twice"), F.sort_array(F.transform("__q_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.lit(None))
    df = df.withColumn("__q_ranked", ranked)
    hash_at = lambda i: F.get("__q_ranked", i)["h"]
    again = F.filter("__q_ranked", lambda x, i: (hash_at(i - 1) == x["h"]) | (hash_at(i + 1) == x["h"]))
    df = df.withColumn("__q_again", F.when(F.col("__q_twice"), F.sort_array(F.transform(again, lambda x: x["i"]))))
    gaps = F.aggregate(F.transform("__q_again", lambda p, i: F.least(F.lit(width), F.coalesce(F.get("__q_again", i + 1), p + width) - p)), F.lit(0), lambda a, x: a + x)
    df = df.withColumn("n_words", F.size("__q_words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.regexp_replace(t, SPACE, "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace(t, SYMBOLS, "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long"))
    df = df.withColumn("n_repeat_words", F.coalesce(F.when(F.col("__q_twice"), gaps), F.lit(0)).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return df.drop("__q_words", "__q_lines", "__q_windows", "__q_twice", "__q_ranked", "__q_again")


def _keyed(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({"__q_id": F.col(doc_id), "__q_host": F.coalesce(F.concat(F.lit("h"), F.col(host)), F.lit("")), "__q_sum": F.xxhash64(t), "__q_len": F.length(t)})


_KEY = ["__q_id", "__q_host", "__q_sum", "__q_len"]


def removed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 10) -> DataFrame:
    """The lines above the limit that each document loses: how many words they have (``__q_gone``) and their places among
    the text's lines, from 0 (``__q_cut``). Documents that lose none have no row. The key is the document's id, host, and
    hash and length of its text (columns ``__q_*``)."""

    def line(x: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), F.xxhash64(F.trim(F.lower(F.regexp_replace(x, SPACE, " ")))).alias("h"), F.size(words_of(x)).alias("w"))

    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), line), lambda x: x["w"] > 0)
    rows = _keyed(docs, doc_id, text, host).select(*_KEY, lines.alias("__q_lines")).filter(F.size("__q_lines") > 0)
    # Only copies, with all lines equal, are one family; never documents that just share the line that is counted.
    rows = rows.withColumn("__q_family", F.xxhash64(F.transform("__q_lines", lambda x: x["h"])))
    each = rows.select("__q_id", "__q_host", "__q_family", F.explode(F.array_distinct(F.transform("__q_lines", lambda x: x["h"]))).alias("__q_h"))
    # The family spreads a line that many documents share over tasks before its documents are counted.
    by_family = each.groupBy("__q_host", "__q_h", "__q_family").agg(F.min("__q_id").alias("__q_first"))
    first = F.min(F.struct(F.isnull("__q_first").alias("n"), F.col("__q_first").alias("i"), F.col("__q_family").alias("f"))).alias("__q_m")
    frequent = by_family.groupBy("__q_host", "__q_h").agg(F.count("*").alias("__q_n"), first).filter(F.col("__q_n") > max_docs)
    frequent = frequent.select("__q_host", "__q_h", F.col("__q_m.f").alias("__q_keeper"))
    held = rows.select(*_KEY, "__q_family", F.explode("__q_lines").alias("__q_x")).select(*_KEY, "__q_family", F.col("__q_x.h").alias("__q_h"), F.col("__q_x.at").alias("__q_at"), F.col("__q_x.w").alias("__q_w"))
    gone = held.join(frequent, ["__q_host", "__q_h"]).filter(F.col("__q_family") != F.col("__q_keeper"))
    gone = gone.groupBy(*_KEY, "__q_at").agg(F.max("__q_w").alias("__q_w"))  # equal rows
    return gone.groupBy(*_KEY).agg(F.sum("__q_w").alias("__q_gone"), F.sort_array(F.collect_list("__q_at")).alias("__q_cut"))


def _judged(keyed: DataFrame, gone: DataFrame, text: str, min_left: float, min_words: int) -> DataFrame:
    """``_keyed`` documents with the base counts, words_left and kept."""
    out = _joined(with_base_counts(keyed, text), gone, "left").select("a.*", F.coalesce("b.__q_gone", F.lit(0)).alias("__q_gone"))
    left = F.col("n_words") - F.col("__q_gone")
    depleted = (F.col("__q_gone") > 0) & ((left < min_left * F.col("n_words")) | (left < min_words))
    return out.withColumns({"words_left": left, "kept": ~F.col("base_failed") & ~depleted}).drop("__q_gone")


def _joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in _KEY]
    return a.alias("a").join(b.alias("b"), same, how)


def line_verdicts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = 10, min_left: float = 0.2, min_words: int = 10) -> DataFrame:
    """``docs`` without its text, with the base counts, words_left (long) and kept."""
    gone = removed_lines(docs, doc_id, text, host, max_docs)
    return _judged(_keyed(docs, doc_id, text, host), gone, text, min_left, min_words).drop(text, *_KEY)


def without_lines(text: Column, cut: Column) -> Column:
    """The text without the lines at the places ``cut`` (ascending, from 0): the stretches between them, joined."""
    after = lambda i: F.when(i == 0, 0).otherwise(F.get(cut, i - 1) + 1)

    def rest(lines: Column) -> Column:
        stretch = lambda at, end: F.when(end > at, F.slice(lines, at + 1, end - at)).otherwise(F.array().cast("array<string>"))
        return F.array_join(F.concat(F.flatten(F.transform(cut, lambda end, i: stretch(after(i), end))), stretch(F.element_at(cut, -1) + 1, F.size(lines))), "\n")

    # An array of one element, so that the text is split once and not once a line.
    return F.transform(F.array(F.split(text, "\n")), rest)[0]


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", n_chars: str = "n_chars", max_docs: int = 10, min_left: float = 0.2, min_words: int = 10) -> DataFrame:
    """The documents that the rules keep, without the lines that are removed; a column ``n_chars``, if there is one,
    counts what is left of a text that lost lines. The other columns are as they were."""
    columns, keyed = docs.columns, _keyed(docs, doc_id, text, host)
    gone = written(removed_lines(docs, doc_id, text, host, max_docs), "gone")
    probe = keyed.select(F.col(text).alias("text"), *_KEY)
    rejected = _judged(probe, gone, "text", min_left, min_words).filter(~F.col("kept")).select(*_KEY).distinct()
    kept = _joined(keyed, written(rejected, "rejected"), "left_anti")
    kept = _joined(kept, gone, "left").select("a.*", F.col("b.__q_cut").alias("__q_cut"))
    shorter = F.col("__q_cut").isNotNull()
    kept = kept.withColumn("__q_text", F.when(shorter, without_lines(F.col(text), F.col("__q_cut"))).otherwise(F.col(text)))
    changed = {text: F.col("__q_text")}
    if n_chars in columns:
        changed[n_chars] = F.when(shorter, F.length("__q_text").cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars))
    return kept.select(*[changed.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


QUERY_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('h' || source, '') AS host FROM documents),
w AS (SELECT r, word, i FROM (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d))),
win AS (SELECT r, i, CASE WHEN lead(word, 4) OVER o IS NOT NULL THEN concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) END AS g FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
rep AS (SELECT r, i FROM (SELECT r, i, g, count(*) OVER (PARTITION BY r, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
cover AS (SELECT r, sum(least(5, coalesce(nxt - i, 5))) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r),
nw AS (SELECT r, count(*) AS n, sum(length(word)) AS chars FROM w GROUP BY r),
ln AS (SELECT r, doc_id, host, k, line, trim(lower(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS plain, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
       FROM (SELECT r, doc_id, host, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM (SELECT *, string_split(text, chr(10)) AS ls FROM d)) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM ln GROUP BY r),
dl AS (SELECT DISTINCT r, doc_id, host, plain FROM ln),
fam AS (SELECT r, string_agg(plain, chr(10) ORDER BY k) AS family FROM ln GROUP BY r),
freq AS (SELECT host, plain, arg_min(family, doc_id) AS keeper FROM dl JOIN fam USING (r) GROUP BY host, plain HAVING count(DISTINCT family) > 10),
gone AS (SELECT ln.r, sum(ln.n) AS n FROM ln JOIN freq USING (host, plain) JOIN fam USING (r) WHERE fam.family <> freq.keeper GROUP BY ln.r),
b AS (SELECT d.r, doc_id, coalesce(nw.n, 0)::BIGINT AS n_words, coalesce(nw.chars, 0)::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
             coalesce(cover.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS gone
      FROM d LEFT JOIN nw ON nw.r = d.r LEFT JOIN dup ON dup.r = d.r LEFT JOIN cover ON cover.r = d.r LEFT JOIN gone ON gone.r = d.r),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_words - gone AS words_left FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_left,
       NOT base_failed AND NOT (gone > 0 AND (words_left < 0.2 * n_words OR words_left < 10)) AS kept
FROM f
"""
