"""Personal data in texts: plain identifiers, and disguised ones found through an offset-preserving normal form.

Base kinds (leftmost, non-overlapping, each over the raw text): email, ip (parts to 255), card (13 to 19 digits that
pass Luhn), phone (9 to 15 digits after a plus). A match that fails its check is dropped without another try.

The normal form is made by two transducers that keep an alignment to the source. The first maps characters one to
one (full-width forms, other decimal digits, look-alike Greek and Cyrillic letters, dash and dot variants). The
second rewrites stretches: ``[at]``/``(dot)`` and spelled ``at``/``dot`` between address parts become ``@`` and
``.``, runs of spelled digits (English, German, French, Spanish) become digits, invisible characters vanish. The
base patterns then run over the normal form; a match that holds something rewritten is mapped back to source
positions and added, unless it overlaps a base span of its kind. Base spans always stay.

A plain `` at `` counts only before a domain whose dots are spelled too, so that prose with the word stays clean.

Edge cases: a null or empty text has no spans; offsets are code points, ends exclusive; repeated rows give equal
rows; an empty table gives an empty result; other columns are ignored. Work is linear in the text's length.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits is tried from its start alone and never given back, so that long runs cost one pass.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])) % 10 == 0


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base kinds, in order of kind and start."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text):
        at = begin = m.start()
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        if begin < at:
            found.append((0, begin, m.end()))
            last = m.end()
    for m in _IP.finditer(text):
        # Parts may have any number of leading zeros; only their value counts.
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


# Letters that look like Latin ones, each with the letter it stands for.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "﹣": "-", "․": ".", "。": ".", "｡": ".", "·": ".", "•": ".",
}
INVISIBLE = "­​‌‍‎‏⁠﻿"

# The digits 0 to 9 as they are spelled.
DIGIT_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "zwo": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
DOT_WORDS = ("dot", "punkt", "point", "punto")
AT_WORDS = ("at", "arroba", "arobase")
# Those that are no words of prose: they count before a written domain too.
SURE_AT_WORDS = AT_WORDS[1:]


@cache
def _table() -> dict[int, str]:
    """Characters whose compatibility form is one printable ASCII character, decimal digits, and look-alikes."""
    table = {}
    for c in range(0x80, 0x20000):
        x = chr(c)
        if x in INVISIBLE or x in "ªº²³¹" or 0xD800 <= c < 0xE000:
            continue
        if unicodedata.category(x) == "Nd":
            table[c] = str(unicodedata.decimal(x))
        elif len(y := unicodedata.normalize("NFKC", x)) == 1 and " " <= y <= "~":
            table[c] = y
    return table | {ord(k): v for k, v in LOOKALIKES.items()}


@cache
def _odd() -> frozenset[str]:
    return frozenset(map(chr, _table())) | frozenset(INVISIBLE)


# Characters beyond Latin-1, and those of Latin-1 that the table has: most texts have none of them.
_BEYOND = re.compile("[\xa0\xad\xb7\u0100-\U0010ffff]")

_digit = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
_dot, _at = "|".join(DOT_WORDS), "|".join(AT_WORDS)
_open, _close = r"[\[({<]\s{0,3}", r"\s{0,3}[\])}>]"
_after_at = rf"(?:(?:{_at})\s{{1,3}}(?=[a-z0-9-]+\s{{0,3}}(?:{_open})?(?:{_dot})(?![a-z0-9]))|(?:{'|'.join(SURE_AT_WORDS)})\s{{1,3}}(?=[a-z0-9-]+\.[a-z0-9-]))"
# A spelled or written digit, and what may stand between two of them.
_one = rf"(?:(?<![^\W_])(?:(?:double|triple)\s{{1,3}})?(?:{_digit})(?![^\W_])|(?<![0-9])[0-9]++)"
_gap = r"[\s,-]{1,3}"
_REWRITE = re.compile(
    rf"(?P<at>\s{{0,3}}{_open}(?:{_at}|@){_close}\s{{0,3}})"
    rf"|(?P<dot>\s{{0,3}}{_open}(?:{_dot}|\.){_close}\s{{0,3}})"
    rf"|(?P<plainat>(?<=[a-z0-9])\s{{1,3}}{_after_at})"
    rf"|(?P<spacedat>(?<=[a-z0-9])(?:\s{{1,3}}@\s{{0,3}}|@\s{{1,3}})(?=[a-z0-9-]+\s{{0,3}}(?:\.|{_open}|(?:{_dot})\s)))"
    rf"|(?P<plaindot>(?<=[a-z0-9])\s{{1,3}}(?:{_dot})\s{{1,3}}(?=[a-z0-9]))"
    rf"|(?P<plus>(?<![^\W_])plus\s{{1,3}}(?={_one}))"
    rf"|(?P<digits>{_one}(?:(?:{_gap}|\s{{1,3}}(?:{_dot})\s{{1,3}}){_one}){{2,}})"
    rf"|(?P<gone>[{INVISIBLE}]+)",
    re.IGNORECASE,
)
_ITEM = re.compile(rf"(?:(double|triple)\s{{1,3}})?({_digit}|[0-9]+)|\s{{1,3}}(?:{_dot})\s{{1,3}}", re.IGNORECASE)
_SPELLED = re.compile(r"[^\W\d_]")
_TO_BLANK = bytes(c if chr(c).isalnum() or c >= 0x80 else 32 for c in range(128)) + bytes(range(128, 256))
# What each alternative of _REWRITE needs to match and to matter, from the same words. Digits that are common words in
# prose need a digit beside them, dots one after them or an @ somewhere.
_COMMON = ("un", "six", "dos", "tres")
_DIGIT_HINTS, _COMMON_HINTS, _DOT_HINTS, _AT_HINTS = (frozenset(x.encode() for x in words) for words in (set(DIGIT_WORDS) - set(_COMMON), _COMMON, DOT_WORDS, AT_WORDS))
_few = rf"(?<![^\W_])(?:{'|'.join(_COMMON)})(?![^\W_])"
_more = rf"(?:[0-9]|(?:(?:double|triple)\s{{1,3}})?{_few})"
_sep = rf"(?:{_gap}|\s{{1,3}}(?:{_dot})\s{{1,3}})"
_PAIR = re.compile(rf"{_few}{_sep}{_more}|[0-9]{_sep}(?:(?:double|triple)\s{{1,3}})?{_few}", re.IGNORECASE)
_BRACKET = re.compile(rf"{_open}(?:{_at}|{_dot}|[@.]){_close}", re.IGNORECASE)
_SPACED = re.compile(r"\s@|@\s")
_PLAIN_AT = re.compile(rf"\s{_after_at}", re.IGNORECASE)
_DOT_ONE = re.compile(rf"\s(?:{_dot})\s{{1,3}}{_one}", re.IGNORECASE)
_PLUS_ONE = re.compile(rf"(?<![^\W_])plus\s{{1,3}}{_one}", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")


def normal_form(text: str) -> tuple[str, list[int], list[int], list[int]]:
    """The normal form and its alignment: for each stretch where it starts there, where it starts in the text, and
    where it ends in the text (0 for a stretch that is kept character by character)."""
    mapped = text if text.isascii() else text.translate(_table())
    out, starts, sources, ends, at, n = [], [], [], [], 0, 0

    def put(piece: str, source: int, end: int) -> None:
        nonlocal n
        if piece:
            out.append(piece)
            starts.append(n)
            sources.append(source)
            ends.append(end)
            n += len(piece)

    for m in _REWRITE.finditer(mapped):
        kind = m.lastgroup
        if kind == "digits":
            if not _SPELLED.search(m[0]):
                continue
            put(mapped[at : m.start()], at, 0)
            for x in _ITEM.finditer(m[0]):
                digit = DIGIT_WORDS.get(x[2].lower(), x[2]) if x[2] else "."
                put(digit * {None: 1, "double": 2, "triple": 3}[x[1] and x[1].lower()], m.start() + x.start(), m.start() + x.end())
        else:
            put(mapped[at : m.start()], at, 0)
            put({"at": "@", "plainat": "@", "spacedat": "@", "dot": ".", "plaindot": ".", "plus": "+", "gone": ""}[kind], m.start(), m.end())
        at = m.end()
    put(mapped[at:], at, 0)
    return "".join(out), starts, sources, ends


def _hinted(text: str) -> bool:
    """Whether the normal form can differ from the text in a span; cheap, and never wrongly false: a span that is
    added holds a mapped character or a stretch that is rewritten, and each kind of them is looked for."""
    if _BEYOND.search(text) and ("\u0130" in text or not _odd().isdisjoint(text)):  # the former is an i where case is ignored
        return True
    if _BRACKET.search(text) or ("@" in text and _SPACED.search(text)):
        return True
    low = text.lower()
    words = set(low.encode().translate(_TO_BLANK).split() if low.isascii() else (x.encode("utf-8", "replace") for x in _WORD.findall(low)))
    if not _DIGIT_HINTS.isdisjoint(words):
        return True
    if not _DOT_HINTS.isdisjoint(words) and ("@" in text or _DOT_ONE.search(text)):
        return True
    return bool(
        (not _COMMON_HINTS.isdisjoint(words) and _PAIR.search(text)) or (not _AT_HINTS.isdisjoint(words) and _PLAIN_AT.search(text)) or (b"plus" in words and _PLUS_ONE.search(text))
    )


def disguised_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not _hinted(text):
        return []
    norm, starts, sources, ends = normal_form(text)
    if norm == text:
        return []
    found, taken = [], {k: [(s, e) for kind, s, e in base if kind == k] for k in range(len(KINDS))}
    for kind, s, e in plain_spans(norm):
        i, j = bisect_right(starts, s) - 1, bisect_right(starts, e - 1) - 1
        begin = sources[i] + (0 if ends[i] else s - starts[i])
        end = ends[j] or sources[j] + e - starts[j]
        if text[begin:end] == norm[s:e]:
            continue
        spans = taken[kind]
        k = bisect_right(spans, (begin, len(text) + 1))
        if (k and spans[k - 1][1] > begin) or (k < len(spans) and spans[k][0] < end):
            continue
        found.append((kind, begin, end))
    return found


def all_spans(text: str | None) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, whether it is a base span), in order of kind and start."""
    if not text:
        return []
    base = plain_spans(text)
    return sorted([(*x, True) for x in base] + [(*x, False) for x in disguised_spans(text, base)])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def _find(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "base": b} for k, s, e, b in all_spans(x)] for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(_SPAN))], ["doc_id", "spans"])


def pii_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and its spans, an array of (kind, start, end, base)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_find, "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def masked(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the text with each span replaced by its kind in angle brackets."""

    def cover(batches):
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                at, parts = 0, []
                for s, e, k in sorted((s, -e, k) for k, s, e, _ in all_spans(x)):
                    if s >= at:
                        parts += [x[at:s], f"<{KINDS[k]}>"]
                    at = max(at, -e)
                out.append(None if x is None else "".join([*parts, x[at:]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(cover, "doc_id long, text string")


def digests(spans: DataFrame) -> DataFrame:
    """The digest columns of ``pii_spans``: counts (base spans), base_sha256 and spans as text, n_added, and
    n_spans, all spans of all kinds, disguised ones included: a document without personal data has 0."""
    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    counts = [F.size(F.filter(base, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return spans.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added"), F.size("spans").cast("long").alias("n_spans"))
