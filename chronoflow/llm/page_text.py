"""Main text of web pages by equivalence-class template deduction.

Pages of a host are read as tokens: tags with their place in the tree, and texts with theirs. Tokens whose counts
over the group's pages (their occurrence vectors) are equal form a class. A class is valid if its tokens come in the
same order in every page, as often as the vector says; valid classes nest, each in the gap of the innermost one
around it, and together are the template. What the template does not hold are slots.

From the slots the main text is taken: those in the page's article (``article``, ``main`` or what stands for them), or,
on a page without one, those in the part of the template that holds most of the slots' text. Parts that are
navigation, headers, footers, sidebars, adverts, notices, forms, scripts, styles or comments by their tag, role or
class name are left out wherever they are. Outside articles a text of the template is boilerplate and goes. Inside an
article it goes if at least half of the group's articles, and three, have it, where only articles with another slot
text each count, and only if as many of their texts are slots as are template: near copies of an article, which share
more texts than they have of their own, are no evidence and lose nothing, nor do passages that fewer articles share. An
article of nothing else stays whole. How long texts are plays no part. A class name inside an article that says more than
that its part is to be left out (``social-history``) is for the template to judge: slots stay, template texts go. Hosts
with one or two pages have no template that counts; there tags and names decide alone.

A host's pages are dealt into groups of about ``GROUP`` pages by a hash, so a host with a third of all pages is the
work of many tasks. Equal pages count once in a vector.

Edge cases: a null or empty html gives an empty text; a null or odd url is a host of its own kind; repeated rows give
equal rows; an empty table gives an empty result; other columns are ignored. Tags that are never closed, pages cut
off inside a tag or comment, and stray ``<`` are read as browsers do.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import Counter, defaultdict
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from chronoflow.llm.store import written

GROUP = 100

# Names of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption head html legend option optgroup tbody td tfoot th thead tr".split())
LEFT_OUT = frozenset("script style noscript template head nav footer aside form button select textarea iframe svg canvas object dialog menu audio video map noembed noframes math".split())
LEFT_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
LEFT_OUT_NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu sidebar footer masthead comment comments "
    "disqus respond cookie cookies consent gdpr notice notices newsletter subscribe popup modal overlay share sharing social related recommended breadcrumb breadcrumbs "
    "pagination pager widget toolbar login signup".split()
)
# Names that stand beside those above without changing what they say.
BESIDE = frozenset(
    "area bar block body bottom box button buttons center column container content count entry field fields form group head header headline icon icons inner item items label left link links list "
    "main outer page panel part post posts right row section site slot text thread title top unit wrap wrapper".split()
)
# What an open element of a kind is closed by, at the start of another of the kind.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}, "tbody": {"table"}}

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?(?:-->|\Z))|(?P<odd>[!?][^>]*(?:>|\Z))|(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>[^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>|/?(?P<loose>[A-Za-z][^\s/>]*)(?P<rest>[^>]*)(?:>|\Z))""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAME = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")
_SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "path", "out", "main", "odd")

    def __init__(self, tag: str, path: str, out: bool, main: bool, odd: bool):
        self.tag, self.path, self.out, self.main, self.odd = tag, path, out, main, odd


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)}


def _element(tag: str, attrs: str, parent: Element | None) -> Element:
    a = _attributes(attrs) if attrs.strip(" /\n\t") else {}
    names = {x.lower() for x in _NAME.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    role = a.get("role", "").lower()
    style = a.get("style", "").replace(" ", "").lower()
    inside = parent is not None and parent.main
    out = (parent is not None and parent.out) or tag in LEFT_OUT or (tag == "header" and not inside) or role in LEFT_OUT_ROLES or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style
    # Inside an article a name that says more than that leaves the matter to the template.
    named = tag not in ("html", "body", "article", "main") and bool(names & LEFT_OUT_NAMES)
    odd = (parent is not None and parent.odd) or (named and inside and not names <= LEFT_OUT_NAMES | BESIDE)
    out = out or (named and not odd) or (tag == "article" and bool(names & {"comment", "ad", "ads", "related", "promo"}))
    out = out or (tag not in ("html", "body", "article", "main") and "header" in names and not inside)
    main = inside or (not out and (tag in ("article", "main") or role in ("main", "article") or a.get("itemprop", "").lower() == "articlebody"))
    label = tag + "".join(f".{x}" for x in sorted(set(a.get("class", "").split()))) + (f"#{a['id']}" if "id" in a else "")
    return Element(tag, f"{parent.path if parent else ''}/{label}", out, main, odd)


def tokens_of(html: str) -> list[tuple[str, str, Element, int]]:
    """(key, text, element, block) of a page in order: key says what the token is and where in the tree, text is
    empty for tags, block counts the block boundaries before it."""
    found, stack, at, block, n = [], [_element("#root", "", None)], 0, 0, len(html)

    def put(text: str) -> None:
        if text:
            top = stack[-1]
            # A long text is known by its hash, which starts with a character that no text has.
            key = text if len(text) <= 300 else f"\0{blake2b(text.encode('utf-8', 'replace'), digest_size=16).hexdigest()}"
            found.append((f"{top.path}|{key}", htmllib.unescape(text), top, block))

    while at < n:
        m = _TAG.search(html, at)
        if not m:
            put(html[at:])
            break
        put(html[at : m.start()])
        at = m.end()
        if m["comment"] is not None or m["odd"] is not None:
            continue
        tag, attrs = (m["name"] or m["loose"]).lower(), m["attrs"] if m["name"] else m["rest"]
        end = bool(m["end"]) or (m["loose"] is not None and m[0].startswith("</"))
        if m["loose"] is not None and not m[0].endswith(">"):
            break  # cut off inside a tag
        if tag in BLOCK:
            block += 1
        if end:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    found.append((f"{stack[k].path}<", "", stack[k], block))
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline element ends no block
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCK:
                    break
        if tag in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in SIBLINGS[tag]:
                    del stack[k:]
                elif stack[k].tag in SCOPES[tag]:
                    break
        element = _element(tag, attrs, stack[-1])
        found.append((f"{element.path}>", " " if tag == "br" else "", element, block))
        if tag in VOID:
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = close.end() if close else n
            block += tag != "textarea"
            continue
        stack.append(element)
    return found


def equivalence_classes(pages: list[list[str]]) -> list[list[str]]:
    """The valid classes of the keys of some pages, each in the order of its tokens."""
    vectors: dict[str, list] = defaultdict(list)
    for i, keys in enumerate(pages):
        for k, n in Counter(keys).items():
            vectors[k].append((i, n))
    classes = defaultdict(list)
    for k, v in vectors.items():
        if len(v) > 1 or len(pages) == 1:
            classes[tuple(v)].append(k)
    number = {k: c for c, keys in enumerate(classes.values()) for k in keys}
    size = [len(x) for x in classes.values()]
    order: list[list[str] | None] = [None] * len(size)
    broken = set()
    for keys in pages:
        runs = defaultdict(list)
        for k in keys:
            if k in number:
                runs[number[k]].append(k)
        for c, run in runs.items():
            first = run[: size[c]]
            if order[c] is None:
                order[c] = first
            if len(set(first)) != size[c] or first != order[c] or run != first * (len(run) // size[c]):
                broken.add(c)
    return [x for c, x in enumerate(order) if x and c not in broken]


def template(pages: list[list[str]]) -> dict[str, tuple[int, int]]:
    """For each key of a nesting class its class and place there; classes that overlap others without nesting go."""
    classes = equivalence_classes(pages)
    place = {k: (c, i) for c, keys in enumerate(classes) for i, k in enumerate(keys)}
    parents: dict[int, tuple | None] = {}
    crossed = set()
    for keys in pages:
        open_: list[list[int]] = []  # class, next place
        for k in keys:
            if k not in place:
                continue
            c, i = place[k]
            if i == 0:
                above = tuple(open_[-1]) if open_ else None
                if parents.setdefault(c, above) != above:
                    parents[c] = None  # it may stand in several gaps: a class of the whole page
                if len(classes[c]) > 1:
                    open_.append([c, 1])
            elif any(x[0] == c for x in open_):  # else it is crossed already and closes nothing
                while open_ and open_[-1][0] != c:
                    crossed.add(open_.pop()[0])
                if open_:
                    open_[-1][1] = i + 1
                    if i + 1 == len(classes[c]):
                        open_.pop()
    return {k: v for k, v in place.items() if v[0] not in crossed}


def _blocks(tokens: list[tuple[str, str, Element, int]], wanted, held=()) -> str:
    """The texts of the wanted elements by blocks, of blocks that hold more than ``held``."""
    parts: dict[int, list[str]] = defaultdict(list)
    own = set()
    for key, text, element, block in tokens:
        if text and wanted(element):
            parts[block].append(text)
            if text.strip() and key not in held:
                own.add(block)
    lines = (_SPACE.sub(" ", "".join(x)).strip() for k, x in parts.items() if k in own)
    return "\n\n".join(x for x in lines if x)


def _central(pages: list[list[tuple]], held: dict) -> str:
    """The place in the tree that holds most of the slots' text: from the root down, as long as one child has at
    least two thirds of it."""
    mass = Counter()
    for tokens in pages:
        for key, text, element, _ in tokens:
            if text.strip() and key not in held and not element.out and element.tag != "a":
                steps = element.path.split("/")
                while len(steps) > 1:
                    mass["/".join(steps)] += len(text)
                    steps.pop()
    at = "/#root"
    while True:
        children = [p for p in mass if p.rpartition("/")[0] == at and p.rpartition("/")[2].split(".")[0].split("#")[0] in BLOCK - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li"}]
        best = max(children, key=lambda p: (mass[p], p), default=None)
        if best is None or mass[best] * 3 < mass[at] * 2:
            return at
        at = best


def _notices(pages: list[list[tuple]], held: dict) -> set[str]:
    """The keys of template texts that articles of different content share. An article speaks for that only if it has as
    many slots of its own as template texts, however long either are."""
    contents, having = set(), defaultdict(set)
    for tokens in pages:
        texts = [key for key, text, e, _ in tokens if text.strip() and e.main and not e.out]
        own = frozenset(k for k in texts if k not in held)
        if not own:
            continue
        contents.add(own)
        if 2 * sum(k not in held for k in texts) >= len(texts):
            for k in texts:
                if k in held:
                    having[k].add(own)
    return {k for k, x in having.items() if len(x) >= max(3, len(contents) / 2)}


def extract(htmls: list[str]) -> list[str]:
    """The main texts of pages of one host."""
    distinct = {h: tokens_of(h) for h in dict.fromkeys(htmls)}
    pages = list(distinct.values())
    held = template([[t[0] for t in tokens if t[0] and (not t[1] or t[1].strip())] for tokens in pages])
    # A text counts as the template's if three pages at least and a fifth of the group have it.
    support = Counter(k for tokens in pages for k in {t[0] for t in tokens if t[1].strip()})
    held = {k: v for k, v in held.items() if k not in support or support[k] >= max(3, len(pages) / 5)}
    central, notices, texts = None, _notices(pages, held), {}
    for h, tokens in distinct.items():
        if any(e.main and t.strip() for _, t, e, _ in tokens):
            article = lambda e: e.main and not e.out
            told = notices | {k for k, _, e, _ in tokens if e.odd and k in held}
            texts[h] = _blocks(tokens, article, told) or _blocks(tokens, article)
        else:
            central = central or _central(pages, held)
            under = central + "/"
            texts[h] = _blocks(tokens, lambda e: not e.out and f"{e.path}/".startswith(under), held)  # noqa: B023
    return [texts[h] for h in htmls]


def _texts(table: pa.Table) -> pa.Table:
    table = table.combine_chunks()
    texts = extract([x or "" for x in table.column("html").to_pylist()])
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(x) for x in texts], pa.int64())})


def host_of(url: str) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def page_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", group: int = GROUP) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    # Written, so that Spark knows its size when it chooses between a broadcast and a shuffle.
    hosts = written(rows.select(host_of("url").alias("host")).groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups")), "hosts")
    rows = rows.withColumn("host", host_of("url")).join(hosts, "host")
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("groups"))).drop("groups")
    return rows.groupBy("host", "salt").applyInArrow(_texts, "page_id long, url string, text string, n_chars long")
