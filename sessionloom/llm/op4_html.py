"""Main text of HTML pages: the maximum-scoring stretch of words and tags, with weights learned from labelled pages.

A page is a row of words and tags. A word scores by where it stands: the nearest enclosing element with a decided weight
decides, links and other inline elements shift it a little; every tag costs. One linear scan finds the contiguous
stretch with the largest sum. Blocks in it, and in the main elements it touches, that score above zero are the main text.

Weights are learned from labelled pages, those whose author marked exactly one ``<article>`` or ``<main>``: for every kind of
element (name and classes) the words of the marked part against all others, counted over all pages. Kinds that no labelled
page shows are weighted by fixed lists of names. At most ``KINDS`` kinds are kept, those with most words.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by one
line end; nothing else is dropped or cut. Defined cases: null and empty pages give the empty text; broken markup (open
elements, stray or cut-off tags) is read as far as it goes; repeated rows get equal texts. Other columns are kept.
"""

from __future__ import annotations

import html as entities
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

KINDS = 5_000
#: Score of a word by its place: main content, unknown, boilerplate; limits of learned weights; cost of a tag.
MAIN, UNKNOWN, OTHER, LIMIT, TAG = 2.0, 1.0, -1.5, 4.0, -0.1

# Elements by their role in HTML.
_RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "canvas", "object", "audio", "video", "title", "textarea"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark",
    "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "input", "nobr", "ruby", "rt"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "head", "fieldset"}
_CONTENT = {"article", "main"}
_CONTAINER = _BOILERPLATE | _CONTENT | {"header", "section", "div", "ul", "ol", "table", "td", "span", "p", "figure", "details", "address"}
_BAD_NAME = re.compile(
    r"(^|[-_ ])(ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|sidebar|side|menu|nav\w*|breadcrumbs?|header|footer|foot|masthead|"
    r"comments?|replies|reply|respond|disqus|notice|alert|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|widget|toolbar|pagination|pager|copyright|legal|skip|search|form)($|[-_ \d])", re.I)
_GOOD_NAME = re.compile(r"(^|[-_ ])(article|main|content|post|entry|story|body|text|prose)($|[-_ \d])", re.I)
_CLOSES = {  # elements that a new one of these ends, if it is open nearest
    "p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"},
    "th": {"td", "th", "p"}, "option": {"option"}}
_ENDS_P = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "menu", "nav", "ol", "pre", "section", "table", "ul"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _kind(name: str, attributes: str) -> str:
    names = " ".join(sorted({x.lower() for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").split()})) if attributes else ""
    return f"{name}.{names}" if names else name


def _parts(page: str):
    """``("text", words, stack)`` and ``("tag", block, stack)`` in page order; the stack holds ``(name, kind, start)`` of open elements."""
    at, stack = 0, []
    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None or m.start() > at:
            text = entities.unescape(page[at:m.start() if m else len(page)])
            yield "text", text, stack
        if m is None:
            return
        at = m.end()
        name = m[2].lower() if m[2] else None
        if name is None:
            continue
        block = name not in _INLINE
        if m[1]:
            if any(e[0] == name for e in stack):
                while stack and stack[-1][0] != name:
                    stack.pop()
                stack.pop()
            yield "tag", block, stack
            continue
        if name in _RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "tag", block, stack
            continue
        shut = _CLOSES.get(name, {"p"} if name in _ENDS_P else set())
        while shut and (near := next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] not in _INLINE), None)) is not None and stack[near][0] in shut:
            del stack[near:]
        yield "tag", block, stack
        if name not in _VOID and not m[3].rstrip().endswith("/"):
            stack.append((name, _kind(name, m[3]), m.start()))


def _count(batches):
    """Words of each kind of element in the marked part of labelled pages and elsewhere in them."""
    totals: dict[str, list[int]] = {}
    for batch in batches:
        for page in batch.column("html").to_pylist():
            if not page or len(re.findall(r"<(?:article|main)\b", page, re.I)) != 1:
                continue
            for what, text, stack in _parts(page):
                if what != "text" or not (n := len(text.split())):
                    continue
                inside = any(e[0] in _CONTENT for e in stack)
                for kind in {k for name, k, _ in stack if name not in ("html", "body")}:
                    totals.setdefault(kind, [0, 0])[0 if inside else 1] += n
        if len(totals) > 20_000:
            yield _counts(totals)
            totals = {}
    yield _counts(totals)


def _counts(totals: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(list(totals), pa.string()), *(pa.array([v[i] for v in totals.values()], pa.int64()) for i in (0, 1))], ["kind", "inside", "outside"])


def learn(pages: DataFrame, column: str = "html") -> dict[str, float]:
    """Log-odds of main text for each kind of element; the driver receives at most ``KINDS`` rows."""
    rows = pages.select(F.col(column).cast("string").alias("html")).mapInArrow(_count, "kind string, inside long, outside long")
    top = rows.groupBy("kind").agg(F.sum("inside").alias("inside"), F.sum("outside").alias("outside")).orderBy(
        F.desc(F.col("inside") + F.col("outside")), "kind").limit(KINDS).collect()
    return {r.kind: max(-LIMIT, min(LIMIT, math.log((r.inside + 0.5) / (r.outside + 0.5)))) for r in top}


def _place(stack: list, weights: dict[str, float]) -> tuple[float, int]:
    """Score of a word below these open elements, and where the main element that decided it starts, or -1."""
    shift, value, within, whose = 0.0, None, False, -1
    for i in range(len(stack) - 1, -1, -1):
        name, kind, begin = stack[i]
        if value is None:
            named = kind[len(name) + 1:]
            known = weights.get(kind)
            if name in _BOILERPLATE:
                value = OTHER
            elif name == "header" and not any(e[0] in _CONTENT for e in stack[:i]):
                value = OTHER
            elif name in _CONTENT:
                value = MAIN
            elif named and known is not None and abs(known) >= 2 and name in _CONTAINER:
                value = MAIN if known > 0 else OTHER
            elif named and _BAD_NAME.search(named) and not _GOOD_NAME.search(named):
                value = OTHER
            elif named and _GOOD_NAME.search(named):
                value = MAIN
            elif name == "a" and not within:
                shift, within = -0.75 * UNKNOWN - 0.5, True
            if value == MAIN:
                whose = begin
    return (UNKNOWN + shift if value is None else value), whose


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of one page."""
    if not page:
        return ""
    scores, owner, blocks, values, mains, open_ = [], [], [], [], [], None
    for what, x, stack in _parts(page):
        if what == "tag":
            scores.append(TAG)
            owner.append(-1)
            if x:
                open_ = None
            continue
        if open_ is None:
            if not x.strip():
                continue
            open_ = len(blocks)
            blocks.append([])
            values.append(0.0)
            mains.append(_place(stack, weights)[1])
        word = _place(stack, weights)[0]
        blocks[open_].append((x, word))
        n = len(x.split())
        values[open_] += n * word
        if n:
            scores.append(n * word)
            owner.append(open_)
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, s in enumerate(scores):  # the stretch with the largest sum ends at i or before
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, span = total, (start, i + 1)
    inside = {o for o in owner[span[0]:span[1]] if o >= 0}
    whole = {mains[o] for o in inside if values[o] > 0} - {-1}  # main elements that the stretch is in: with all they hold
    inside |= {i for i, m in enumerate(mains) if m in whole}
    out = []
    for i, parts in enumerate(blocks):
        if i in inside and values[i] > 0:
            text = " ".join("".join(x for x, w in parts if w > OTHER).split())
            if text:
                out.append(text)
    return "\n".join(out)


def main_text(pages: DataFrame, weights: dict[str, float], column: str = "html") -> DataFrame:
    """``pages`` with ``text`` in place of ``column``."""
    kept = [c for c in pages.columns if c not in (column, "text")]
    pages = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [extract(p.as_py(), weights).encode("utf-8", "replace").decode() for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return pages.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in pages.dtypes if n != "html") + ", text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page, with weights from all labelled pages."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages, learn(pages)).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op4_html_text": op4_html_text}
SQL: dict[str, str] = {}
