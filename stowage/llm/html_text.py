"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block; a line break is white space inside
one. A line's weight is the length of its text (outside links, where no article is
marked); lines inside menus, headers, footers, sidebars, notices, adverts, forms and
comment sections weigh nothing, nor do lines outside the article where the page
marks one. Weights are summed over sliding windows of ``WINDOW`` lines. Where the
sum surges above the threshold a span begins, and where it dives to nothing the
span ends; the text between is kept, where no article is marked with the lines
wholly inside links among it.

The threshold is nothing where the page marks its article, since then only
article lines weigh, and all of an article is wanted however short its spans are;
elsewhere a span must reach ``SURGE`` at some window. If none does, the heaviest
span is kept.

What isn't the article shows by its element, or by a word of its class, id or role
(``ASIDE_WORDS``). Such a word doesn't count beside a word that denies it
(``no-ads``, ``has-sidebar``), on an element that holds a marked article or most of
the page's text (unless it is a section of comments), or on a part of a line.

Scale: one map over pages, no shuffle, memory for one page at a time.

Defined results: null and empty html, and pages without text, give an empty
string; rows are independent, so null or repeated page_ids and clashing extra
columns don't matter; no rows in, no rows out. Raw text elements (scripts, styles,
titles, text areas) that are never closed reach to the page's end; other elements
whose content isn't text are skipped only if they are closed.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.words import rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import table

WINDOW = 3
SURGE = 80

#: Elements of HTML by what they do to lines.
BLOCKS = frozenset(
    "address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul video".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not text.
OPAQUE = frozenset("script style template noscript iframe object svg math canvas audio video title textarea select noembed noframes".split())
#: Their content isn't the article.
ASIDE = frozenset("nav footer aside form menu dialog button search".split())
#: Words in class, id and role that mark what isn't the article.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer gdpr legal masthead menu menus modal nav navbar navigation newsletter notice notices notification pagination pager popup promo promoted promotion related replies reply respond search share sharing sidebar sidebars signup skip social sponsor sponsored subscribe subscription syndication teaser toolbar widget widgets".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Beside these a word of ``ASIDE_WORDS`` says that there is none, or that there is one elsewhere.
DENYING = frozenset("has have no not non with without hide hidden off closed disabled enabled free above below after before".split())
#: Unclosed, they reach to the page's end.
RAW = frozenset("script style title textarea".split())
#: An open element of the left kind is closed by a start tag of the right kinds.
CLOSED_BY = {
    "p": BLOCKS - {"option", "optgroup", "legend"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot", "thead"]),
    "option": frozenset(["option", "optgroup"]),
}

_TAG = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^"'<>]|"[^"]*"|'[^']*')*+)>|[!?/][^<>]*>)""", re.S)
_ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_TELLING = re.compile("class|id|role|hidden|style", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[A-Za-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


def attributes(attrs: str) -> dict[str, str]:
    """The attributes of a start tag by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(attrs):
        quoted = value[:1] in ("'", '"') and len(value) > 1
        out.setdefault(name.lower(), unescape(value[1:-1] if quoted else value))
    return out


#: What an element is: part of the page, surely aside, aside if it doesn't hold most of the text, or comments.
PLAIN, SURE, LIKELY, COMMENTS = range(4)


def kind_of(name: str, attrs: str, in_article: bool) -> int:
    if name in ASIDE or (name == "header" and not in_article):
        return SURE
    if not _TELLING.search(attrs) or name in ("html", "body"):
        return PLAIN
    found = attributes(attrs)
    if "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or _UNSEEN.search(found.get("style", "")):
        return SURE
    out = PLAIN
    for token in " ".join(found.get(k, "") for k in ("class", "id", "role")).split():
        words = [w.lower() for w in _WORD.findall(_HUMP.sub(" ", token))]
        if any(w in DENYING for w in words):
            continue
        if any(w in COMMENT_WORDS for w in words):
            return COMMENTS
        if name in ("article", "main"):
            continue
        if any(w in ASIDE_WORDS for w in words) or ("header" in words and not in_article and name not in HEADINGS):
            out = LIKELY
    return out


class Line:
    """A line's text, its characters outside links, whether an article holds it, and the likely asides that do."""

    __slots__ = ("asides", "in_article", "plain", "text")

    def __init__(self, text: str, plain: int, in_article: bool, asides: tuple[int, ...]) -> None:
        self.text, self.plain, self.in_article, self.asides = text, plain, in_article, asides


class Stripper:
    """Strips markup into ``rows``: lines, and None where a sure aside stood."""

    def __init__(self) -> None:
        self.rows: list[Line | None] = []
        self.parts: list[str] = []
        self.plain = self.inner = self.outer = 0  # characters outside links; in and outside of parts of lines that look like asides
        self.stack: list[tuple[str, int, int]] = []  # open elements: name, kind, number of a likely aside
        self.open_count: Counter[str] = Counter()
        self.sure = self.articles = self.links = self.inline = self.made = 0
        self.open_asides: list[int] = []
        self.kinds: dict[int, int] = {}
        self.holds_article: set[int] = set()
        self.article_asides: list[tuple[int, ...]] = []  # the likely asides around each article that no sure one holds
        self.line_in_article = False
        self.line_asides: tuple[int, ...] = ()

    def text(self, raw: str) -> None:
        if not raw or self.sure:
            return
        found = unescape(raw)
        if not self.parts:
            self.line_in_article, self.line_asides = self.articles > 0, tuple(self.open_asides)
        self.parts.append(found)
        size = len(found.strip())
        self.plain += 0 if self.links else size
        if self.inline:
            self.inner += size
        else:
            self.outer += size

    def end_line(self) -> None:
        joined = _SPACE.sub(" ", "".join(self.parts)).strip()
        if joined:
            if self.inner and not self.outer:
                self.gap()
            else:
                self.rows.append(Line(joined, self.plain, self.line_in_article, self.line_asides))
        self.parts.clear()
        self.plain = self.inner = self.outer = 0

    def gap(self) -> None:
        if self.rows and self.rows[-1] is not None:
            self.rows.append(None)

    def start(self, name: str, attrs: str) -> None:
        kind, number = kind_of(name, attrs, self.articles > 0), 0
        if kind == SURE:
            if not self.sure and name in BLOCKS:
                self.end_line()
                self.gap()
            self.sure += 1
        elif kind in (LIKELY, COMMENTS) and name not in BLOCKS:
            self.inline += 1
        elif kind in (LIKELY, COMMENTS):
            self.made += 1
            number = self.made
            self.kinds[number] = kind
            self.open_asides.append(number)
        if name in ("article", "main") and kind != SURE:
            self.articles += 1
            if not self.sure:
                self.article_asides.append(tuple(self.open_asides))
                self.holds_article.update(n for n in self.open_asides if n != number)
        elif name == "a":
            self.links += 1
        self.stack.append((name, kind, number))
        self.open_count[name] += 1

    def pop_to(self, index: int) -> None:
        while len(self.stack) > index:
            name, kind, number = self.stack.pop()
            self.open_count[name] -= 1
            if kind == SURE:
                self.sure -= 1
                if not self.sure and name in BLOCKS:
                    self.gap()
            elif number:
                self.open_asides.remove(number)
            elif kind != PLAIN:
                self.inline -= 1
            if name in ("article", "main") and kind != SURE:
                self.articles -= 1
            elif name == "a":
                self.links -= 1

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.end_line()
        elif name == "br":
            self.text(" ")
        if self.open_count[name]:
            self.pop_to(next(i for i in range(len(self.stack) - 1, -1, -1) if self.stack[i][0] == name))

    def close_implied(self, name: str) -> None:
        """Closes what a block's start tag closes."""
        stack = self.stack
        if stack and name in CLOSED_BY.get(stack[-1][0], ()):
            self.pop_to(len(stack) - 1)
        elif name in CLOSED_BY["p"]:
            # formatting left open doesn't keep a paragraph open
            for i in range(len(stack) - 1, max(-1, len(stack) - 12), -1):
                if stack[i][0] == "p":
                    self.pop_to(i)
                    break
                if stack[i][0] in BLOCKS:
                    break

    def run(self, html: str) -> None:
        never_closed: set[str] = set()
        at, n = 0, len(html)
        while at < n:
            m = _TAG.search(html, at)
            if m is None:
                self.text(html[at:])
                break
            self.text(html[at : m.start()])
            at = m.end()
            if m["name"] is None:
                continue
            name = m["name"].lower()
            if m["close"]:
                self.close(name)
                continue
            if name in BLOCKS:
                self.end_line()
                self.close_implied(name)
            if name in OPAQUE and name not in never_closed:
                closed = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if closed is not None:
                    at = closed.end()
                    continue
                if name in RAW:
                    break
                never_closed.add(name)
            if name == "br":
                self.text(" ")
            if name not in VOID and not (m["attrs"].endswith("/") and name not in BLOCKS):
                self.start(name, m["attrs"])
        self.end_line()

    def asides(self) -> set[int]:
        """Those of the likely asides that are asides."""
        held: Counter[int] = Counter()
        total = 0
        for row in self.rows:
            if row is not None:
                total += len(row.text)
                for number in row.asides:
                    held[number] += len(row.text)
        return {n for n, kind in self.kinds.items() if kind == COMMENTS or n not in self.holds_article and 2 * held[n] <= total}


def lines(html: str) -> tuple[list[tuple[str, int]], bool]:
    """(text, weight) of each line in page order, empty ones standing for asides, and whether the page marks its article."""
    found = Stripper()
    found.run(html)
    asides = found.asides()
    marked = any(asides.isdisjoint(around) for around in found.article_asides)
    out: list[tuple[str, int]] = []
    for row in found.rows:
        if row is None or not asides.isdisjoint(row.asides):
            if out and out[-1][0]:
                out.append(("", 0))
        elif marked:
            out.append((row.text, len(row.text) if row.in_article else 0))
        else:
            out.append((row.text, row.plain))
    return out, marked


def spans(weights: list[int], threshold: int, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges between a surge of the window sums and the next dive to nothing, of those that pass the threshold."""
    n = len(weights)
    total = [0] * (n + window)
    for i in range(n):
        total[i] = sum(weights[i : i + window])
    out, start, peak = [], None, 0
    for i in range(n + 1):
        if i < n and total[i] > 0:
            start = i if start is None else start
            peak = max(peak, total[i])
        elif start is not None:
            out.append((start, i, peak))
            start, peak = None, 0
    passed = [(a, b) for a, b, peak in out if peak > threshold]
    return passed or [max(out, key=lambda s: s[2])[:2]] if out else []


def extract(html: str | None) -> str:
    """The main text, its blocks joined by line feeds."""
    if not html:
        return ""
    found, marked = lines(html)
    weights = [w for _, w in found]
    kept: list[str] = []
    for a, b in spans(weights, 0 if marked else SURGE):
        if marked:
            kept += [t for t, w in found[a:b] if w]
            continue
        # weights only place the span: linked lines in it stay, but not those that its first window reaches across an aside
        first = next(i for i in range(a, b) if weights[i])
        start = max((i + 1 for i in range(a, first) if not found[i][0]), default=a)
        kept += [t for t, _ in found[start:b] if t]
    return "\n".join(kept)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in rows_by_bytes(batches, 2):
            made = [extract(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
