"""Main text of HTML pages by tag-path ratios.

A page becomes a list of text blocks, each with its path of elements from the root. Text length
and punctuation are summed per path and divided by the path's blocks. The product of the two
ratios, smoothed along the page, is a path's content value; paths over a threshold that follows
from the page's own spread are content. The deepest element that holds all of their text,
or the article or main element around it, is the article; headings just before it belong to it. Blocks there are kept in page order, headings and short paragraphs included.
Elements that are menus, notices, adverts, comments and the like by their tag, role or name
give no blocks at all, but a name does not count on an element around an article or main element
or around most of the page's text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Element names of the markup language by the role they play.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td"
    " tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
DROPPED = frozenset(
    "head nav aside footer form button select option template noscript svg canvas object dialog menu label fieldset"
    " audio video map math".split()
)
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Opening one of these closes an open element of the second list, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Words in names of elements that are not the article.
NOT_ARTICLE = re.compile(
    r"(?:^|[\s_-])(?<!has[_-])(?<!with[_-])(?<!no[_-])(?<!without[_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|promos?|promotions?|sponsor(?:ed|s)?|cookies?|consent|gdpr"
    r"|notices?|popup|modal|overlay|newsletter|subscri(?:be|ption)|sidebar|rail|related|recommend(?:ed|ations?)?|share|sharing|social"
    r"|comments?|commentlist|disqus|respond|replies|reply|menu|nav(?:bar|igation)?|breadcrumbs?|footer|header|masthead|topbar"
    r"|pagination|pager|widget|login|signup|toolbar|copyright|disclaimer|skip|search)(?:$|[\s_-])",
    re.IGNORECASE,
)
HEADER_ONLY = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-])", re.IGNORECASE)

_TAG = re.compile(r"""<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/"']|$)""", re.IGNORECASE)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？،؟]")

#: Blocks to each side that smoothing weighs.
REACH = 2
#: Share of the page's text, without links, from which an element is no menu or notice by its name.
MOST = 0.8
#: Share of a block's text in links from which it is a list of links.
LINKED = 0.6


@dataclass
class Element:
    name: str
    number: int
    parent: Element | None
    dropped: bool
    named: tuple[int, ...] = ()  # elements around it, and itself, that are not the article by name
    heading_only: bool = False
    in_link: bool = False


@dataclass
class Block:
    path: tuple[str, ...]
    elements: tuple[int, ...]
    text: str
    linked: float
    heading: bool
    named: tuple[int, ...] = ()


@dataclass
class _Page:
    stack: list[Element] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    names: dict[int, str] = field(default_factory=dict)
    around_article: set[int] = field(default_factory=set)
    count: int = 0

    def end_block(self) -> None:
        if not self.pieces:
            return
        raw = html.unescape("".join(p for p, _ in self.pieces))
        text = " ".join(raw.split())
        linked = sum(len(p.strip()) for p, link in self.pieces if link)
        self.pieces = []
        open_blocks = [e for e in self.stack if e.name in BLOCK]
        if not text:
            return
        self.blocks.append(
            Block(
                tuple(e.name for e in open_blocks),
                tuple(e.number for e in open_blocks),
                text,
                linked / max(1, len(raw.strip())),
                bool(open_blocks) and open_blocks[-1].name in HEADINGS,
                self.stack[-1].named if self.stack else (),
            )
        )

    def add_text(self, text: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top.dropped:
            return
        if top and top.heading_only and not any(e.name in HEADINGS for e in self.stack):
            return
        self.pieces.append((text, bool(top and top.in_link)))

    def close_down_to(self, index: int) -> None:
        for e in self.stack[index:]:
            if e.name in BLOCK:
                self.end_block()
                break
        del self.stack[index:]

    def open(self, name: str, attributes: str) -> None:
        if name in BLOCK:
            self.end_block()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name == "p":
                    del self.stack[i:]
                    break
                if self.stack[i].name in BLOCK:
                    break
        if name in CLOSES:
            closed, until = CLOSES[name]
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name in closed:
                    self.close_down_to(i)
                    break
                if self.stack[i].name in until:
                    break
        if name == "br":
            self.pieces.append((" ", False))
        if name in VOID:
            return
        parent = self.stack[-1] if self.stack else None
        dropped, heading_only, by_name = self._judge(name, attributes, parent)
        self.count += 1
        named = parent.named if parent else ()
        if by_name and name in BLOCK:
            named += (self.count,)
        elif by_name:
            dropped = True
        if name in ("article", "main") and not dropped:
            self.around_article.update(named)
        self.names[self.count] = name
        self.stack.append(
            Element(name, self.count, parent, dropped, named, heading_only, name == "a" or bool(parent and parent.in_link))
        )

    def _judge(self, name: str, attributes: str, parent: Element | None) -> tuple[bool, bool, bool]:
        """Whether the element is not article text, whether only its headings are, and whether it
        is none by its name."""
        by_name = False
        heading_only = bool(parent and parent.heading_only)
        if parent and parent.dropped or name in DROPPED:
            return True, heading_only, False
        inside = any(e.name in ("article", "main") for e in self.stack)
        if name == "header":
            return not inside, True, False
        if not attributes or name in ("html", "body", "article", "main"):
            return False, heading_only, by_name
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return True, heading_only, False
            if key == "style" and _HIDDEN.search(value) or key == "role" and value.lower() in DROPPED_ROLES:
                return True, heading_only, False
            if key in ("class", "id") and NOT_ARTICLE.search(value):
                if inside and HEADER_ONLY.search(value) and not NOT_ARTICLE.search(HEADER_ONLY.sub(" ", value)):
                    heading_only = True
                    continue
                by_name = name not in HEADINGS
        return False, heading_only, by_name

    def close(self, name: str) -> None:
        if name in BLOCK:
            self.end_block()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name == name:
                self.close_down_to(i)
                return
            # an inline end tag does not reach out of its block
            if name not in BLOCK and self.stack[i].name in BLOCK:
                return


def read_blocks(source: str) -> tuple[list[Block], dict[int, str]]:
    """Text blocks of a page in order, and the names of its elements by number."""
    page, at = _Page(), 0
    while True:
        m = _TAG.search(source, at)
        if m is None:
            break
        if m.start() > at:
            page.add_text(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            page.close(name)
            continue
        page.open(name, m[3])
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(source, at)
            at = end.start() if end else len(source)
    if at < len(source):
        rest = source[at:]
        cut = re.search(r"<[/!?A-Za-z]", rest)  # a tag cut off by the end
        page.add_text(rest[: cut.start()] if cut else rest)
    page.end_block()
    sizes: dict[int, float] = {}
    total = 0.0
    for b in page.blocks:
        size = len(b.text) * (1 - min(1.0, b.linked))
        total += size
        for e in b.named:
            sizes[e] = sizes.get(e, 0.0) + size
    spared = page.around_article
    if not {"article", "main"} & set(page.names.values()):
        spared = spared | {e for e, n in sizes.items() if n >= MOST * total}
    return [b for b in page.blocks if spared.issuperset(b.named)], page.names


def content_paths(blocks: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose smoothed product of length and punctuation ratios is over the threshold."""
    sums: dict[tuple[str, ...], list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += len(b.text) * (1 - min(1.0, b.linked))
        s[1] += len(_PUNCTUATION.findall(b.text))
        s[2] += 1
    fused = np.array([s[0] / s[2] * (0.1 + s[1] / s[2]) for s in (sums[b.path] for b in blocks)])
    kernel = np.exp(-(np.arange(-REACH, REACH + 1) ** 2) / 2.0)
    spread_out = [np.convolve(x, kernel)[REACH : REACH + len(x)] for x in (fused, np.ones(len(fused)))]
    smooth = spread_out[0] / spread_out[1]
    # smoothing lifts neighbours of content, but a path is judged by its own share as well
    value = np.sqrt(smooth * fused)
    by_path: dict[tuple[str, ...], list[float]] = {}
    for b, v in zip(blocks, value, strict=True):
        by_path.setdefault(b.path, []).append(float(v))
    means = {p: sum(v) / len(v) for p, v in by_path.items()}
    spread, top = float(np.std(list(means.values()))), max(means.values())
    return {p for p, v in means.items() if v >= min(spread, top / 2)}


def main_text(source: str) -> str:
    blocks, names = read_blocks(source)
    if not blocks:
        return ""
    chosen = content_paths(blocks)
    held: dict[int, int] = {}
    total = 0
    for b in blocks:
        if b.path in chosen:
            total += len(b.text)
            for e in b.elements:
                held[e] = held.get(e, 0) + len(b.text)
    # elements are numbered as they open, so the deepest of those that hold all is the last
    article = max((e for e, n in held.items() if n == total and names[e] != "p"), default=0)
    around = next((b.elements for b in blocks if article in b.elements), ())
    around = [e for e in around if e <= article and names[e] in ("article", "main")]
    article = around[-1] if around else article
    loose = names.get(article, "body") in ("body", "html")
    first = next((i for i, b in enumerate(blocks) if not article or article in b.elements), 0)
    while first and blocks[first - 1].heading:
        first -= 1
    kept = []
    for i, b in enumerate(blocks):
        inside = not article or article in b.elements
        if inside and (b.path in chosen or b.heading or not loose and b.linked < LINKED):
            kept.append(b.text)
        elif not inside and i >= first and b.heading and article > b.elements[-1]:
            kept.append(b.text)
    return "\n\n".join(kept)


def extract_text(source: Column) -> Column:
    @F.arrow_udf("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for pages in batches:
            yield pa.array([main_text(p.as_py()) for p in pages], pa.string())

    return extract(F.coalesce(source, F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page row.

    Null and empty pages, and pages without content, have an empty text. Unclosed and cut off
    markup is read as far as it goes. Repeated rows repeat their result; other columns are
    ignored.
    """
    found = pages.select("page_id", "url", extract_text(F.col("html")).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
