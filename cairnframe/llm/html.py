"""HTML extraction by tag-path ratios.

A page is read as text nodes, each with its root-to-leaf tag path (tags with their classes). Scripts, styles, forms and what is hidden have no
text. For each path the node count, text length, punctuation and link text are aggregated. Its ratio is text length per node, its
punctuation ratio marks per node; both are smoothed with Gaussian weights over the paths in page order and fused as their geometric mean times the
share of text outside links, and paths at or over `threshold` times the mean (weighted by length and prior) are content.

Names are a prior: each navigation, aside, header or footer element, and each whose class, id or role names it a menu, advert, notice, comments
and the like, multiplies the scores of the paths below it by AGAINST, and so does lying outside the article or main part where a page has one.

The content root is the deepest element that holds all content nodes; where it lies in an article it is that article, since titles
and short paragraphs belong to it. Every node under the root with as good a prior as the content has is article text, save link-only
paths and children without content nodes that aren't headings where the root is the whole body. Reading takes time in proportion to the page.

Blocks are what block elements and <br> delimit. Character references are decoded; white space inside a block becomes one space.

Defined results: a null or empty html gives an empty text; so does a page without text; broken markup is read as browsers mostly do
(unclosed elements close with their parents); repeated rows are separate rows; other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, mapped, slices

TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>?|[^<]++|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
PUNCTUATION = re.compile(r"[,.;:!?。，、；：！？]")

# Elements by how they read.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
SPACED = {"td", "th"}
NO_TEXT = {"head", "form", "button", "select", "dialog", "object", "svg", "math", "canvas", "audio", "video", "datalist", *RAW}
UNLIKELY = {"nav", "footer", "aside", "menu"}
CLOSES_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure", "details"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = {"article", "aside", "body", "div", "dl", "form", "html", "main", "nav", "ol", "section", "table", "ul", "td", "th", "blockquote", "button", "header", "footer", "figure"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Words of a class, id or role that name what isn't the article.
NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "disclaimer", "disqus", "feedback", "footer", "form", "gdpr", "login", "masthead", "menu", "menubar", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "register",
    "related", "replies", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget", "hidden",
}

#: What each piece of evidence against a path does to its score; the count that stands for no text at all.
AGAINST, NONE = 1e-4, 99


def attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): references.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip(" /") else {}


def judged(tag: str, own: dict[str, str], in_article: bool) -> int:
    """What an element adds to the evidence against its text: 0, 1, or NONE where it has no text to show."""
    if tag in NO_TEXT or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", ""):
        return NONE
    if tag in UNLIKELY or tag == "header" and not in_article:
        return 1
    if tag in ("html", "body", "article", "main") and not own.get("role"):
        return int(tag == "article" and bool(NAMES & {"comment", "comments"} & words_of(own)))
    named = words_of(own)
    return int(bool(NAMES & named) or "header" in named and not in_article and tag in ("div", "section"))


def words_of(own: dict[str, str]) -> set[str]:
    return {w.lower() for k in ("class", "id", "role") if k in own for w in CAMEL.findall(own[k])}


class Page:
    """Text nodes in page order: (element, block, text). Elements: (parent, tag, path, evidence against); parents come first."""

    def __init__(self, source: str):
        self.elements: list[tuple[int, str, int, int]] = [(-1, "", 0, 0)]
        self.paths: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        elements, paths, nodes = self.elements, self.paths, self.nodes
        stack, block, at = [0], 0, 0
        # Positions on the stack, in order: of each tag, and of the elements that stop a search for an element to close.
        of: dict[str, list[int]] = {}
        blocks: list[int] = []  # not inline
        holders: list[int] = []  # HOLDS
        bodies: list[int] = []  # HOLDS but cells

        def pop(to: int) -> None:
            for e in stack[to:]:
                of[elements[e][1]].pop()
            del stack[to:]
            for held in (blocks, holders, bodies):
                while held and held[-1] >= to:
                    held.pop()

        top = lambda held: held[-1] if held else 0
        n = len(source)
        while at < n:
            m = TOKEN.match(source, at)
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                if (source[m.start()] != "<" or at == m.start() + 1) and elements[stack[-1]][3] < NONE:
                    nodes.append((stack[-1], block, m[0]))
                continue
            tag, closing = tag.lower(), bool(m[1] or m[4])
            if tag not in INLINE and tag not in RAW:
                block += 1
                if tag in SPACED:
                    block -= 1
                    nodes.append((stack[-1], block, " "))
            if closing:
                k = top(of.get(tag))
                stop = top(blocks) if tag in INLINE else top(holders) if tag in ("p", "li") else 0
                if k and stop <= k:
                    pop(k)
                continue
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                k = top(of.get("p"))
                if k and top(holders) < k:
                    pop(k)
            while tag in CLOSED_BY:
                k = max(top(of.get(x)) for x in CLOSED_BY[tag])
                if not k or top(bodies) > k:
                    break
                other = elements[stack[k]][1]
                pop(k)
                if tag != "tr" or other == "tr":
                    break
            own = attributes(m[3] or m[6] or "")
            parent = elements[stack[-1]]
            found = judged(tag, own, bool(of.get("article") or of.get("main")))
            label = (f"{tag}.{own['class']}" if own.get("class") else tag) + "!" * min(found, 2)
            path = paths.setdefault((parent[2], label), len(paths) + 1)
            elements.append((stack[-1], tag, path, min(NONE, parent[3] + found)))
            if tag in RAW:
                end = re.compile(f"</{re.escape(tag)}(?=[\\s/>]|$)", re.I).search(source, at)
                at = end.start() if end else n
            if (m[3] or m[6] or "").rstrip().endswith("/") and parent[1] in ("svg", "math"):
                continue
            k = len(stack)
            stack.append(len(elements) - 1)
            of.setdefault(tag, []).append(k)
            if tag not in INLINE:
                blocks.append(k)
            if tag in HOLDS:
                holders.append(k)
                if tag not in ("td", "th"):
                    bodies.append(k)


def smooth(values: list[float], reach: int = 1, sigma: float = 0.5) -> list[float]:
    """Gaussian means; sigma is narrow, since a page has few paths and a story must not lift its neighbours over the threshold."""
    weights = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        near = [(weights[k + reach], values[i + k]) for k in range(-reach, reach + 1) if 0 <= i + k < len(values)]
        out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
    return out


def content_paths(measured: dict[int, list[float]], threshold: float) -> set[int]:
    """measured: path -> [nodes, text length, punctuation, link text, prior], in page order."""
    length = smooth([v[1] / v[0] for v in measured.values()])
    marks = smooth([(v[2] + 0.1) / v[0] for v in measured.values()])
    fused = [math.sqrt(a * b) * (1 - v[3] / v[1]) * v[4] for a, b, v in zip(length, marks, measured.values())]
    total = sum(v[1] * v[4] for v in measured.values())
    mean = sum(f * v[1] * v[4] for f, v in zip(fused, measured.values())) / total
    return {p for p, f in zip(measured, fused) if f > 0 and f >= threshold * mean}


def extract(source: str | None, threshold: float = 0.25) -> str:
    """The article text of one page."""
    page = Page(source or "")
    elements = page.elements
    kept = [(e, block, references.unescape(text)) for e, block, text in page.nodes]
    texts = [(e, len(" ".join(text.split())), text) for e, _, text in kept if not text.isspace() and text]
    if not texts:
        return ""
    # Of each element: whether it is in a link, and the outermost article or main that it is in.
    linked, article = [False] * len(elements), [-1] * len(elements)
    for e, (parent, tag, _, _) in enumerate(elements):
        if parent >= 0:
            linked[e] = linked[parent] or tag == "a"
            article[e] = article[parent] if article[parent] >= 0 else e if tag in ("article", "main") else -1
    scopes = {article[e] for e, _, _ in texts if article[e] >= 0 and elements[e][3] == 0}
    against = lambda e: elements[e][3] + (bool(scopes) and article[e] not in scopes)
    measured: dict[int, list[float]] = {}
    for e, size, text in texts:
        v = measured.setdefault(elements[e][2], [0, 0, 0, 0, AGAINST ** against(e)])
        v[0] += 1
        v[1] += size
        v[2] += len(PUNCTUATION.findall(text))
        v[3] += size if linked[e] else 0
    best = max(v[4] for v in measured.values())
    chosen = content_paths(measured, threshold) or {p for p, v in measured.items() if v[4] == best}
    content = [e for e, _, _ in texts if elements[e][2] in chosen]
    worst = max(map(against, content))
    held = [0] * len(elements)
    for e in content:
        held[e] += 1
    for e in range(len(elements) - 1, 0, -1):
        held[elements[e][0]] += held[e]
    root = max(e for e, n in enumerate(held) if n == len(content))  # parents come first: the deepest
    if article[root] >= 0:
        root = article[root]
    else:
        while elements[root][1] in INLINE or elements[root][1] in ("p", "li", "ul", "ol", "blockquote", *HEADINGS):
            root = elements[root][0]
    whole = elements[root][1] in ("", "html", "body")
    below = [-1] * len(elements)  # the root's child that holds an element; 0: the root itself, -1: outside
    for e, (parent, _, _, _) in enumerate(elements):
        below[e] = 0 if e == root else -1 if parent < 0 else e if parent == root else below[parent]
    holders = {elements[below[e]][2] for e in content if below[e] > 0}
    blocks: dict[int, list[str]] = {}
    for e, block, text in kept:
        c, path = below[e], elements[e][2]
        if c < 0 or against(e) > worst:
            continue
        if whole and c and elements[c][2] not in holders and elements[c][1] not in HEADINGS:
            continue
        v = measured.get(path)
        if whole and v and v[3] == v[1] and path not in chosen:
            continue
        blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(x for x in lines if x)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def extract_pages(pages: DataFrame, threshold: float = 0.25) -> DataFrame:
    """page_id, url, text and n_chars for every row of pages (page_id, url, html)."""

    def run(batches):
        for b in slices(batches, text="html"):
            texts = [extract(h, threshold).encode("utf-8", "replace").decode() for h in b.column(2).to_pylist()]
            yield batch(EXTRACTED, page_id=b.column(0), url=b.column(1), text=texts, n_chars=list(map(len, texts)))

    return mapped(pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html"), run, "page_id long, url string, text string, n_chars long")
