"""Main text of web pages by tag-path ratios.

A page is read into text nodes, each under its root-to-leaf tag path (tags with
their class and id).  Per path, text length and punctuation are aggregated to
ratios per node; both sequences are smoothed over the page's nodes by a Gaussian,
fused by multiplication and thresholded at a part of their spread.  The nodes above
the threshold are the content.  The text is that of the innermost element that
holds all of them, from the headline before them, less lists of links beside them;
where an ``article`` or ``main`` holds half of them, it is that element's text.

Parts that are never an article by their tag (menus, scripts, styles, hidden parts)
are left out.  Class and id words, roles, ``header`` and ``form`` are hints: such a
part is left out unless it holds over half of the content, so that a wrapper called
``search`` does not empty the page.  A word names what its last telling part says:
``cookie-notice`` is a notice, ``share-price`` and ``has-sidebar`` are none.

Defined cases: a null page, and one without text, give the empty string.  Missing
end tags are implied as in HTML; stray ones are passed over.  ``br`` is white
space inside its block.  Repeated pages give repeated rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)
    |<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|[^>])*+)(?:>|\Z)""", re.S | re.X)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")
WORDLESS = re.compile(r"\s*")

# Element groups of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp noscript template".split())
INLINE = set("""a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small
    span strike strong sub sup time tt u var wbr""".split())
NEVER = set("""head script style noscript template title nav footer aside button select option optgroup textarea input iframe
    object embed svg canvas audio video dialog menu""".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
ENDS_P = set("""address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main
    menu nav ol p pre section table ul""".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}}
ASIDE_NAMES = set("""ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar
    navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar sidebars aside rail cookie cookies consent gdpr
    notice notices notification alert comment comments commentary disqus reply replies respond social share sharing newsletter subscribe
    subscription signup login popup modal overlay related recommended recommendations widget toolbar pagination pager skip copyright
    legal disclaimer teaser search hidden""".split())
COMMENT_NAMES = set("comment comments commentary disqus reply replies respond".split())
NEUTRAL = set("""area bar block body bottom box button col column container content default desktop fixed form group inner item items
    large left link links list main mobile outer panel post posts primary right row secondary section small text title top unit
    wrap wrapper""".split())
MODIFIERS = set("has is no not with without".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
KEEP = {"html", "body", "main"}
PAGE = {"#page", "html", "body"}
LEAVES = set("p li td th dd dt pre blockquote ul ol dl table tbody tr".split())
P_SCOPE = set("button table td th div article section body li blockquote".split())

PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？]")
SMOOTH = np.exp(-0.5 * np.arange(-2, 3) ** 2)
#: Threshold of the fused ratios, as a part of their standard deviation.
SPREAD = 0.25
#: Weight of text inside links.
LINKED = 0.1


def furniture(words: str) -> set[str]:
    """The names of page furniture among class and id words."""
    out = set()
    for word in words.split():
        parts = [x.lower() for x in NAME.findall(word) if len(x) > 1]
        if parts and parts[0] not in MODIFIERS:
            while len(parts) > 1 and parts[-1] in NEUTRAL:
                parts.pop()
            out.add(parts[-1])
    return out & ASIDE_NAMES


class Element:
    """An open or closed element; flags are handed down from its parent ``up``.

    ``never``: left out by tag; ``hint``: left out unless it holds most content;
    ``home``: the outermost article or main element around it."""
    __slots__ = ("tag", "up", "path", "depth", "home", "heading", "link", "headings_only", "never", "hint", "readers",
                 "outside", "container", "content", "marked", "size", "linked", "branch", "inside")

    def __init__(self, tag: str, up: "Element | None", attrs: str):
        self.tag, self.up = tag, up
        self.content = self.marked = self.size = self.linked = 0
        self.depth = up.depth + 1 if up else 0
        self.heading = tag in HEADINGS or bool(up and up.heading)
        self.link = tag == "a" or bool(up and up.link)
        values = {k.lower(): a or b or c for k, a, b, c in ATTR.findall(attrs)} if attrs.strip() else {}
        words = f"{values.get('class') or ''} {values.get('id') or ''}"
        self.path = hash((up.path if up else 0, tag, frozenset(x.lower() for x in NAME.findall(words))))
        hidden = "hidden" in values or (values.get("aria-hidden") or "").lower() == "true" or bool(
            re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", values.get("style") or "", re.I))
        self.never = hidden or tag in NEVER or bool(up and up.never)
        named = furniture(words)
        role = (values.get("role") or "").lower() in ASIDE_ROLES
        header = tag == "header" or named == {"header"}
        # a header inside the article keeps its headings
        inner = bool(up and up.home) and header and not role and not named - {"header"}
        self.headings_only = inner or bool(up and up.headings_only)
        self.hint = not inner and tag not in KEEP and (header or role or bool(named) or tag == "form")
        self.readers = bool(named & COMMENT_NAMES)
        self.home = up.home if up and up.home else self if tag in ("article", "main") and not self.hint else None
        plain = tag in INLINE or tag in LEAVES or self.heading
        self.container = up.container if plain and up else self


def nodes(html: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """All elements, parents first, and (element, text, block number) of every
    text node in page order."""
    top = Element("#page", None, "")
    every, stack, opened, block, out, at = [top], [top], Counter(), 0, [], 0

    def pop_to(n: int) -> None:
        while len(stack) > n:
            opened[stack.pop().tag] -= 1

    def close(tags: set[str], stop: set[str]) -> None:
        """Close the outermost of ``tags`` that is open below any of ``stop``."""
        if any(opened[t] for t in tags):
            found, i = None, len(stack) - 1
            while i > 0 and stack[i].tag not in stop:
                found = i if stack[i].tag in tags else found
                i -= 1
            if found:
                pop_to(found)

    def text(piece: str) -> None:
        if piece:
            out.append((stack[-1], unescape(piece), block))

    while True:
        m = TOKEN.search(html, at)
        if m is None:
            break
        text(html[at: m.start()])
        at = m.end()
        if m["tag"] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        tag, attrs = m["tag"].lower(), m["attrs"] or ""
        if tag not in INLINE:
            block += 1
        elif tag == "br":
            text(" ")
        if m["end"]:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                pop_to(i)
            continue
        if tag in ENDS_P:
            close({"p"}, P_SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, set()))
        if tag in VOID:
            continue
        e = Element(tag, stack[-1], attrs)
        every.append(e)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else len(html)
        else:
            stack.append(e)
            opened[tag] += 1
    text(html[at:])
    return every, out


def content_nodes(texts: list[tuple[Element, str, int]]) -> np.ndarray:
    """Whether each node's fused path ratio is above the page's threshold."""
    size = np.array([len(t) for _, t, _ in texts], float)
    marks = np.array([len(PUNCTUATION.findall(t)) for _, t, _ in texts], float)
    paths: dict[int, int] = {}
    path = np.array([paths.setdefault(e.path, len(paths)) for e, _, _ in texts])
    count = np.bincount(path)
    fused = np.ones(len(texts))
    for ratio in (np.bincount(path, size) / count, 1 + np.bincount(path, marks) / count):
        smooth = np.convolve(ratio[path], SMOOTH / SMOOTH.sum(), "full")[2: 2 + len(path)]
        fused *= np.sqrt(smooth * ratio[path])
    fused[[e.link for e, _, _ in texts]] *= LINKED
    return fused >= min(SPREAD * fused.std(), fused.max())


def weigh(every: list[Element], found: list[tuple[Element, str, int]]) -> list[int]:
    """Places of the content nodes; every element gets its characters of content,
    of content in article or main elements, of text and of linked text."""
    for e in every:
        e.content = e.marked = e.size = e.linked = 0
    solid = [i for i, x in enumerate(found) if not WORDLESS.fullmatch(x[1])]
    above = content_nodes([found[i] for i in solid]) if solid else []
    chosen = [i for i, ok in zip(solid, above) if ok]
    for i in solid:
        e, n = found[i][0], len(found[i][1])
        e.size += n
        e.linked += n * e.link
    for i in chosen:
        e, n = found[i][0], len(found[i][1])
        e.content += n
        e.marked += n * (e.home is not None)
    for e in reversed(every):
        if e.up is not None:
            e.up.content += e.content
            e.up.marked += e.marked
            e.up.size += e.size
            e.up.linked += e.linked
    return chosen


def path_tags(e: Element) -> list[str]:
    """Tags from a node's element up to its heading."""
    out = []
    while e is not None and e.heading:
        out.append(e.tag)
        e = e.up
    return out


def mark_inside(every: list[Element], roots: set[Element]) -> None:
    for e in every:
        e.inside = e in roots or e.up is not None and e.up.inside


def main_text(html: str | None) -> str:
    every, found = nodes(html or "")
    found = [x for x in found if not x[0].never and (x[0].heading or not x[0].headings_only)]
    weigh(every, found)
    page = every[0]
    for e in every:
        most = 2 * e.content > page.content and not e.readers and (not page.marked or e.marked > 0)
        e.outside = e.hint and not most or e.up is not None and e.up.outside
    found = [x for x in found if not x[0].outside]
    chosen = weigh(every, found)
    if not chosen:
        return ""
    kept = {found[i][2] for i in chosen}  # blocks that hold content stay whole
    if 2 * page.marked >= page.content:
        homes = [e for e in every if e.home is e and e.marked]
        best = max(homes, key=lambda e: e.marked)
        mark_inside(every, {e for e in homes if e.path == best.path})
        keep = [x for x in found if x[0].inside]
    else:
        core = max((e for e in every if e.content == page.content and e.container is e), key=lambda e: e.depth)
        loose = core.tag in PAGE or all(found[i][0].container is not core for i in chosen)
        for e in every:  # the highest element without content that an element lies in
            e.branch = None if e.content else e if e.up is None or e.up.content else e.up.branch
        mark_inside(every, {core})

        def links(e: Element) -> bool:
            return loose and e.branch is not None and 2 * e.branch.linked > e.branch.size and e.branch.up is not None and (
                e.branch.up is core or e.branch.up.tag in PAGE)

        keep = [x for x in found if x[0].inside and (x[2] in kept or not links(x[0]))]
        if not any(x[0].heading for x in keep):
            first = next(i for i, x in enumerate(found) if x[0].inside)
            heads = [i for i in range(first) if found[i][0].heading and not found[i][0].link]
            if heads:
                start = next((i for i in heads if "h1" in path_tags(found[i][0])), heads[-1])
                keep = [x for x in found[start:first] if not x[0].link] + keep
    blocks: dict[int, list[str]] = {}
    for e, t, b in keep:
        blocks.setdefault(b, []).append(t)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column("html")]
        keep = [c for c in batch.schema.names if c != "html"]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(texts, pa.string())], names=[*keep, "main_text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text (empty if none) and n_chars of every page."""
    return (pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
            .mapInArrow(_extract, "page_id long, url string, main_text string")
            .select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars")))
