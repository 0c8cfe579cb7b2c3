"""Main text of web pages by tag-path ratios.

A page becomes a sequence of text nodes, each with its tag path from the root (tags with their classes). For each path
the text length (what stands in links counts LINKED of it) and the punctuation are summed over its nodes and divided by
their number. Both ratios are smoothed along the page, a neighbour counting the less the fewer elements it shares, and
fused by multiplying them. The fused ratios add up in the elements: from the body the content root is found by going
down to the child that holds SHARE of its element's sum, as far as there is one that isn't a block of running text.

A path's score is its fused ratio over the mean of the content root, a quarter of it for each element by which it stands
outside; what stands inside has 1 instead, or 0 in a list of links. Elements of the root's own tag path (told by a class,
or sections and articles), and a first heading right before it, belong to it. Nodes whose score reaches 1 are content: so
headings, short paragraphs and tables of the content element stay, and long paragraphs elsewhere do too.

What the tag or a whole name in class, id or role marks as boilerplate (menus, footers, adverts, comments, forms, scripts)
takes no part at all; a name counts if all its words, cut at hyphens and underscores, are boilerplate words.

Results at the edges: a null or empty html gives an empty text and 0 characters; a page without any content path, too;
a null page_id or url is kept; repeated rows are read each on their own; of elements that hold equal sums the first on
the page is taken; an empty table gives no rows; further columns are ignored; broken markup is read as far as it goes (a
tag without end is text-free to the end of the page); very long pages are read whole.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|(<)", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
# Fixed values of HTML: elements whose content is no markup, without end tag, inline, and those that end an open <p>.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
CLOSES_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("table ul ol dl select body html article section div main".split())
#: Elements that are no article text wherever they stand.
NO_TEXT = frozenset("head script style noscript template nav footer aside form button select option iframe svg canvas object audio video menu dialog textarea title math xmp noembed noframes".split())
#: Words of names in class, id or role that say the same, alone or with each other, and words that may stand beside them.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter"
    " subscribe subscription signup share sharing sidebar widget widgets menu menubar nav navbar navigation breadcrumb breadcrumbs pagination pager comment comments"
    " commentlist disqus replies respond footer masthead topbar toolbar popup modal overlay paywall login complementary contentinfo disclaimer related".split()
)
BESIDE = frozenset("site page main top bottom left right box block area list item items wrapper wrap container section bar buttons links social post posts form message slot inner outer primary secondary global header the".split())
SITE_HEADER = frozenset("header".split())
#: Blocks of running text, into which the content root doesn't go down, nor below an article; and the parts of tables.
RUNNING = frozenset("p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption caption address details summary hgroup article".split())
TABLE = frozenset("table thead tbody tfoot tr".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
#: What a character in a link counts, the share of its element's sum that a content root holds, and what is left of a
#: ratio for each element by which two nodes, or a node and the content root, are apart.
LINKED, SHARE, APART = 0.05, 0.6, 0.25


class Node:
    """A run of text in one block: its elements (numbered from the root), tag path and text."""

    __slots__ = ("chain", "tags", "path", "text", "linked", "plain")

    def __init__(self, chain, tags, path, text, linked, plain):
        self.chain, self.tags, self.path, self.text, self.linked, self.plain = chain, tags, path, text, linked, plain


def text_nodes(page: str) -> list[Node]:
    """The blocks of text of a page, in page order; a block ends at each block element's begin or end and at <br>."""
    stack: list[tuple[str, int, bool, str]] = [("", 0, True, "")]  # tag, number, whether its text may be content, label
    out: list[Node] = []
    parts: list[str] = []
    links = [0, 0]  # characters in this block, and of them in links
    number = at = 0

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                blocks = [s for s in stack if s[0] not in INLINE]
                out.append(Node(tuple(s[1] for s in blocks), tuple(s[0] for s in blocks), "/".join(s[3] for s in blocks), text, links[1] / max(1, links[0]), stack[-1][2]))
            parts, links = [], [0, 0]

    def say(raw: str) -> None:
        if raw:
            text = references.unescape(raw)
            parts.append(text)
            links[0] += len(text)
            if any(s[0] == "a" for s in stack):
                links[1] += len(text)

    def pop_to(k: int) -> None:
        if any(s[0] not in INLINE for s in stack[k:]):
            flush()
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m[4]:  # a "<" that begins no tag is text
            continue
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    pop_to(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] not in INLINE:
                    break
        elif tag in CLOSES_OWN:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES_OWN[tag]:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        if tag == "body":
            while len(stack) > 1 and stack[-1][0] == "head":
                pop_to(len(stack) - 1)
        if tag in VOID:
            if tag in ("br", "hr"):
                flush()
            continue
        if tag not in INLINE:
            flush()
        number += 1
        names = _names(m[3]) if m[3] else ()
        label = ".".join([tag, *sorted(v for n, v in names if n == "class")]) if names else tag
        stack.append((tag, number, stack[-1][2] and _may_be_content(tag, names, stack), label))
        if m[3].rstrip().endswith("/") and tag in ("svg", "path", "use"):
            stack.pop()
        elif tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            stack.pop()
    say(page[at:])
    flush()
    return out


def _names(attributes: str) -> list[tuple[str, str]]:
    """The words of class, id and role, and what hides an element."""
    out = []
    for a in ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if name in ("class", "id", "role"):
            out += [(name, v) for v in value.split()]
        elif name == "aria-hidden" and value == "true":
            out.append(("hidden", ""))
    if re.search(r"(?:^|\s)hidden(?:\s|=|$)", attributes):
        out.append(("hidden", ""))
    return out


def _may_be_content(tag: str, names: list[tuple[str, str]], stack: list) -> bool:
    if tag in NO_TEXT:
        return False
    inside = any(s[0] in ("article", "main") for s in stack)
    if tag == "header":
        return inside
    if tag not in ("html", "body", "article", "main"):
        for kind, value in names:
            words = re.split(r"[-_]+|\d+$", value)
            words = {w for w in words if w}
            if kind == "hidden" or words & BOILERPLATE and words <= BOILERPLATE | BESIDE or not inside and words & SITE_HEADER and words <= SITE_HEADER | BESIDE:
                return False
    return True


def common(a: tuple, b: tuple) -> int:
    """How many elements two chains share."""
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def smooth(x: np.ndarray, nodes: list[Node]) -> np.ndarray:
    """A Gaussian over five neighbours, less for those that are apart."""
    up, down = np.zeros(len(x)), np.zeros(len(x))
    for d in range(-2, 3):
        near = np.exp(-0.5 * d * d)
        for i in range(max(0, -d), min(len(x), len(x) - d)):
            w = near if not d else near * APART ** max(0, max(len(nodes[i].chain), len(nodes[i + d].chain)) - 1 - common(nodes[i].chain, nodes[i + d].chain))
            up[i] += w * x[i + d]
            down[i] += w
    return up / down


def path_ratios(nodes: list[Node]) -> np.ndarray:
    """The fused ratio of each node's path."""
    paths = {p: k for k, p in enumerate(dict.fromkeys(n.path for n in nodes))}
    of = np.array([paths[n.path] for n in nodes])
    count = np.bincount(of)
    length = np.bincount(of, [len(n.text) * (1 - (1 - LINKED) * n.linked) for n in nodes]) / count
    marks = np.bincount(of, [len(PUNCTUATION.findall(n.text)) + 0.5 for n in nodes]) / count
    fused = smooth(length[of], nodes) * smooth(marks[of], nodes)
    return (np.bincount(of, fused) / count)[of]


def content_root(nodes: list[Node], ratios: np.ndarray) -> tuple:
    """The elements from the root to the one that holds the content."""
    tags = {e: t for n in nodes for e, t in zip(n.chain, n.tags, strict=True)}
    left, chain = np.arange(len(nodes)), (0,)
    while tags[chain[-1]] != "article":
        sums: dict[int, float] = {}
        for i in left:
            if len(nodes[i].chain) > len(chain):
                e = nodes[i].chain[len(chain)]
                sums[e] = sums.get(e, 0.0) + ratios[i]
        best = max(sums, key=sums.get, default=None)
        if best is None or sums[best] < SHARE * ratios[left].sum() or tags[best] in RUNNING - {"article"}:
            break
        inner = np.array([i for i in left if nodes[i].chain[: len(chain) + 1] == (*chain, best)])
        if tags[best] in ("td", "th") and all(len(nodes[i].chain) == len(chain) + 1 for i in inner):
            break  # a cell of data, not of layout
        chain, left = (*chain, best), inner
    while tags[chain[-1]] in TABLE:
        chain = chain[:-1]
    return chain


def path_scores(nodes: list[Node]) -> np.ndarray:
    """The score of each node; those from 1 on are content."""
    ratios = path_ratios(nodes)
    chain = content_root(nodes, ratios)
    apart = np.array([len(chain) - common(n.chain, chain) for n in nodes])
    first = int(np.argmin(apart))
    labels = nodes[first].path.split("/")[: len(chain)]
    if "." in labels[-1] or labels[-1] in ("section", "article"):
        # Elements of the same tag path belong together.
        apart[[n.path.split("/")[: len(chain)] == labels for n in nodes]] = 0
    if first and "h1" in nodes[first - 1].tags and not any("h1" in n.tags for n, a in zip(nodes, apart, strict=True) if not a):
        apart[first - 1] = 0  # the title right before it
    inside = apart == 0
    # A list of links: all items of one list, or all nodes of one path, none with running text.
    lists: dict = {}
    for i, n in enumerate(nodes):
        k = next((k for k in range(len(n.tags) - 1, 0, -1) if n.tags[k] in ("ul", "ol", "dl", "table")), None)
        lists.setdefault(n.chain[: k + 1] if k else n.path, []).append(i)
    links = np.zeros(len(nodes))
    for group in lists.values():
        if len(group) > 2:
            total = sum(len(nodes[i].text) for i in group)
            links[group] = sum(len(nodes[i].text) * nodes[i].linked for i in group) / total > 0.9
    mean = max(1e-9, float(ratios[inside].mean()))
    return ratios / mean * APART**apart * (apart > 0) + inside * (1 - links)


def main_text(page: str) -> str:
    nodes = [n for n in text_nodes(page) if n.plain]
    if not nodes:
        return ""
    return " ".join(n.text for n, s in zip(nodes, path_scores(nodes), strict=True) if s >= 1)


def extract(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html) to page_id, url, text, n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 500) for k in range(0, whole.num_rows, 500)):
                texts = [main_text(h or "") for h in b.column(2).to_pylist()]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
