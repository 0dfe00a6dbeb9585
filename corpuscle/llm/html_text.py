"""Main text of web pages by composite text density.

A tolerant reader builds a tree of block elements; inline elements only count as tags of the block they stand in. Elements end where the
published rules of HTML end them: an end tag closes all that is open inside of its element, and a quote that is never closed is no quote. Left out from the
start is only what the markup itself says is no article: scripts, styles, menus, forms, headers and footers of the page, asides, dialogs, hidden
elements, and roles of these kinds.

Everything else is for the density to decide. For each block the characters for each tag, adjusted for links, give its composite density. A block whose class
or id holds a word of DOUBTED_WORDS counts only DOUBT of its density, and so do the blocks in it; it isn't left out for its name. The block
with the largest sum of its children's densities is taken, and beside the path from it to the body every subtree whose density
reaches the lowest on that path. Inside of the taken block all is kept but doubted blocks below that threshold. Texts that stand directly in a block of the
path are kept as well; only those outside an article or main element that the path passes must reach the threshold by themselves.

Defined cases: null and empty html give an empty text; a page cut off anywhere is read as far as it goes; text outside any
block belongs to the body; of equal sums the outer, then the earlier block is taken; repeated pages are treated alike; an
empty table gives no rows; further columns pass through, but for one named main_text, which is replaced.
"""

from __future__ import annotations

import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attached, bounded_batches, frugal, read, without

#: Comments, declarations and tags; a quote counts only after an equals sign and if it is closed.
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements and roles that by their own meaning are no article.
LEFT_OUT = set("head nav footer aside form button select option input dialog menu template svg canvas object audio video map script style noscript iframe textarea title".split())
LEFT_OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that make a block doubtful, and what is left of its density then.
DOUBTED_WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu breadcrumb breadcrumbs footer masthead comment comments respond replies cookie cookies consent notice popup modal overlay newsletter subscribe signup login share sharing social related recommended widget toolbar pagination pager".split()
)
DOUBT = 0.1
#: An open element of the first kind ends where one of the second begins.
CLOSES_P = set("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDERS = {"ul", "ol", "dl", "table", "select", "menu"}


class Block:
    __slots__ = ("name", "doubted", "prior", "parts", "children", "chars", "tags", "link_chars", "link_tags", "density", "sum")

    def __init__(self, name: str, prior: float = 1.0, doubted: bool = False):
        self.name, self.doubted, self.parts, self.children = name, doubted, [], []
        self.prior = prior * DOUBT if doubted and prior == 1.0 else prior
        self.chars = self.link_chars = 0
        self.tags, self.link_tags = 1, 0
        self.density = self.sum = 0.0


def _told(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is left out, and whether its class or id makes it doubtful."""
    if name in LEFT_OUT or name == "header" and not in_article:
        return True, False
    doubted = False
    if "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True, False
            if key == "role" and value.lower() in LEFT_OUT_ROLES:
                return True, False
            if key in ("class", "id") and any(w.lower() in DOUBTED_WORDS for w in _NAME_PART.findall(value)):
                doubted = name not in ("article", "main")
    return False, doubted


class _Reader:
    """Open elements, from the body inwards: name, the block they belong to, and whether their content is left out."""

    def __init__(self):
        self.root = Block("body")
        self.open: list[tuple[str, Block, bool]] = [("body", self.root, False)]
        self.links = self.articles = 0

    def text(self, s: str) -> None:
        _, block, left_out = self.open[-1]
        if not s or left_out:
            return
        s = html.unescape(s) if "&" in s else s
        block.parts.append(s)
        size = len("".join(s.split()))
        block.chars += size
        if self.links:
            block.link_chars += size

    def close(self, k: int) -> None:
        for name, _, left_out in self.open[k:]:
            if not left_out:
                self.links -= name == "a"
                self.articles -= name in ("article", "main")
        del self.open[k:]

    def end(self, name: str) -> None:
        """An end tag closes the nearest element of its name with all inside of it; that of an inline element doesn't leave the block."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k][0] == name:
                return self.close(k)
            if name in INLINE and self.open[k][0] not in INLINE:
                return None
        return None

    def implied(self, name: str) -> None:
        """Ends that the beginning of this element implies."""
        if name in CLOSES_P:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] == "p":
                    return self.close(k)
                if self.open[k][0] not in INLINE:
                    return None
        elif name in SAME_LEVEL:
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k][0] in HOLDERS:
                    return None
                if self.open[k][0] in SAME_LEVEL[name]:
                    return self.close(k)
        return None

    def begin(self, name: str, attributes: str) -> None:
        if name in ("html", "body"):
            return
        _, block, left_out = self.open[-1]
        if name in VOID:
            if not left_out:
                block.tags += 1
                if name in ("br", "hr"):
                    block.parts.append(None)
            return
        self.implied(name)
        _, block, left_out = self.open[-1]
        gone, doubted = (True, False) if left_out else _told(name, attributes, self.articles > 0)
        # only an element of another namespace can close itself
        if attributes.endswith("/") and (gone or name not in CLOSES_P | INLINE):
            if not gone and "-" not in name:
                block.tags += 1
            return
        if not gone:
            if name in INLINE or "-" in name:
                block.tags += 1
                if name == "a":
                    self.links += 1
                    block.link_tags += 1
            else:
                child = Block(name, block.prior, doubted)
                block.children.append(child)
                block.parts.append(child)
                block = child
                self.articles += name in ("article", "main")
        self.open.append((name, block, gone))


def parse(page: str) -> Block:
    """The tree of blocks that may hold the article; each block's parts are texts, blocks and None for a line break."""
    reader = _Reader()
    pos, n = 0, len(page)
    while pos < n:
        m = _TAG.search(page, pos)
        if not m:
            reader.text(page[pos:])
            break
        reader.text(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            reader.end(name)
        elif name in RAW:
            pos = _after_raw(page, pos, name)
        else:
            reader.begin(name, m[3])
    return reader.root


def _after_raw(page: str, pos: int, name: str) -> int:
    m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
    return m.end() if m else len(page)


def _nodes(root: Block) -> list[Block]:
    """Blocks, each before those in it."""
    out = [root]
    for b in out:
        out.extend(b.children)
    return out


def _density(chars: int, tags: int, link_chars: int, link_tags: int, ratio: float) -> float:
    """Characters for each tag, adjusted for links: the more of the text and of the tags are links, the less it counts. The base of the logarithm grows
    with the text, the more so the more links the page has, and is e to the e at least, so that short texts aren't favoured."""
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + ratio * chars + math.e**math.e)
    inner = chars / max(link_chars, 1) * tags / max(link_tags, 1)
    return chars / tags * math.log(max(inner, 1.0)) / math.log(base)


def _own_density(b: Block, ratio: float) -> float:
    """The density of the texts that stand directly in a weighed block."""
    chars, tags, link_chars, link_tags = (getattr(b, k) - sum(getattr(c, k) for c in b.children) for k in ("chars", "tags", "link_chars", "link_tags"))
    return _density(chars, tags, link_chars, link_tags, ratio) if chars else 0.0


def weigh(root: Block) -> None:
    """Composite density of each block, and the sum over its children of what counts of theirs."""
    nodes = _nodes(root)
    for b in reversed(nodes):
        for c in b.children:
            b.chars += c.chars
            b.tags += c.tags
            b.link_chars += c.link_chars
            b.link_tags += c.link_tags
    ratio = root.link_chars / root.chars if root.chars else 0.0
    for b in nodes:
        if b.chars:
            b.density = _density(b.chars, b.tags, b.link_chars, b.link_tags, ratio)
    for b in nodes:
        b.sum = sum(c.density * c.prior for c in b.children)


def everything(root: Block) -> str:
    """All that the reader kept, without any selection."""
    return _joined(root, lambda b: True, lambda b: True)


def _joined(root: Block, kept, own_text) -> str:
    """Texts in page order, a blank between blocks: of blocks that are kept, and in these the direct texts where they are."""
    out: list[str] = []
    todo: list = [(root, True)]
    while todo:
        x, direct = todo.pop()
        if x is None:
            out.append(" ")
        elif isinstance(x, str):
            if direct:
                out.append(x)
        elif kept(x):
            direct = own_text(x)
            todo.append((None, True))
            todo.extend((y, direct) for y in reversed(x.parts))
            todo.append((None, True))
        else:
            out.append(" ")
    return " ".join("".join(out).split())


def main_text(page: str | None) -> str:
    """The article of a page."""
    if not page:
        return ""
    root = parse(page)
    weigh(root)
    best, parent = root, {id(root): None}
    todo = [root]
    while todo:  # in page order, so that the outer and earlier block of equal sums stays
        b = todo.pop()
        if b.sum > best.sum:
            best = b
        for c in reversed(b.children):
            parent[id(c)] = b
            todo.append(c)
    path: list[Block] = [best]
    while parent[id(path[-1])] is not None:
        path.append(parent[id(path[-1])])
    threshold = min(b.density for b in path)
    # path goes outwards: its outermost article or main and what lies in it
    inside = max((k for k, b in enumerate(path) if b.name in ("article", "main")), default=len(path))
    ratio = root.link_chars / root.chars if root.chars else 0.0
    on_path = {id(b): k == 0 or k <= inside or _own_density(b, ratio) >= threshold for k, b in enumerate(path)}
    chosen = best.prior
    safe: set[int] = set()  # blocks of the best subtree, and of subtrees beside the path that are dense enough

    def kept(b: Block) -> bool:
        if id(b) in on_path:
            return True
        up = id(parent[id(b)])
        if up in safe or up == id(best):
            good = not b.doubted or b.density * b.prior / chosen >= threshold
        else:
            good = b.density * b.prior / chosen >= threshold
        if good:
            safe.add(id(b))
        return good

    return _joined(root, kept, lambda b: on_path.get(id(b), True))


def extract_text(pages: DataFrame) -> DataFrame:
    """pages with main_text."""
    bounded_batches(pages.sparkSession)
    pages = without(pages, "main_text")

    def run(batches):
        for b in batches:
            texts = pa.array([main_text(x) for x in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "main_text"])

    return pages.mapInArrow(frugal(run), attached(pages, [("main_text", T.StringType())]))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


SQL: dict[str, str] = {}
QUERIES = {"op8_html": op8_html}
