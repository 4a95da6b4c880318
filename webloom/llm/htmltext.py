"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import few_texts, table

#: Elements without an end tag, elements whose content is not markup, and what ends an open element by starting.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe noframes noembed object svg canvas audio video textarea title select".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An end tag or an implied end reaches up to one of these, not beyond.
SCOPE = frozenset("html body table td th article section main div ul ol dl aside nav header footer form".split())
#: Elements that are never main text, and words of class, id and role that say so of small elements.
OUTSIDE = frozenset("nav aside footer form button dialog menu".split())
_OUTSIDE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|breadcrumbs?|header|masthead|footer|sidebar|side|aside|widget|ads?|adverts?|advertisement|banner|promo|sponsor(?:ed)?|"
    r"cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|disqus|complementary|contentinfo|search)(?=[\s_-]|$)",
    re.I,
)
_COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus)(?=[\s_-]|$)", re.I)
#: Names that speak of another element: with-sidebar, comments-enabled.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:(?:with|without|has|no|show|hide|is)[_-]\S+|\S+[_-](?:enabled|disabled|open|closed|on|off|results|visible))(?=\s|$)", re.I)
_ALLOWED = re.compile(r"(?:^|\s)(?:article|post|content|main)(?:[\s_-]|$)", re.I)
_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|$)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "parent", "parts", "out", "soft", "core", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, out: bool, soft: str = ""):
        self.tag, self.parent, self.out, self.soft = tag, parent, out, soft
        self.parts: list[Node | str] = []
        if parent is not None:
            parent.parts.append(self)


def _outside(tag: str, attributes: str, in_article: bool) -> tuple[bool, str]:
    """Whether an element is outside the main text by what it is, and what its attributes call it if that says so too."""
    if tag in OUTSIDE or tag in RAW or tag == "head" or tag == "header" and not in_article:  # an article's header holds its heading
        return True, ""
    if attributes and tag not in ("html", "body", "article", "main"):
        for m in _ATTR.finditer(attributes):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                return True, ""
            if name in ("class", "id", "role"):
                named = value if name == "role" else _ABOUT.sub("", value)
                if _OUTSIDE.search(named) and not (name != "role" and _ALLOWED.search(named)):
                    return False, "comments" if _COMMENTS.search(named) else "named"
    elif attributes and tag == "article" and _COMMENTS.search(" ".join(m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(attributes))):
        return False, "comments"
    return False, ""


def parse(page: str) -> Node:
    """The tree of a page, with implied and missing end tags put in. Text of elements that hold no markup is left out.

    The open elements are also kept by tag, so that no end tag has to look for its element.
    """
    root = Node("html", None, False)
    chain: list[Node] = [root]
    opened: dict[str, list[int]] = {"html": [0]}
    scopes: list[int] = [0]
    at, low = 0, None

    def close(to: int) -> None:
        while len(chain) > max(1, to):
            tag = chain.pop().tag
            opened[tag].pop()
            if tag in SCOPE:
                scopes.pop()

    def reach(tag: str, anywhere: bool) -> int:
        """Where the last open element of a tag is that an end can reach, or 0."""
        last = opened.get(tag)
        return last[-1] if last and (anywhere or last[-1] >= scopes[-1]) else 0

    while True:
        m = _TAG.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            chain[-1].parts.append(text)
        if not m:
            return root
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if tag in ("html", "body"):
            if tag == "body" and not m[1]:
                close(1)
            continue
        if m[1]:
            if up := reach(tag, tag in BLOCK):
                close(up)
            elif tag == "p":
                Node("p", chain[-1], False)
            continue
        for end in {*CLOSES.get(tag, ()), *(("p",) if tag in BLOCK else ())}:
            if up := reach(end, False):
                close(up)
        if tag in HEADINGS and chain[-1].tag in HEADINGS:
            close(len(chain) - 1)
        here = chain[-1]
        if tag in RAW:
            low = page.lower() if low is None else low
            end = low.find(f"</{tag}", at)
            Node(tag, here, True)
            if end < 0:
                if tag in ("script", "style", "title", "textarea"):
                    return root
                continue
            at = page.find(">", end) + 1 or len(page)
            continue
        out, soft = _outside(tag, m[3], bool(opened.get("article")))
        node = Node(tag, here, here.out or out, soft)
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            opened.setdefault(tag, []).append(len(chain))
            if tag in SCOPE:
                scopes.append(len(chain))
            chain.append(node)


def _leave_out(root: Node) -> None:
    """Puts elements outside that are called so, unless they hold the main text.

    One that holds the page's main element stays in; so does, if it is not called comments, one that holds an article or half
    of the text.
    """
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars, n.core = 0, 2 if n.tag == "main" else int(n.tag == "article" and not n.soft)
        for p in n.parts:
            if isinstance(p, str):
                n.chars += len(p.strip())
            elif not p.out:
                n.chars += p.chars
                n.core = max(n.core, p.core)
    for n in nodes:
        if n.soft and n.core < 2 and (n.soft == "comments" or not n.core and 2 * n.chars < root.chars):
            n.out = True


def _order(root: Node) -> list[Node]:
    """All nodes but those outside the main text, each before its children; no recursion, so depth does not matter."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(p for p in node.parts if isinstance(p, Node) and not p.out)
    return found


def _running(part: Node | str) -> bool:
    """Whether a part is running text, or none of the text at all: not mostly links."""
    return isinstance(part, str) or part.out or 2 * part.link_chars <= part.chars


def measure(root: Node) -> list[Node]:
    """All nodes but those outside the main text, each with its characters, tags, those of links, and composite text density."""
    nodes = _order(root)
    for n in reversed(nodes):
        n.chars = n.tags = n.link_chars = n.link_tags = 0
        for p in n.parts:
            if isinstance(p, str):
                n.chars += len(p.strip())
            elif not p.out:
                n.chars += p.chars
                n.tags += p.tags + (p.tag not in VOID)
                n.link_chars += p.link_chars
                n.link_tags += p.link_tags + (p.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    whole = max(1, root.chars)
    share = root.link_chars / whole
    for n in nodes:
        c, t, lc, lt = n.chars, max(1, n.tags), n.link_chars, n.link_tags
        base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        n.density = c / t * math.log(c / max(1, lc) * (t / max(1, lt)) + 1) / math.log(max(base, 1.0001) + 1) if c else 0.0
    return nodes


def main_text(page: str) -> str:
    """The main text of a page: its blocks in page order, joined by newlines.

    Every node gets the composite text density of its characters per tag, which falls with the share of characters and
    tags that are links (Sun, Song and Liao, 2011). The densities of a node's children are summed, and the node with
    the greatest sum is the core. The main text is all of the article around the core, else of the main element, else of
    the core, and of every element around that whose other parts are running text too. The least density on the path
    from there up to the body is the threshold: other children of those ancestors that reach it join the main text.
    Elements outside the main text stay out wherever they are.
    """
    root = parse(page)
    _leave_out(root)
    nodes = measure(root)
    best, most = root, -1.0
    for n in nodes:
        n.total = sum(p.density for p in n.parts if not isinstance(p, str) and not p.out) + n.density * any(isinstance(p, str) and p.strip() for p in n.parts)
        if n.total > most and n.tag not in ("a",):
            best, most = n, n.total
    while best.parent is not None and best.tag not in BLOCK:
        best = best.parent
    named = best
    up = best.parent
    while up is not None:
        if up.tag == "article" or up.tag == "main" and named.tag != "article":
            named = up
        up = up.parent
    best = named
    while best.parent is not None and all(_running(p) for p in best.parent.parts if p is not best):
        best = best.parent
    threshold, up = best.density, best
    while up.parent is not None:
        up = up.parent
        threshold = min(threshold, up.density)
    kept: set[int] = {id(best)}
    side, up = best, best.parent
    while up is not None:
        for p in up.parts:
            if isinstance(p, str) or p.out or p is side:
                continue
            if p.chars > p.link_chars and p.density >= threshold or p.tag in HEADINGS and side.tag not in HEADINGS:
                kept.add(id(p))
        side, up = up, up.parent
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        if text := _SPACE.sub(" ", html.unescape("".join(line))).strip():
            blocks.append(text)
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            if inside:
                line.append(item)
        elif item.out:
            if item.tag not in ("button", "svg", "select"):
                end()
        elif item.tag == "br":
            line.append(" ")
        else:
            inside = inside or id(item) in kept
            if item.tag in BLOCK:
                end()
                stack.append((None, False))
            stack.extend((p, inside) for p in reversed(item.parts))
    end()
    return "\n".join(blocks)


def with_main_text(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) as page_id, url, text (the main text), n_chars (its code points).

    Null, empty and textless pages give an empty text. Pages are read whole, one by one, without a shuffle; repeated
    rows keep their number; nulls in other columns stay; an empty table gives an empty result; other columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_texts(batches, "html"):
            texts = [main_text(t.as_py() or "") for t in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    cols = ("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.select(*cols).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op9_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_main_text(table(spark, sf_dir, "pages"))
