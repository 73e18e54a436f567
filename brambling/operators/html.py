"""HTML extraction: one pass of the standard library's parser over each page.

The document tree lives only inside a Python worker; text blocks, links and meta data
leave it as arrays, in document order. Pages of any depth, broken markup and broken urls
give rows like all others; a null page has no body.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brambling import config
from brambling.functions import text as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag that ends an open one of the second set.
CLOSES = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCHEMA = (
    "url string, no_html boolean, has_body boolean, title string, description string, keywords string, blocks array<string>, full_text string, "
    "links array<struct<pos: int, href: string, hreflang: string>>"
)


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        """Nodes and texts below, in document order."""
        stack = list(reversed(self.children))
        while stack:
            x = stack.pop()
            yield x
            if isinstance(x, Node):
                stack.extend(reversed(x.children))

    def all(self, tag: str):
        return [x for x in self.walk() if isinstance(x, Node) and x.tag == tag]


class Text:
    """Text of a node, in the pieces that the parser gives."""

    __slots__ = ("pieces", "parent")

    def __init__(self, text: str, parent: Node):
        self.pieces, self.parent = [text], parent

    @property
    def text(self) -> str:
        if len(self.pieces) > 1:
            self.pieces = ["".join(self.pieces)]
        return self.pieces[0]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def open_tags(self):
        x = self.at
        while x is not None:
            yield x
            x = x.parent

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
        for x in self.open_tags():
            if x.tag in ends:
                self.at = x.parent
                break
            if x.tag in ("table", "ul", "ol", "div", "article", "body", "main"):
                break
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        for x in self.open_tags():
            if x.tag == tag:
                self.at = x.parent
                break

    def handle_data(self, data):
        if self.at.children and isinstance(self.at.children[-1], Text):
            self.at.children[-1].pieces.append(data)
        else:
            self.at.children.append(Text(data, self.at))


REFERENCE = re.compile("&([#0-9A-Za-z]+;)?")


def only_references(html: str, names: tuple[str, ...]) -> str:
    """The page with the references of these names alone; any other & stands for itself."""
    return REFERENCE.sub(lambda m: m[0] if m[1] in names else "&amp;" + (m[1] or ""), html)


def parse(html: str) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def _without(node: Node, tags) -> None:
    stack = [node]
    while stack:
        at = stack.pop()
        at.children = [x for x in at.children if not (isinstance(x, Node) and x.tag in tags)]
        stack += [x for x in at.children if isinstance(x, Node)]


def host_of(url: str | None) -> str:
    """What stands between // and the next /, ? or #; broken urls have one too."""
    found = re.match(r"(?:[^:/?#]+:)?//([^/?#]*)", url or "")
    return found[1] if found else ""


def _is(node, wanted) -> bool:
    tag, key, value = wanted
    return isinstance(node, Node) and node.tag == tag and (node.attrs.get(key) == value)


def site_node(body: Node, host: str) -> Node | None:
    """A known site's main node, without its edit links and closing sections."""
    main = next((x for x in body.walk() if _is(x, config.SITE_NODES[host])), None)
    if main is None:
        return None
    for node in [x for x in main.walk() if any(_is(x, s) for s in config.SITE_SPANS)]:
        node.parent.children.remove(node)
    for section in config.SITE_SECTIONS:
        if node := next((x for x in main.walk() if _is(x, section)), None):
            node.parent.children.remove(node)
    return main


def containers(body: Node, fallback: tuple[str, ...]) -> list[Node]:
    """divs below the first <main>, and those whose class or id says content or main; in
    document order; else the first node of a fallback tag."""
    main = next(iter(body.all("main")), None)
    wanted = set(map(id, main.all("div"))) if main else set()
    out = [
        d for d in body.all("div")
        if id(d) in wanted or any(t in (d.attrs.get(k) or "").lower() for k in ("class", "id") for t in config.CONTAINER_TERMS)
    ]
    return out or next(([n] for tag in fallback if (n := next(iter(body.all(tag)), None))), [])


def text_blocks(divs: list[Node]) -> list[str]:
    """Texts whose nearest parent, decoration apart, is a text tag; each once a container."""
    seen, out = set(), []
    for div in divs:
        if id(div) in seen:
            continue
        found: dict[str, None] = {}
        for x in div.walk():
            if isinstance(x, Node):
                if x.tag == "div":
                    seen.add(id(x))
                continue
            parent = x.parent
            while parent is not div and parent.tag in config.DECORATION_TAGS:
                parent = parent.parent
            t = x.text.strip()
            if len(t) > 1 and parent.tag in config.BLOCK_TAGS and "cookie" not in t.lower():
                found[t] = None
        out += found
    return out


def page_row(url: str, html: str, fallback: tuple[str, ...], references: tuple[str, ...] | None = None) -> tuple:
    root = parse(html if references is None else only_references(html or "", references))
    title = next((n for n in root.all("title")), None)
    meta = {(n.attrs.get("name") or "").lower(): (n.attrs.get("content") or "").strip() for n in reversed(root.all("meta"))}
    head = ("".join(t.text for t in title.walk() if isinstance(t, Text)).strip() if title else "", meta.get("description", ""), meta.get("keywords", ""))
    body = next(iter(root.all("body")), None)
    if body is None:
        return (url, not html, False, *head, [], "", [])
    _without(body, config.DROPPED_TAGS)
    full = " ".join(x.text for x in body.walk() if isinstance(x, Text))
    host = host_of(url)
    if host in config.SITE_NODES:
        main = site_node(body, host)
        divs, body = ([main, *main.all("div")] if main else []), (main or body)
    else:
        divs = containers(body, fallback)
    links = [{"pos": i, "href": a.attrs["href"], "hreflang": a.attrs.get("hreflang", "")} for i, a in enumerate(body.all("a")) if "href" in a.attrs]
    return (url, False, True, *head, text_blocks(divs), full, links)


def extract(pages: DataFrame, fallback: tuple[str, ...] = ("article", "body"), url_col: str = "url", html_col: str = "html", references: tuple[str, ...] | None = None) -> DataFrame:
    """url, no_html, has_body, title, description, keywords, blocks (cleaned), full_text, links.
    ``references``: those that are read (``("amp;",)``), others stay as they stand; by default
    all that a browser reads, the old names without their semicolon too."""

    def run(batches):
        kinds = [pa.string(), pa.bool_(), pa.bool_(), *[pa.string()] * 3, pa.list_(pa.string()), pa.string(),
                 pa.list_(pa.struct([("pos", pa.int32()), ("href", pa.string()), ("hreflang", pa.string())]))]
        names = ["url", "no_html", "has_body", "title", "description", "keywords", "blocks", "full_text", "links"]
        for batch in batches:
            rows = [page_row(u, h, fallback, references) for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 9, kinds)], names)

    out = pages.select(F.col(url_col), F.col(html_col)).mapInArrow(run, SCHEMA)
    return out.withColumn("blocks", F.array_distinct(F.transform("blocks", T.clean_text)))


def links_of(extracted: DataFrame) -> DataFrame:
    return extracted.select(F.col("url").alias("page_url"), F.inline("links"))


def blocks_of(extracted: DataFrame) -> DataFrame:
    return extracted.select("url", F.posexplode("blocks").alias("pos", "block"))
