"""The content region of an HTML page."""

from __future__ import annotations

import html
import re
import weakref
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tags, selectors and names that tell content from chrome (fixed values).
NEVER_CONTENT = ("script", "style", "noscript", "template", "svg", "iframe")
CHROME_TAGS = ("nav", "header", "footer", "aside", "form", "button", "select")
CHROME_NAMES = re.compile(r"(^|[-_ ])(nav|navbar|navigation|menu|topbar|header|footer|sidebar|aside|cookie|consent|gdpr|banner|breadcrumbs?|social|share|newsletter|subscribe|popup|modal|offcanvas|skip-link|pagination|widget)([-_ ]|$)", re.IGNORECASE)
FALLBACKS = ("main", "[role=main]", "article", "#content", "#main")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_STEP = re.compile(r"([a-zA-Z][a-zA-Z0-9-]*)?((?:[#.][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\])*)")
_BIT = re.compile(r"[#.][\w-]+|\[[\w-]+(?:=[\"']?[^\]\"']*[\"']?)?\]")


#: What a node is; a page is rendered up to one of these.
CONTENT, CHROME, NEVER = range(3)


class Node:
    __slots__ = ("tag", "attrs", "_parent", "children", "kind", "__weakref__")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        # Parents are not held by their children, so that a page's tree goes as soon as the page is done.
        self._parent = None if parent is None else weakref.ref(parent)
        self.tag, self.attrs, self.children = tag, attrs, []
        self.kind = NEVER if tag in NEVER_CONTENT else CHROME if tag in CHROME_TAGS else CONTENT

    @property
    def parent(self) -> Node | None:
        return self._parent and self._parent()

    def walk(self):
        """Nodes below this one in the order of the page, without those that never are content."""
        for c in self.children:
            if isinstance(c, Node) and c.kind != NEVER:
                yield c
                yield from c.walk()

    def names(self) -> str | None:
        return f"{self.attrs.get('class', '')} {self.attrs.get('id', '')}" if {"class", "id"} & self.attrs.keys() else None

    def rendered(self, upto: int) -> tuple[str, str]:
        """HTML and text of this node and of those below it that are of the kind ``upto`` or nearer to content."""
        marked, plain = [], []
        for c in self.children:
            if isinstance(c, str):
                marked.append(html.escape(c, quote=False))
                plain.append(c)
            elif c.kind <= upto:
                for out, part in zip((marked, plain), c.rendered(upto), strict=True):
                    out.append(part)
        inner = "".join(marked)
        if self.tag:
            head = "".join(f' {k}="{html.escape(v)}"' for k, v in self.attrs.items())
            inner = f"<{self.tag}{head}>" + ("" if self.tag in _VOID else f"{inner}</{self.tag}>")
        return inner, "".join(plain)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def _fits(node: Node, tag: str | None, bits: list[str]) -> bool:
    if tag and node.tag != tag.lower():
        return False
    for bit in bits:
        if bit[0] == "#":
            ok = node.attrs.get("id") == bit[1:]
        elif bit[0] == ".":
            ok = bit[1:] in node.attrs.get("class", "").split()
        else:
            name, eq, value = bit.strip("[]").partition("=")
            ok = name in node.attrs and (not eq or node.attrs[name] == value.strip("\"'"))
        if not ok:
            return False
    return True


def first_match(root: Node, selectors: str) -> Node | None:
    """First node of the first selector that has one: tag, #id, .class, [attr=value] and descendants of those."""
    for selector in filter(None, map(str.strip, selectors.split(","))):
        steps = [_STEP.fullmatch(s) for s in selector.split()]
        if not steps or not all(steps):
            continue
        steps = [(m[1], _BIT.findall(m[2])) for m in steps]
        for node in root.walk():
            if not _fits(node, *steps[-1]):
                continue
            above, left = node.parent, len(steps) - 1
            while above is not None and left:
                left -= _fits(above, *steps[left - 1])
                above = above.parent
            if not left:
                return node
    return None


def region(page: str, selector: str = "", strip_chrome: bool = True) -> str:
    """HTML of one page's content.

    Nodes are marked as content, chrome or neither, and the region is rendered from the marks with and without chrome; where
    hardly any text is left without it, the chrome was none.  Names count as marks only where no region was found.
    """
    if not page.strip():
        return page
    tree = _Tree()
    tree.feed(page)
    tree.close()
    body = next((n for n in tree.root.walk() if n.tag == "body"), tree.root)
    scope = first_match(body, selector or ",".join(FALLBACKS))
    if scope is None:
        scope = body
        for node in body.walk():
            if CHROME_NAMES.search(node.names() or ""):
                node.kind = CHROME
    full, full_text = scope.rendered(CHROME)
    if not strip_chrome:
        return full
    lean, lean_text = scope.rendered(CONTENT)
    had, left = (len(" ".join(t.split())) for t in (full_text, lean_text))
    return lean if not had or left >= max(40, 0.02 * had) else full


def html_region(page: Column, selector: str = "", strip_chrome: bool = True) -> Column:
    @F.arrow_udf("string")
    def run(s: pa.Array) -> pa.Array:
        # A few pages at a time as Python strings.
        parts = (s.slice(i, 64) for i in range(0, len(s), 64))
        done = [pa.array([None if t is None else region(t, selector, strip_chrome) for t in part.to_pylist()], pa.string()) for part in parts]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return run(page)
