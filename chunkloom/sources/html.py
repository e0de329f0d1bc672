"""HTML to blocks: tags by one regular expression, and the implied end tags of the elements that matter here."""

from __future__ import annotations

import re
from collections import defaultdict
from html import unescape

from ..model import Block
from .plain import require_utf8, strip

_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Opening one of the first closes an open one of the second, unless one of the third is in between.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tr", "td", "th"}, {"table"})}
_SCOPE = set("table td th caption button html object template marquee applet".split())


class Node:
    __slots__ = ("tag", "children")

    def __init__(self, tag: str):
        self.tag, self.children = tag, []

    def text(self) -> str:
        own = self.children
        if len(own) == 1 and isinstance(own[0], str):
            return own[0]
        out, stack = [], own[::-1]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(x.children[::-1])
        return "".join(out)

    def walk(self) -> list[Node]:
        """Descendants in document order."""
        out, stack = [], self.children[::-1]
        while stack:
            x = stack.pop()
            if not isinstance(x, str):
                out.append(x)
                stack.extend(x.children[::-1])
        return out

    def all(self, *tags: str) -> list[Node]:
        """Descendants with one of the tags, in document order."""
        return [x for x in self.walk() if x.tag in tags]


#: Comments, declarations, and tags; a quote counts only after an equals sign, so that a stray one doesn't swallow the rest.
_TAG = re.compile(r"""<!--(?:>|->|.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>""", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style")}


class Tree:
    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]

    def feed(self, html: str) -> None:
        at = 0
        while True:
            m = _TAG.search(html, at)
            if at < (end := m.start() if m else len(html)):
                text = html[at:end]
                self.open[-1].children.append(unescape(text) if "&" in text else text)
            if m is None:
                return
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self.handle_endtag(tag)
                continue
            self.handle_starttag(tag)
            if tag in _RAW:  # no tags are in it
                stop = _RAW[tag].search(html, at)
                end = stop.start() if stop else len(html)
                if at < end:
                    self.open[-1].children.append(html[at:end])
                at = end

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in stop:
                return
            if self.open[i].tag in tags:
                del self.open[i:]
                return

    def handle_starttag(self, tag: str) -> None:
        if tag in _ENDS_P:
            self._close({"p"}, _SCOPE)
        if tag in _CLOSES:
            tags, stop = _CLOSES[tag]
            while any(n.tag in tags for n in self.open[1:]):
                size = len(self.open)
                self._close(tags, stop)
                if len(self.open) == size:
                    break
        node = Node(tag)
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if tag == "p" and not any(n.tag == "p" for n in self.open[1:]):
            self.handle_starttag("p")
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                return


def parse_tree(html: str) -> Node:
    tree = Tree()
    tree.feed(html)
    return tree.root


def _table(node: Node) -> Block:
    headers, rows = None, []
    for tr in node.all("tr"):
        heads = [strip(x.text()) for x in tr.all("th")]
        if heads and headers is None:
            headers = heads
            continue
        cells = [strip(x.text()) for x in tr.all("td")]
        if cells:
            rows.append(cells)
    wide = len(headers) if headers is not None else (len(rows[0]) if rows else 0)
    return Block("table", f"Table: {wide} columns, {len(rows)} rows", rows=rows, headers=headers)


_KINDS = [(("title",), "title"), *(((f"h{n}",), "title") for n in range(1, 7)), (("p",), "narrative_text"), (("li",), "list_item"), (("table",), "table"), (("pre", "code"), "code_block")]


def parse_html(content: bytes, document_order: bool = False) -> list[Block]:
    """Blocks by kind: title, headings by level, paragraphs, list items, tables, code; or in the document's order."""
    root = parse_tree(require_utf8(content))
    by: dict[str, list[tuple[int, Node]]] = defaultdict(list)
    for i, node in enumerate(root.walk()):
        by[node.tag].append((i, node))
    found: list[tuple[int, Block]] = []
    for tags, kind in _KINDS:
        for i, node in by[tags[0]] if len(tags) == 1 else sorted((x for t in tags for x in by[t]), key=lambda x: x[0]):
            if kind == "table":
                found.append((i, _table(node)))
            elif text := strip(node.text()):
                found.append((i, Block(kind, text, confidence=0.95, hierarchy=[node.tag] if node.tag[0] == "h" else [])))
    if document_order:
        found.sort(key=lambda x: x[0])
    if not found:
        body = by["body"][0][1] if by["body"] else root
        text = strip(body.text())
        return [Block("narrative_text", text, confidence=0.95)] if text else []
    return [b for _, b in found]
