"""HTML to Markdown.

A tree builder over the standard tokenizer, by the published rules for bodies of pages: void elements, implied end tags, raw
text, formatting elements that are opened again in the next block, misnested formatting mended by adoption, and content of
tables outside of their cells put before the table. Not built: templates, frames, foreign elements, select and the page's
head beyond its title. The Markdown is then written by one walk over the tree.
Null gives null; text outside any element is kept.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import HTML_BLOCKS, HTML_SKIPPED

# Fixed values of HTML: elements without content, formatting elements, and elements whose start ends an open paragraph.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul li dt dd".split())
SCOPES = set("table td th caption html template button object".split())
TABLE_PARTS = set("table thead tbody tfoot tr".split())
#: Elements that lead the stack back to a place in the table, and the places it goes back to.
BACK_TO = {"caption": {"table"}, "colgroup": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "tr": {"table", "thead", "tbody", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
MARKERS = set("td th caption object button".split())
_SKIPPED, _BLOCKS = set(HTML_SKIPPED), set(HTML_BLOCKS)
_STRUCTURE = _BLOCKS | set("table ul ol h1 h2 h3 h4 h5 h6 pre".split())
_SPECIAL = _STRUCTURE | CLOSES_P | TABLE_PARTS | VOID | SCOPES | set("body head style script title iframe select textarea noscript".split())


class Node:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: dict[str, str | None] | None = None):
        self.name, self.attrs, self.children, self.parent = name, attrs or {}, [], None

    def put(self, child: Node | str, before: Node | None = None) -> None:
        """Make ``child`` a child of this node, out of where it was; at the end or before another child."""
        if isinstance(child, Node):
            if child.parent is not None:
                child.parent.children = [x for x in child.parent.children if x is not child]
            child.parent = self
        at = next((k for k, x in enumerate(self.children) if x is before), len(self.children)) if before is not None else len(self.children)
        self.children.insert(at, child)

    def copy(self) -> Node:
        return Node(self.name, self.attrs)


class Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        #: Formatting elements started and not ended, in order; None where a cell or the like began.
        self.formatting: list[Node | None] = []
        self.title: str | None = None

    def _in_scope(self, names: set[str], stop: set[str]) -> Node | None:
        for n in reversed(self.open[1:]):
            if n.name in names:
                return n
            if n.name in stop:
                return None
        return None

    def _pop(self, name: str, stop: set[str]) -> bool:
        found = self._in_scope({name}, stop)
        if found is None:
            return False
        del self.open[self.open.index(found) :]
        if name in MARKERS:
            while self.formatting and self.formatting.pop() is not None:
                pass
        return True

    def _insert(self, child: Node | str, at: Node | None = None) -> None:
        """Below the open element, or before its table if that can hold nothing but rows and cells."""
        here = at or self.open[-1]
        loose = isinstance(child, Node) and child.name not in TABLE_PARTS and child.name not in BACK_TO and child.name not in ("col", "script", "style") or isinstance(child, str) and bool(child.strip())
        if here.name in TABLE_PARTS and loose:
            table = next((n for n in reversed(self.open) if n.name == "table"), None)
            if table is not None and table.parent is not None:
                table.parent.put(child, before=table)
                return
        here.put(child)

    def _reopen(self) -> None:
        """Open again what was formatting before the last block ended, from the first that isn't open."""
        start = len(self.formatting)
        while start and (f := self.formatting[start - 1]) is not None and f not in self.open:
            start -= 1
        for k in range(start, len(self.formatting)):
            copy = self.formatting[k].copy()
            self._insert(copy)
            self.open.append(copy)
            self.formatting[k] = copy

    def _adopt(self, name: str) -> None:
        """The end of a formatting element: blocks that began within it keep its format and move out of it."""
        for _ in range(8):
            since = next((k for k in range(len(self.formatting) - 1, -1, -1) if self.formatting[k] is None), -1)
            own = next((f for f in reversed(self.formatting[since + 1 :]) if f.name == name), None)
            if own is None:
                self._end_other(name)
                return
            if own not in self.open:
                self.formatting = [f for f in self.formatting if f is not own]
                return
            at = self.open.index(own)
            if any(n.name in SCOPES for n in self.open[at + 1 :]):
                return
            block = next((n for n in self.open[at + 1 :] if n.name in _SPECIAL), None)
            if block is None:
                del self.open[at:]
                self.formatting = [f for f in self.formatting if f is not own]
                return
            above, mark = self.open[at - 1], self.formatting.index(own)
            last, k = block, self.open.index(block)
            for count, n in enumerate(reversed(self.open[at + 1 : k])):  # what lies between, from the block upwards
                if n not in self.formatting or count > 2:
                    self.formatting = [f for f in self.formatting if f is not n]
                    mark = min(mark, len(self.formatting))
                    self.open.remove(n)
                    continue
                copy = n.copy()
                place = self.formatting.index(n)
                self.formatting[place] = self.open[self.open.index(n)] = copy
                if last is block:
                    mark = place + 1
                copy.put(last)
                last = copy
            self._insert(last, above)
            copy = own.copy()
            for child in list(block.children):
                copy.put(child)
            block.children = []
            block.put(copy)
            before = self.formatting.index(own)
            self.formatting.insert(mark, copy)
            del self.formatting[before if before < mark else before + 1]
            self.open.remove(own)
            self.open.insert(self.open.index(block) + 1, copy)

    def _end_other(self, name: str) -> None:
        for n in reversed(self.open[1:]):
            if n.name == name:
                del self.open[self.open.index(n) :]
                return
            if n.name in _SPECIAL:
                return

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return
        if tag in BACK_TO and (table := self._in_scope({"table"}, SCOPES - {"table", "td", "th", "caption"})) is not None:
            # Cells and rows end what is open in the table; nothing loose stays open between them.
            low = self.open.index(table)
            while len(self.open) - 1 > low and self.open[-1].name not in BACK_TO[tag]:
                if self.open.pop().name in MARKERS:
                    while self.formatting and self.formatting.pop() is not None:
                        pass
        if tag in CLOSES_P:
            self._pop("p", SCOPES)
        if tag == "li":
            self._pop("li", SCOPES | {"ul", "ol"})
        elif tag in ("dt", "dd"):
            self._pop("dt", SCOPES | {"dl"}) or self._pop("dd", SCOPES | {"dl"})
        elif tag == "option":
            self._pop("option", {"select"})
        if tag == "a" and any(f is not None and f.name == "a" for f in self.formatting):
            self._adopt("a")
            self.formatting = [f for f in self.formatting if f is None or f.name != "a"]
        if tag not in CLOSES_P and tag not in BACK_TO and tag not in ("table", "head", "title", "script", "style"):
            self._reopen()
        node = Node(tag, dict(attrs))
        self._insert(node)
        if tag in VOID:
            return
        self.open.append(node)
        if tag in MARKERS:
            self.formatting.append(None)
        if tag in FORMATTING:
            alike = [f for f in self.formatting if f is not None and (f.name, f.attrs) == (tag, node.attrs)]
            if len(alike) > 2:  # of more than three equal ones the first is forgotten
                self.formatting = [f for f in self.formatting if f is not alike[0]]
            self.formatting.append(node)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in FORMATTING:
            self._adopt(tag)
        elif tag == "br":
            self.handle_starttag("br", [])
        elif tag == "p" and self._in_scope({"p"}, SCOPES) is None:
            self._insert(Node("p"))
        elif tag in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"):
            self._pop(tag, {"table"} - {tag})
        elif tag in _SPECIAL and tag not in VOID:
            self._pop(tag, SCOPES - {tag})
        elif tag not in ("html", "body") and tag not in VOID:
            self._end_other(tag)

    def handle_data(self, data: str) -> None:
        here = self.open[-1].name
        if here == "title" and self.title is None:
            self.title = data
        if data.strip() and here not in ("script", "style", "title", "head"):
            self._reopen()
        self._insert(data)


def _collapse(s: str) -> str:
    return " ".join(s.split())


def _text(n: Node) -> str:
    return "".join(c if isinstance(c, str) else _text(c) for c in n.children)


def _marked(inner: str, mark: str) -> str:
    t = _collapse(inner)
    if not t:
        return " " if inner else ""
    return (" " if inner[0].isspace() else "") + mark + t + mark + (" " if inner[-1].isspace() else "")


MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "code": "`", "kbd": "`", "samp": "`"}


def _inline(n: Node) -> str:
    out = []
    for c in n.children:
        if isinstance(c, str):
            out.append(c)
        elif c.name in _SKIPPED or c.name == "img":
            continue
        elif c.name == "br":
            out.append("\n")
        elif c.name in MARKS:
            out.append(_marked(_inline(c), MARKS[c.name]))
        elif c.name == "a":
            t, href = _collapse(_inline(c)), c.attrs.get("href") or ""
            out.append(f"[{t}]({href})" if t and href.startswith("http") else t)
        else:
            out.append(_inline(c))
    return "".join(out)


def _blocks(n: Node, out: list[str]) -> None:
    pending: list[str] = []

    def flush() -> None:
        rows = [r for r in map(_collapse, "".join(pending).split("\n")) if r]
        if rows:
            out.append("  \n".join(rows))
        pending.clear()

    for c in n.children:
        if isinstance(c, str):
            pending.append(c)
        elif c.name in _SKIPPED:
            continue
        elif c.name == "br":
            pending.append("\n")
        elif re.fullmatch("h[1-6]", c.name):
            flush()
            if t := _collapse(_inline(c)):
                out.append("#" * int(c.name[1]) + " " + t)
        elif c.name in ("ul", "ol"):
            flush()
            out.append(_list(c, 0))
        elif c.name == "table":
            flush()
            out.append(_table(c))
        elif c.name == "pre":
            flush()
            out.append("```\n" + _text(c).rstrip() + "\n```")
        elif c.name == "blockquote":
            flush()
            inner: list[str] = []
            _blocks(c, inner)
            out.append("\n".join("> " + x for x in "\n\n".join(inner).splitlines()))
        elif c.name == "hr":
            flush()
            out.append("---")
        elif c.name in _BLOCKS or c.name == "li" or any(not isinstance(g, str) and g.name in _STRUCTURE for g in c.children):
            flush()
            _blocks(c, out)
        else:
            # Links and code that stand directly in a block keep their text only.
            mark = MARKS.get(c.name) if c.name in ("strong", "b", "em", "i") else None
            pending.append(_marked(_inline(c), mark) if mark else _inline(c))
    flush()


def _list(n: Node, depth: int) -> str:
    rows, number = [], 0
    for item in n.children:
        if isinstance(item, str) or item.name != "li":
            continue
        number += 1
        text, nested = [], []
        for c in item.children:
            if isinstance(c, str):
                text.append(c)
            elif c.name in ("ul", "ol"):
                nested.append(_list(c, depth + 1))
            elif c.name not in _SKIPPED:
                text.append(_inline(c))
        rows.append("  " * depth + (f"{number}." if n.name == "ol" else "-") + " " + _collapse("".join(text)))
        rows += nested
    return "\n".join(rows)


def _rows(n: Node):
    for c in n.children:
        if isinstance(c, str):
            continue
        if c.name in ("thead", "tbody", "tfoot"):
            yield from _rows(c)
        elif c.name == "tr":
            cells, heads = [], []
            for d in c.children:
                if not isinstance(d, str) and d.name in ("td", "th"):
                    span = d.attrs.get("colspan") or "1"
                    width = min(max(int(span) if span.isdigit() else 1, 1), 20)
                    cells += [_collapse(_inline(d)).replace("|", "\\|"), *[""] * (width - 1)]
                    heads.append(d.name == "th")
            if cells:
                yield all(heads), cells


def _table(n: Node) -> str:
    rows = list(_rows(n))
    if not rows:
        return ""
    width = max(len(cells) for _, cells in rows)
    write = lambda cells: "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"
    head, body = (rows[0][1], rows[1:]) if rows[0][0] else ([], rows)
    return "\n".join([write(head), "|" + "|".join(["---"] * width) + "|", *(write(cells) for _, cells in body)])


def html_to_markdown(html: str) -> tuple[str, str | None]:
    """(Markdown, title or None)."""
    tree = Tree()
    tree.feed(html)
    tree.close()
    out: list[str] = []
    _blocks(tree.root, out)
    return "\n\n".join(b.strip() for b in out if b.strip()), _collapse(tree.title or "") or None


@F.arrow_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType())]))
def _convert(pages: pa.Array) -> pa.Array:
    rows = [(None, None) if x is None else html_to_markdown(x) for x in pages.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["markdown", "title"])


def to_markdown(html: Column) -> Column:
    """Struct ``markdown, title``."""
    return _convert(html)
