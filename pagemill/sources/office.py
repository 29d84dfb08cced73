"""Office files as Markdown: Word, OpenDocument, slides, e-books, sheets and CSV are zip archives of XML, or text.

Files of the older binary formats need an external reader and give null, and so does what cannot be read; a file whose
parts would unpack to more than ``MOST_BYTES`` is refused the same way.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import html_to_markdown

MOST_BYTES = 512 << 20


class _Archive:
    def __init__(self, raw: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(raw))
        self.names = self.zip.namelist()
        if sum(x.file_size for x in self.zip.infolist()) > MOST_BYTES:
            raise ValueError("too large")

    def xml(self, name: str) -> ET.Element:
        return ET.fromstring(self.zip.read(name))

    def numbered(self, pattern: str) -> list[str]:
        """Members that match, by the number in their name."""
        found = [(int(m[1]), n) for n in self.names if (m := re.fullmatch(pattern, n))]
        return [n for _, n in sorted(found)]


def _tag(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _get(e: ET.Element, name: str) -> str | None:
    """An attribute, whatever its name space."""
    return next((v for k, v in e.attrib.items() if k.rsplit("}", 1)[-1] == name), None)


def _first(e: ET.Element, *path: str) -> ET.Element | None:
    for name in path:
        e = next((x for x in e if _tag(x) == name), None)
        if e is None:
            return None
    return e


def table(rows: list[list[str]]) -> str:
    """A Markdown table whose first row is the header; short rows are filled up."""
    width = max(map(len, rows), default=0)
    if not width:
        return ""
    cell = lambda x: " ".join(x.split()).replace("|", "\\|")
    lines = ["| " + " | ".join([*map(cell, r), *[""] * (width - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "|" + "---|" * width, *lines[1:]])


def _join(blocks: list[tuple[str, str]]) -> str:
    """Blocks ``(kind, text)`` with blank lines between, items of a list without."""
    out = ""
    for k, (kind, text) in enumerate(blocks):
        out += ("" if not k else "\n" if kind == blocks[k - 1][0] == "item" else "\n\n") + text
    return out


def _word_runs(p: ET.Element) -> str:
    out = []
    for e in p.iter():
        if _tag(e) == "t":
            out.append(e.text or "")
        elif _tag(e) in ("tab", "br", "cr"):
            out.append("\t" if _tag(e) == "tab" else "\n")
    return "".join(out).strip()


def _word_blocks(body: ET.Element) -> Iterator[tuple[str, str]]:
    for e in body:
        if _tag(e) == "tbl":
            yield "table", table([[" ".join(_word_runs(p) for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "tc"] for r in e if _tag(r) == "tr"])
        elif _tag(e) == "sdt" and (inner := _first(e, "sdtContent")) is not None:
            yield from _word_blocks(inner)
        elif _tag(e) == "p" and (text := _word_runs(e)):
            style = _first(e, "pPr", "pStyle")
            level = re.fullmatch(r"(?i)heading\s?([1-6])|title", (_get(style, "val") or "") if style is not None else "")
            if level:
                yield "heading", "#" * int(level[1] or 1) + " " + " ".join(text.split())
            elif (number := _first(e, "pPr", "numPr")) is not None:
                depth = _first(number, "ilvl")
                yield "item", "  " * int((_get(depth, "val") or 0) if depth is not None else 0) + "- " + " ".join(text.split())
            else:
                yield "text", text


def _core_title(a: _Archive, name: str) -> str | None:
    if name not in a.names:
        return None
    return next((x.text.strip() for x in a.xml(name).iter() if _tag(x) == "title" and x.text and x.text.strip()), None)


def _word(a: _Archive) -> tuple[str, str | None]:
    body = _first(a.xml("word/document.xml"), "body")
    return _join(list(_word_blocks(body if body is not None else ET.Element("none")))), _core_title(a, "docProps/core.xml")


def _open_text(e: ET.Element) -> str:
    out = [e.text or ""]
    for x in e:
        name = _tag(x)
        out.append("\t" if name == "tab" else "\n" if name == "line-break" else " " * int(_get(x, "c") or 1) if name == "s" else "" if name in ("annotation", "note") else _open_text(x))
        out.append(x.tail or "")
    return "".join(out)


def _open_blocks(e: ET.Element, depth: int = -1) -> Iterator[tuple[str, str]]:
    for x in e:
        name = _tag(x)
        if name == "h" and (text := " ".join(_open_text(x).split())):
            yield "heading", "#" * min(6, int(_get(x, "outline-level") or 1)) + " " + text
        elif name == "p" and (text := _open_text(x).strip()):
            yield ("item", "  " * depth + "- " + " ".join(text.split())) if depth >= 0 else ("text", text)
        elif name == "list":
            yield from _open_blocks(x, depth + 1)
        elif name == "table":
            rows = [r for r in x.iter() if _tag(r) == "table-row"]
            cells = [[" ".join(_open_text(p).strip() for p in c.iter() if _tag(p) == "p") for c in r if _tag(c) == "table-cell"] for r in rows]
            if any(any(r) for r in cells):
                yield "table", table([r for r in cells if any(r)])
        elif name in ("list-item", "section", "page", "frame", "text-box", "custom-shape"):
            yield from _open_blocks(x, depth)


def _open_document(a: _Archive) -> tuple[str, str | None]:
    body = _first(a.xml("content.xml"), "body")
    blocks = [b for part in (body if body is not None else ()) for b in _open_blocks(part)]
    return _join(blocks), _core_title(a, "meta.xml")


def _slides(a: _Archive) -> tuple[str, str | None]:
    pages = []
    for name in a.numbered(r"ppt/slides/slide(\d+)\.xml"):
        lines: list[tuple[str, str]] = []
        for shape in (x for x in a.xml(name).iter() if _tag(x) in ("sp", "tbl")):
            if _tag(shape) == "tbl":
                lines.append(("table", table([["".join(t.text or "" for t in c.iter() if _tag(t) == "t") for c in r if _tag(c) == "tc"] for r in shape if _tag(r) == "tr"])))
                continue
            is_title = any(_tag(x) == "ph" and (_get(x, "type") or "") in ("title", "ctrTitle") for x in shape.iter())
            for p in (x for x in shape.iter() if _tag(x) == "p"):
                if text := "".join(t.text or "" for t in p.iter() if _tag(t) == "t").strip():
                    lines.append(("heading", "## " + text) if is_title else ("item", "- " + text))
        if lines:
            pages.append(_join(lines))
    return "\n\n".join(pages), _core_title(a, "docProps/core.xml")


def _sheets(a: _Archive) -> tuple[str, str | None]:
    shared = ["".join(t.text or "" for t in x.iter() if _tag(t) == "t") for x in a.xml("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in a.names else []
    titles = [_get(x, "name") or "" for x in a.xml("xl/workbook.xml").iter() if _tag(x) == "sheet"]
    out = []
    for k, name in enumerate(a.numbered(r"xl/worksheets/sheet(\d+)\.xml")):
        rows = []
        for row in (x for x in a.xml(name).iter() if _tag(x) == "row"):
            cells: list[str] = []
            for c in row:
                column = 0
                for letter in re.match("[A-Z]*", _get(c, "r") or "")[0]:
                    column = column * 26 + ord(letter) - 64
                cells += [""] * (min(column, 16384) - 1 - len(cells))
                kind, value = _get(c, "t"), next((x.text or "" for x in c if _tag(x) == "v"), "")
                cells.append(shared[int(value)] if kind == "s" and value else "".join(t.text or "" for t in c.iter() if _tag(t) == "t") if kind == "inlineStr" else value)
            if any(cells):
                rows.append(cells)
        if rows:
            out.append((f"## {titles[k]}\n\n" if k < len(titles) and titles[k] else "") + table(rows))
    return "\n\n".join(out), _core_title(a, "docProps/core.xml")


def _book(a: _Archive) -> tuple[str, str | None]:
    package = next(_get(x, "full-path") for x in a.xml("META-INF/container.xml").iter() if _tag(x) == "rootfile")
    root = a.xml(package)
    files = {_get(x, "id"): _get(x, "href") for x in root.iter() if _tag(x) == "item"}
    chapters = []
    for ref in (x for x in root.iter() if _tag(x) == "itemref"):
        name = posixpath.normpath(posixpath.join(posixpath.dirname(package), files.get(_get(ref, "idref")) or ""))
        if name in a.names:
            chapters.append(html_to_markdown(a.zip.read(name).decode("utf-8", "replace"))[0])
    return "\n\n".join(x for x in chapters if x), next((x.text.strip() for x in root.iter() if _tag(x) == "title" and x.text), None)


def csv_to_markdown(text: str) -> str:
    """A table; the separator is the commonest of comma, semicolon and tab in the first line."""
    first = text.split("\n", 1)[0]
    separator = max(",;\t", key=first.count)
    return table([r for r in csv.reader(io.StringIO(text), delimiter=separator) if any(x.strip() for x in r)])


def office_to_markdown(path: str, raw: bytes) -> tuple[str | None, str | None]:
    """(Markdown, title) by what the file holds, not by its name; (None, None) for what cannot be read."""
    try:
        if path.lower().endswith(".csv") and not raw.startswith(b"PK"):
            from .files import decode_bytes

            return csv_to_markdown(decode_bytes(raw)), None
        if not raw.startswith(b"PK\x03\x04"):
            return None, None
        a = _Archive(raw)
        for member, read in (("word/document.xml", _word), ("ppt/presentation.xml", _slides), ("xl/workbook.xml", _sheets), ("META-INF/container.xml", _book), ("content.xml", _open_document)):
            if member in a.names:
                return read(a)
    except (ET.ParseError, zipfile.BadZipFile, KeyError, ValueError, IndexError, StopIteration, RuntimeError, NotImplementedError, OSError, EOFError, csv.Error):
        pass
    return None, None


@F.arrow_udf(T.StructType([T.StructField("markdown", T.StringType()), T.StructField("title", T.StringType())]))
def _markdown(paths: pa.Array, contents: pa.Array) -> pa.Array:
    rows = [(None, None) if x is None else office_to_markdown(p or "", x) for p, x in zip(paths.to_pylist(), contents.to_pylist())]
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["markdown", "title"])


def to_markdown(path: Column, content: Column) -> Column:
    """Struct ``markdown, title`` of an office file; nulls where it cannot be read."""
    return _markdown(path, content)
