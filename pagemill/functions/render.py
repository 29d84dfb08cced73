"""Markdown from text, text from Markdown, and line joining: regular expressions and higher-order functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import chars

_W = f"[{chars.WS}]"
#: White space other than the line feed.
_H = chars.WS.replace("\\x{9}-\\x{d}", "\\x{9}\\x{b}-\\x{d}")


def lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a final line break."""
    return F.split(F.regexp_replace(F.regexp_replace(text, "\\r\\n", "\n"), "\\n$", ""), "\n")


def trim(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{_W}+|{_W}+\\z", "")


def text_to_markdown(text: Column) -> Column:
    """Right-trimmed lines, Markdown marks at their start escaped, at most one blank line in a row."""
    t = F.regexp_replace(text, "\\r\\n", "\n")
    t = F.regexp_replace(t, f"(?md)[{_H}]+$", "")
    t = F.regexp_replace(t, f"(?md)^([{_H}]*[#>|])", "\\\\$1")
    return trim(F.regexp_replace(t, "\\n{3,}", "\n\n"))


def plain_text(markdown: Column) -> Column:
    """Without heading marks, emphasis, table separators; table cells joined by tabs."""

    def one(line: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(line, f"^{_W}+", ""), f"^#+{_W}*", "")
        bare = F.regexp_replace(t, "\\*\\*|__|</?u>", "")
        cells = F.regexp_replace(bare, "^\\|+|\\|+$", "")
        row = F.array_join(F.transform(F.split(cells, "\\|"), trim), "\t")
        return F.when(t.rlike("^\\|[|: -]*$"), F.lit(None)).when(bare.startswith("|"), row).otherwise(bare)

    kept = F.array_compact(F.transform(lines(markdown), one))
    return F.when(F.coalesce(F.length(markdown), F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.array_join(kept, "\n"), F.when(F.size(kept) > 0, "\n").otherwise("")))


def method_label(kind: Column) -> Column:
    return F.translate(kind, "_", "-")


def join_lines(parts: Column) -> Column:
    """Lines of a paragraph joined by spaces; a Latin word hyphenated over two lines is joined."""
    kept = F.filter(F.transform(parts, trim), lambda x: x != "")
    spaced = F.array_join(kept, "\n")
    return F.regexp_replace(F.regexp_replace(spaced, "(?<=[A-Za-z])-\\n(?=[a-z])", ""), "\\n", " ")


def human_bytes(n: Column) -> Column:
    """Binary units with one decimal."""
    out = F.format_string("%d B", n)
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB"), (4, "TiB")):
        out = F.when(n >= 1024**power, F.format_string(f"%.1f {unit}", n / float(1024**power))).otherwise(out)
    return out


def hold_note(kind: Column, available: Column, required: Column, load: Column) -> Column:
    """Why work waits, in words: low memory, memory pressure of a named degree, or load."""
    memory = F.concat(F.lit("low memory ("), human_bytes(available), F.lit(" available, "), human_bytes(required), F.lit(" reserved for the system): pausing or running one page at a time"))
    pressed = F.concat(F.initcap(kind), F.lit(" memory pressure: pausing or running one page at a time"))
    return F.when(kind == "low_memory", memory).when(kind == "load", F.concat(F.lit("system load "), F.format_string("%.1f", load), F.lit(" is high: running one page at a time"))).otherwise(pressed)
