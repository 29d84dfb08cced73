"""Conversion of legacy-font text to Unicode, for plain text and for Markdown pages with words known by font.

Longest codes first by one regular expression over the table; conversions of distinct words are kept by each worker.
Null text gives null; text without codes comes back normalised.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import chars
from .normalize import normalize_text
from .tables import FM_ABHAYA

_CONJUNCT = "්‍[ක-ෆ]"
_PREBASE = re.compile(f"([ෙෛ])([ක-ෆ](?:{_CONJUNCT})*)")
_SIGN_FIRST = re.compile(f"([ා-ෟෲෳ])({_CONJUNCT})")


class Converter:
    """A table of codes and the text, in visual order, that they draw."""

    def __init__(self, family: str, lang: str, table: dict[str, str]):
        self.family, self.lang, self.table = family, lang, dict(table)
        self._codes = re.compile("|".join(map(re.escape, sorted(table, key=len, reverse=True))) or "(?!)")
        self._single = {c for c in table if len(c) == 1}
        self.convert = lru_cache(100_000)(self._convert)

    def __len__(self) -> int:
        return len(self.table)

    def maps(self, c: str) -> bool:
        return c in self._single

    def _convert(self, text: str) -> str:
        drawn = self._codes.sub(lambda m: self.table[m[0]], text)
        return normalize_text(_SIGN_FIRST.sub(r"\2\1", _PREBASE.sub(r"\2\1", drawn)))


@lru_cache(None)
def converter(family: str) -> Converter | None:
    return Converter("fm-abhaya", "si", FM_ABHAYA) if family == "fm-abhaya" else None


@dataclass
class FontWords:
    """Words of a page by the fonts that drew them."""

    legacy: frozenset[str] = frozenset()
    other: frozenset[str] = frozenset()
    mixed: dict[str, list[bool]] = field(default_factory=dict)
    legacy_chars: int = 0
    other_chars: int = 0

    @property
    def legacy_share(self) -> float:
        total = self.legacy_chars + self.other_chars
        return self.legacy_chars / total if total else 0.0

    def look_up(self, text: str) -> tuple[str | list[bool], int, int] | None:
        """(class, characters cut in front, behind): the whole text, else the smallest cut of up to three edge characters."""
        for cut in range(4):
            if cut and cut >= len(text):
                return None
            for front in range(cut + 1):
                inner = text[front : len(text) - (cut - front)]
                if inner in self.legacy:
                    return "legacy", front, cut - front
                if inner in self.other:
                    return "other", front, cut - front
                if inner in self.mixed:
                    return self.mixed[inner], front, cut - front
        return None


def convert_runs(text: str, flags: list[bool], conv: Converter) -> str:
    """Convert the runs drawn by the legacy font; characters without a flag count as such."""
    flags = (flags + [True] * len(text))[: len(text)]
    out, at = [], 0
    while at < len(text):
        end = at + 1
        while end < len(text) and flags[end] == flags[at]:
            end += 1
        out.append(conv.convert(text[at:end]) if flags[at] else text[at:end])
        at = end
    return "".join(out)


_INNER = re.compile(r"(?<!\\)(</?u>|\*\*|~~|`)")
_EDGES = re.compile(r"^((?:<u>|\*\*|\*|#|>|`|~~)*)(.*?)((?:(?<!\\)(?:</u>|\*\*|\*|`|~~))*)$", re.S)
_ESCAPE = re.compile(r"\\(?=[!-/:-@\[-`{-~])")
_CELL = re.compile(r"(?<!\\)\|")
_WHITE = re.compile(f"([{re.escape(chars.WHITE)}]+)")


class _Page:
    def __init__(self, words: FontWords | None, conv: Converter):
        self.words, self.conv = words, conv
        self.legacy_page = words is None or words.legacy_share >= 0.5
        self.converted = self.kept = self.unmatched = 0

    def text(self, text: str) -> str:
        if not any(map(self.conv.maps, text)):
            return text
        if self.words is None:
            self.converted += 1
            return self.conv.convert(text)
        hit = self.words.look_up(text)
        if hit is None:
            self.unmatched += 1
            punctuation = all(c.isascii() and not c.isalnum() and c.isprintable() and c != " " for c in text)
            return self.conv.convert(text) if self.legacy_page and not punctuation else text
        kind, front, behind = hit
        if kind == "other":
            self.kept += 1
            return text
        self.converted += 1
        if kind == "legacy":
            return self.conv.convert(text)
        return convert_runs(text, [True] * front + list(kind) + [True] * behind, self.conv)

    def token(self, token: str) -> str:
        plain = _ESCAPE.sub("", token)
        hit = self.words.look_up(plain) if self.words else None
        if hit and hit[0] != "other" and hit[1:] == (0, 0):  # a word may itself start with a mark
            return self.text(plain)
        out = []
        for k, piece in enumerate(_INNER.split(token)):
            if k % 2:
                out.append(piece)
            elif piece:
                lead, core, trail = _EDGES.match(piece).groups()
                out += [lead, self.text(_ESCAPE.sub("", core)), trail]
        return "".join(out)

    def span(self, text: str) -> str:
        return "".join(x if k % 2 or not x else self.token(x) for k, x in enumerate(_WHITE.split(text)))

    def line(self, line: str) -> str:
        body = line.rstrip("\r\n")
        if body.lstrip(chars.WHITE).startswith("|"):
            cells = _CELL.split(body)
            if not all(set(c) <= set("|-: ") for c in cells):
                return "|".join(map(self.span, cells)) + line[len(body) :]
            return line
        return self.span(body) + line[len(body) :]


def convert_markdown(markdown: str, words: FontWords | None, conv: Converter) -> tuple[str, int, int, int]:
    """(text, tokens converted, kept, unmatched); table rows are converted cell by cell."""
    page = _Page(words, conv)
    return "".join(map(page.line, re.findall(r"[^\n]*\n|[^\n]+", markdown))), page.converted, page.kept, page.unmatched


_CLUSTER_SIGN = re.compile("((?:[ක-ෆ]්‍)*[ක-ෆ])([ෙෛ]+)")


def clean_recognised(word: str) -> str:
    """A recognised Sinhala word in NFC without non-joiners, and without joiners at its ends."""
    return unicodedata.normalize("NFC", word).replace(chars.ZWNJ, "").strip(chars.ZWJ)


def visual_units(word: str) -> list[str]:
    """A Sinhala word as a legacy font draws it: parts of vowels apart, signs that stand in front before their whole
    consonant cluster; a virama and its joiner are one unit."""
    drawn = _CLUSTER_SIGN.sub(r"\2\1", unicodedata.normalize("NFD", word))
    return re.findall("්‍|.", drawn, re.S)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _drawn(words: pa.Array) -> pa.Array:
    return pa.array([None if x is None else visual_units(clean_recognised(x)) for x in words.to_pylist()], pa.list_(pa.string()))


def drawn_units(word: Column) -> Column:
    """``visual_units`` of recognised words."""
    return _drawn(word)


@F.arrow_udf(T.StringType())
def _convert_fm(texts: pa.Array) -> pa.Array:
    conv = converter("fm-abhaya")
    return pa.array([None if x is None else conv.convert(x) for x in texts.to_pylist()], pa.string())


def convert(text: Column, family: str = "fm-abhaya") -> Column:
    if family != "fm-abhaya":
        raise ValueError(f"no code table for {family}")
    return _convert_fm(text)


@F.arrow_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("converted", T.IntegerType()), T.StructField("kept", T.IntegerType()), T.StructField("unmatched", T.IntegerType())]))
def _convert_pages(texts: pa.Array, legacy: pa.Array, other: pa.Array, mixed: pa.Array, legacy_chars: pa.Array, other_chars: pa.Array) -> pa.Array:
    conv, rows = converter("fm-abhaya"), []
    for t, a, o, m, n, k in zip(*(x.to_pylist() for x in (texts, legacy, other, mixed, legacy_chars, other_chars))):
        if t is None:
            rows.append((None, 0, 0, 0))
            continue
        words = None if a is None else FontWords(frozenset(a), frozenset(o or ()), {x: [bool(f) for f in y or ()] for x, y in m or ()}, n or 0, k or 0)
        rows.append(convert_markdown(t, words, conv))
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int32()) for i in range(4)], names=["text", "converted", "kept", "unmatched"])


def convert_page(markdown: Column, legacy: Column, other: Column, mixed: Column, legacy_chars: Column, other_chars: Column) -> Column:
    """Struct ``text, converted, kept, unmatched``; a null ``legacy`` means that nothing is known of the fonts."""
    return _convert_pages(markdown, legacy, other, mixed, legacy_chars.cast("bigint"), other_chars.cast("bigint"))


def legacy_share(legacy: Column, other: Column) -> Column:
    total = F.coalesce(legacy, F.lit(0)) + F.coalesce(other, F.lit(0))
    return F.when(total == 0, F.lit(0.0)).otherwise(F.coalesce(legacy, F.lit(0)) / F.greatest(total, F.lit(1)))
