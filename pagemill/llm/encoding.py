"""Problem 6: find text that was decoded with the wrong character encoding and decode it again where possible.

Characters are mapped back to the bytes they had in a legacy code page, and an automaton over the byte structure finds the
maximal well-formed multibyte spans; only those spans are decoded. Sequences of Latin-1, Indic, Thai and East Asian letters
and of punctuation are decoded wherever they are well formed; spans of any other script must be plausible: one script, and
several characters in a row or such a span elsewhere in the text. That keeps genuine accented letters, genuine Cyrillic and
legacy-font text untouched. The steps are repeated until nothing is left to decode; each round makes the text shorter.

Defined results: null gives null and no kind; text without a span comes back unchanged; a lost byte (U+FFFD) is named as
garbled and stays where no decoding is certain.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .lookalike import CYRILLIC

#: Legacy single-byte code pages as which UTF-8 bytes may have been read.
CODE_PAGES = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "cp1250", "cp1254")
#: What a span may hold, as byte patterns of UTF-8. Two bytes: Latin-1 (and, garbled twice, its controls), and the letters
#: and signs that code page 1252 has besides; then combining marks, punctuation, ligatures; Indic scripts and Thai; East Asia.
_LATIN = r"\xC3[\x80-\xBF]|\xC2[\x80-\xBF]|\xC5[\x92\x93\xA0\xA1\xB8\xBD\xBE]|\xC6[\x92]|\xCB[\x86\x9C]"
_MARKS = r"\xCC[\x80-\xBF]|\xE2\x80[\x80-\xBF]|\xE2\x82\xAC|\xE2\x81\xA0|\xE2\x84\xA2|\xEF\xAC[\x80-\x86]|\xEF\xBB\xBF"
_INDIC = r"\xE0[\xA4\xA5\xAE\xAF\xB6-\xB9][\x80-\xBF]"
_EAST = r"[\xE3-\xE9][\x80-\xBF]{2}|\xEF[\xBC\xBD][\x80-\xBF]"
#: Every well-formed sequence of two to four bytes, up to the third plane.
_ANY = r"[\xC2-\xDF][\x80-\xBF]|\xE0[\xA0-\xBF][\x80-\xBF]|[\xE1-\xEC\xEE\xEF][\x80-\xBF]{2}|\xED[\x80-\x9F][\x80-\xBF]|\xF0[\x90-\xBF][\x80-\xBF]{2}"


def _chars(page: str) -> dict[int, str]:
    """The character of each byte above 127 in ``page``; bytes without one keep their number, as lenient decoders do."""
    out = {}
    for byte in range(0x80, 0x100):
        try:
            out[byte] = bytes([byte]).decode(page)
        except UnicodeDecodeError:
            out[byte] = chr(byte)
    return out


class _Page:
    """The automaton of one code page, over characters."""

    def __init__(self, page: str):
        chars = _chars(page)
        self.to_byte = {ord(c): b for b, c in chars.items()}
        if page == "cp1252":  # covers ISO 8859-1 as well, whose C1 controls are the bytes themselves
            self.to_byte |= {b: b for b in range(0x80, 0x100) if b not in self.to_byte}
        lost = "" if page != "cp1252" else "�"
        by_byte: dict[int, str] = {}
        for c, b in self.to_byte.items():
            by_byte[b] = by_byte.get(b, "") + chr(c)
        one = lambda b: "[" + re.escape(by_byte.get(b, "")) + "]" if by_byte.get(b) else "(?!)"
        some = lambda low, high, more="": "[" + re.escape("".join(by_byte.get(b, "") for b in range(low, high + 1))) + more + "]"

        def build(pattern: str, tolerant: str) -> str:
            pattern = re.sub(r"\[((?:\\x[0-9A-F]{2}-?)+)\]", lambda m: _members(m[1], by_byte, tolerant), pattern)
            return re.sub(r"\\x([0-9A-F]{2})", lambda m: one(int(m[1], 16)), pattern)

        latin = _LATIN if page != "cp1251" else r"\xC3[\x80-\xBF]"  # look-alike letters in Latin text resemble the other leads there
        narrow = build(latin, "") + "|" + build(_MARKS + "|" + _INDIC, lost)
        east = build(_EAST, "")
        self.span = re.compile(f"(?:{narrow}|(?:{east})(?={east}|{narrow})|(?<={some(0x80, 0xBF)})(?:{east}))+")
        self.likely = re.compile(some(0xC2, 0xF0) + some(0x80, 0xBF, lost))
        self.sets = ["".join(by_byte.get(b, "") for b in r) for r in (range(0xC2, 0xF1), range(0x80, 0xC0))]
        self.unit = re.compile(f"{narrow}|{east}")
        self.any_unit = build(_ANY, "")
        self.any_span = re.compile(f"(?:{self.any_unit})+")
        self.any_unit = re.compile(self.any_unit)

    def decode(self, span: str) -> str | None:
        if "�" in span:
            out = ""
            for x in self.unit.findall(span):
                if "�" not in x:
                    out += self.decode(x) or x
                elif x[0] in _MARK_LEADS:  # of the marks whose last byte page 1252 lacks: joiner after a virama, else closing quote
                    out += "\u200d" if out[-1:] in _VIRAMAS else "”"
                else:
                    out += "�"
            return out
        try:
            return bytes(self.to_byte[ord(c)] for c in span).decode("utf-8")
        except (UnicodeDecodeError, KeyError):
            return None


def _members(spec: str, by_byte: dict[int, str], more: str) -> str:
    low_high = re.findall(r"\\x([0-9A-F]{2})(?:-\\x([0-9A-F]{2}))?", spec)
    chars = "".join(by_byte.get(b, "") for a, z in low_high for b in range(int(a, 16), int(z or a, 16) + 1))
    return "[" + re.escape(chars + more) + "]"


@lru_cache(None)
def _pages() -> dict[str, _Page]:
    return {p: _Page(p) for p in CODE_PAGES}


#: Punctuation that may follow a letter in genuine text, several in a row.
_USUAL = frozenset("«»‹›“”‘’„‚…–—•·°§©®™ \xa0!¡¿")
_EAST_ASIAN = frozenset(("CJK", "HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "FULLWIDTH", "IDEOGRAPHIC"))
_FORMATS = frozenset("\xad\u200b\u200c\u200d\u200e\u200f\u2060\ufeff")
_GENUINE_CYRILLIC = re.compile("[Ѐ-ԯ]")


@lru_cache(100_000)
def _kind(c: str) -> str | None:
    """Script of a letter or mark, SIGN of symbols and digits, an empty string of punctuation; None where text holds no such character."""
    category = unicodedata.category(c)
    if category[0] in "LM":
        name = unicodedata.name(c, "?").split()[0]
        return "EAST" if name in _EAST_ASIAN else "" if name in ("COMBINING", "VARIATION") else name
    if category in ("Cn", "Co", "Cs", "Cc") or (category == "Cf" and c not in _FORMATS):
        return None
    return "SIGN" if category[0] in "SN" else ""


def _strong(text: str, start: int, end: int, units: list[str], new: str) -> bool:
    """Whether a span reads as garbled on its own: several characters of one script in a row, a pictograph, or letters and
    marks mingled as no genuine word has them."""
    kinds = [k for c in new if (k := _kind(c))]
    letters = [k for k in kinds if k != "SIGN"]
    if any(len(u) == 4 for u in units):
        return True
    if len(letters) > 1 and "LATIN" not in letters:
        return True
    if letters.count("LATIN") > 2:
        return True
    at = start
    for u, c in zip(units, new):
        lead, tail, around = u[0], u[1:], (text[at - 1 : at] if at else "") + text[at + len(u) : at + len(u) + 1]
        latin = _kind(c) == "LATIN" and c.islower() and around.isascii() and any(map(str.islower, around))
        if latin and lead.isalpha() and (lead.isupper() and text[at - 1 : at].islower() or not any(map(str.isalpha, tail)) and around[-1:].isalpha()):
            return True
        if latin and ("─" <= lead <= "▟" or unicodedata.category(lead) == "Sm"):
            return True  # line drawing or a mathematical sign within a word
        if len(tail) == 2 and not any(map(str.isalnum, tail)) and not set(tail) <= _USUAL:
            return True
        at += len(u)
    return False


def _other_scripts(text: str, page: _Page, name: str, known: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """``known`` edits with the plausible spans of all other scripts; a span takes the place of the known ones within it."""
    ends = [e for _, e, _, _ in known]
    spans = []
    for m in page.any_span.finditer(text):
        k = bisect_left(ends, m.end())
        if k == len(ends) or known[k][0] > m.start():  # not within a known edit, which may reach further over lost bytes
            spans.append(m)
    seen: list[tuple[int, int, str, frozenset, bool]] = []
    for m in spans:
        new = page.decode(m[0])
        if new is None or any(_kind(c) is None for c in new):
            continue
        scripts = frozenset(k for c in new if (k := _kind(c)) and k != "SIGN")
        if len(scripts) < 2:
            seen.append((*m.span(), new, scripts, _strong(text, *m.span(), page.any_unit.findall(m[0]), new)))
    sure = frozenset().union(*(x[3] for x in seen if x[4]))
    # Latin-1 and punctuation follow any other span of the page, other scripts a strong one of their own.
    usual = [x[4] or bool(known or sure) and all(c < "Ā" or "\u2000" <= c <= "⁯" for c in x[2]) for x in seen]
    taken = [(s, e, new, name) for (s, e, new, scripts, _), ok in zip(seen, usual) if ok or (scripts and scripts <= sure)]
    out, k = [], 0
    for edit in known:  # maximal spans hold a known one whole or not at all
        while k < len(taken) and taken[k][1] <= edit[0]:
            k += 1
        if k == len(taken) or taken[k][0] >= edit[1]:
            out.append(edit)
    return sorted(out + taken)


def _overwhelmed(text: str, edits: list[tuple[int, int, str, str]]) -> bool:
    """Whether ``text`` has many Cyrillic letters outside the edits, those that pass for Latin ones apart: genuine Cyrillic."""
    inside = sum(e - s for s, e, _, _ in edits)
    outside, at = 0, 0
    for s, e, _, _ in [*edits, (len(text), len(text), "", "")]:
        outside += sum(c not in CYRILLIC for c in _GENUINE_CYRILLIC.findall(text[at:s]))
        at = e
    return 3 * outside > inside


_MARK_LEADS, _VIRAMAS = "â", ("්", "்", "्")
#: Pairs of printable ASCII bytes read as UTF-16 in either order, several in a row; upper Latin-1 in a row.
_WIDE_SPAN = re.compile(r"[†-繾 ਠ-੾ -⁯]{4,}")
_DOUBLE_SPAN = re.compile(r"[\xa1-\xfe]{4,}")
_UPPER = re.compile("[\x80-\xff]")
_LOST = re.compile("[\x80-\x84\x86-\x9f�]")
_PLAIN = re.compile(rb"[a-z ]")
_COMMON_WORDS = re.compile(rb" (?:the|of|and|to|in|was|der|die|und|hat|le|la|de|et|du) ")


@lru_cache(None)
def _likely() -> re.Pattern:
    """A lead character followed by a continuation character of any code pages: fast over clean text."""
    leads, tails = ("".join(p.sets[i] for p in _pages().values()) for i in (0, 1))
    return re.compile(f"[{re.escape(leads)}][{re.escape(tails)}�]")


def suspect(text: str) -> bool:
    return bool(_LOST.search(text) or _likely().search(text) or _WIDE_SPAN.search(text) or _DOUBLE_SPAN.search(text))


def _wide(span: str) -> str | None:
    """UTF-16 read of single-byte text, undone; None where the bytes don't look like words."""
    best, most = None, -1
    for order in ("utf-16-le", "utf-16-be"):
        try:
            raw = span.encode(order)
            if len(_PLAIN.findall(raw)) >= 0.7 * len(raw) and (n := len(_COMMON_WORDS.findall(raw))) > most:
                best, most = raw.decode("utf-8"), n
        except UnicodeError:
            pass
    return best


#: Double-byte encodings of Chinese and Japanese read as a single-byte one: common two-byte characters in a row.
_DOUBLE_BYTE = {
    "gb2312": re.compile(r"(?:[\xb0-\xd7][\xa1-\xfe]|\xa1[\xa1-\xbf]|\xa3[\xa1-\xfe]|[\xd8-\xf7][\xa1-\xfe])+"),
    "euc_jp": re.compile(r"(?:[\xa4\xa5][\xa1-\xf6]|[\xb0-\xf4][\xa1-\xfe]|\xa1[\xa1-\xd8]|\xa3[\xb0-\xfa])+"),
    "shift_jis": re.compile(r"(?:\x82[\x4f-\x58\x60-\x79\x81-\x9a\x9f-\xf1]|\x83[\x40-\x7e\x80-\x96]|\x81[\x40-\x7e\x80-\xac]|[\x88-\x9f\xe0-\xea][\x40-\x7e\x80-\xfc])+"),
}
#: Of the characters of a double-byte span, the share that must be of the common kind, and how many there must be.
_COMMON = {
    "gb2312": re.compile(r"[\xb0-\xd7][\xa1-\xfe]|\xa1[\xa1-\xbf]|\xa3[\xa1-\xfe]"),
    "euc_jp": re.compile(r"\xa4[\xa1-\xf3]|\xa1[\xa1-\xd8]|[\xb0-\xcf][\xa1-\xfe]"),
    "shift_jis": re.compile(r"\x82[\x9f-\xf1]|\x81[\x40-\xac]|[\x88-\x97][\x40-\xfc]"),
}


_UTF8_BYTES = re.compile(_ANY)


@lru_cache(None)
def _bytes_1252() -> dict[int, int]:
    return {ord(c): b for b, c in _chars("cp1252").items()}


def _double(text: str) -> list[tuple[int, int, str, str]]:
    """Edits of the double-byte encoding that explains the most of ``text``; kana must be among the Japanese."""
    as_bytes = text.translate(_bytes_1252())
    if sum(len(m[0]) for m in _UTF8_BYTES.finditer(as_bytes)) >= 0.8 * len(_UPPER.findall(as_bytes)):
        return []  # sound UTF-8, which these encodings hardly ever are
    best: list[tuple[int, int, str, str]] = []
    for name, pattern in _DOUBLE_BYTE.items():
        out, kana, common, size, longest = [], 0, 0, 0, 0
        for m in pattern.finditer(as_bytes):
            try:
                new = m[0].encode("latin-1").decode(name)
            except UnicodeError:
                continue
            high = sum(ord(c) > 0x7F for c in m[0])
            if high < 2:
                continue
            out.append((m.start(), m.end(), new, name))
            size += len(new)
            longest = max(longest, len(new))
            common += len(_COMMON[name].findall(m[0]))
            kana += sum("ぁ" <= c <= "ヶ" for c in new)
        if size < 4 or longest < 3 or common < 0.8 * size or (name != "gb2312" and kana < 0.15 * size):
            continue
        if sum(e - s for s, e, _, _ in out) > sum(e - s for s, e, _, _ in best):
            best = out
    return best


def _edits(text: str) -> list[tuple[int, int, str, str]]:
    """One round: (start, end, replacement, encoding) of the spans to decode, in order, by the encoding that explains most."""
    best: list[tuple[int, int, str, str]] = []
    size = 0
    for name, page in _pages().items():
        if not page.likely.search(text):
            continue
        out = []
        for m in page.span.finditer(text):
            new = page.decode(m[0])
            if new is not None and new != m[0]:
                out.append((m.start(), m.end(), new, name))
        out = _other_scripts(text, page, name, out)
        if name == "cp1251" and _overwhelmed(text, out):
            continue
        if (n := sum(e - s for s, e, _, _ in out)) > size:
            best, size = out, n
    if (_DOUBLE_SPAN.search(text) or _LOST.search(text)) and 2 * size < len(_UPPER.findall(text)):
        out = _double(text)
        if (n := sum(e - s for s, e, _, _ in out)) > size:
            best, size = out, n
    if not best:
        best = [(m.start(), m.end(), new, "utf-16") for m in _WIDE_SPAN.finditer(text) if (new := _wide(m[0]))]
    return best


def restore(text: str | None) -> tuple[str | None, list[str]]:
    """The text with its garbled spans decoded, and the code pages found, ``lost`` among them if bytes are gone."""
    if not text or not suspect(text):
        return text, []
    kinds: list[str] = []
    while edits := _edits(text):
        at, parts = 0, []
        for start, end, new, _name in edits:
            parts += [text[at:start], new]
            at = end
        text = "".join([*parts, text[at:]])
        kinds.append(edits[0][3])
    return text, kinds + ["lost"] * ("�" in text)


def restore_aligned(text: str) -> tuple[str, list[int], list[int]]:
    """``restore`` with, for each character of the result, where its source starts and ends in ``text``."""
    first, last = list(range(len(text))), list(range(1, len(text) + 1))
    while edits := _edits(text):
        at, parts, a, b = 0, [], [], []
        for start, end, new, name in edits:
            parts += [text[at:start], new]
            a += first[at:start]
            b += last[at:start]
            sizes = _source_sizes(text[start:end], new, name)
            here = start
            for n in sizes:
                a.append(first[min(here, end - 1)])
                b.append(last[min(here + max(n, 1), end) - 1])
                here += n
            at = end
        text, first, last = "".join([*parts, text[at:]]), a + first[at:], b + last[at:]
    return text, first, last


def _source_sizes(old: str, new: str, name: str) -> list[int]:
    """How many characters of ``old`` each character of ``new`` comes from (at least one is credited to each)."""
    if name in _DOUBLE_BYTE:
        sizes = [len(c.encode(name)) for c in new]
    elif name == "utf-16":
        return [1 if i % 2 == 0 else 0 for i in range(len(new))] if len(new) == 2 * len(old) else _spread(len(old), len(new))
    elif "�" in old:
        return _spread(len(old), len(new)) if len(units := _pages()[name].unit.findall(old)) != len(new) else [len(u) for u in units]
    else:
        sizes = [len(c.encode()) for c in new]
    return sizes if sum(sizes) == len(old) else _spread(len(old), len(new))


def _spread(old: int, new: int) -> list[int]:
    edges = [round(i * old / new) for i in range(new + 1)]
    return [b - a for a, b in zip(edges, edges[1:])]


def restored(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``df`` to ``(record_id, kinds, text)`` of its garbled records only; clean records give no row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, kinds, texts = [], [], []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            new, found = restore(text)
            if found:
                ids.append(i)
                kinds.append(found)
                texts.append(new)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(kinds, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["record_id", "kinds", "text"])

    return map_batches(df.select(F.col(id_column).cast("bigint"), text_column).where(F.col(text_column).isNotNull()), run, "record_id bigint, kinds array<string>, text string")
