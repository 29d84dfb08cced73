"""Problem 3: sentence units of every document, across languages and scripts.

A text is read as blocks (headings, list items, tables, prose). Prose is cut at the accepted edges of a terminator lattice:
every terminator outside a quotation is an edge whose acceptance depends on the word before it (abbreviations, initials,
ordinals) and the character after it. Abbreviations are learned from the collection beside a short list: short words whose
period is nearly always followed by a small letter or a number.

In scripts without spaces between words (Thai, Chinese, Japanese) the words on both sides of a gap are found by the best path
through a word lattice. Its dictionary is counted in the collection: beginnings and ends of unbroken runs of letters after
which many different characters follow. A gap is classified by the word that closes the run before it (final particles, words
known from ends of paragraphs or from before a terminator, words known only from before a number) and by the word that opens
the run after it. In Thai a gap ends a sentence unless a word speaks against it, in Chinese and Japanese only if one speaks
for it.

Defined results: null, empty and blank texts and tables give no unit. Garbled text is segmented as its restored form and
invisible characters are looked through; offsets are always those of the stored text.
"""

from __future__ import annotations

import re
from functools import lru_cache
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import encoding
from .common import batch, map_batches
from .lookalike import HYPHENS, SPACES, folder

# Words before a period that doesn't end a sentence, by language.
ABBREVIATIONS = frozenset(
    "mr mrs ms dr prof st no p pp i.e e.g approx rs vs cf fig vol ch sec jr sr gen col capt rev hon ltd co inc ed eds est "
    "gov sen rep univ dept jan feb mar apr jun jul aug sept oct nov dec u.s u.k u.n "
    "nr abs z ca bzw usw vgl bd hrsg str tel art m mm mme mlle ex av env etc. "
    "රු පෙ.ව ප.ව පෙ ප.ව. ප මි කි.මී කි ගරු දොස්තර ආචාර්ය අංක වි.ක "
    "திரு திருமதி டாக்டர் மு.ப பி.ப மு பி ரூ எண் கி.மீ கி கி.மு கி.பி மா "
    "डॉ रु श्री श्रीमती प्रो सं क्र कि.मी कि मि ई.पू पू पं".split()
)
#: Names of Latin letters in Sinhala script, used as initials.
SINHALA_INITIALS = frozenset("ඒ බී සී ඩී ඊ එෆ් ජී එච් අයි ජේ කේ එල් එම් එන් ඕ පී කිව් ආර් එස් ටී යූ වී ඩබ්ලිව් ඩබ් එක්ස් වයි ඉසෙඩ්".split())
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember".split())
# Particles of the spaceless scripts: words that close a sentence, that cannot close one, that cannot open one.
FINAL = frozenset("ครับ ค่ะ คะ นะ จ้ะ จ๊ะ ล่ะ สิ ซิ เถอะ หรอก ไหม มั้ย 了 吗 呢 吧 啊 呀 嘛 です ます でした ました ません だ か よ ね である ください".split())
OPEN_ENDED = frozenset("และ หรือ ที่ ซึ่ง ของ ใน จาก ถึง โดย กับ ต่อ ตาม เพื่อ ว่า แต่ จำนวน ปี เลขที่ ข้อ มาตรา 和 与 的 在 或 而 は が を に で と の も へ や".split())
CONTINUING = frozenset("และ หรือ ซึ่ง ว่า แต่ เพราะ จึง ด้วย แล้ว ฉบับ เมตร บาท คน วัน 和 与 或 が を に は".split())
#: Longest word of a lattice, and cost of a word and of a character that belongs to none.
WORD, KNOWN, UNKNOWN = 12, 0.5, 2.0
#: Bounds of what is learned: words of each script and side, abbreviations. Least cases of a word; of an abbreviation, and the
#: share of them before a small letter or a number. Characters that follow a word, and the share that one of them may have.
MOST_WORDS, MOST_ABBREVIATIONS, LEAST, LEAST_ABBREVIATION, SHARE, VARIETY, LEADING = 20_000, 5_000, 5, 8, 0.9, 3, 0.8

CJK = "぀-ヿ㐀-䶿一-鿿\uf900-\ufaffｦ-ﾟ"
THAI = "฀-๿"
_OPEN = {"“": "”", "„": "“”", "«": "»", "「": "」", "『": "』"}
_QUOTE = re.compile(r"[“”„«»「」『』]")
_LOST_QUOTE = re.compile(r"(?<=\s)�(?=\w)|(?<=[.?!])�")
_WIDE = "。！？"
#: A terminator with the marks that close over it, and what lets it be an edge; one leading class keeps the search fast.
_EDGE = re.compile(rf"([.!?।…{_WIDE}]+)([”\"»’'）\)\]“�」』]*)(?:(?=\s|$)|(?=[{CJK}“「])|(?<=[{_WIDE}”」』’）\)]))")
_THAI_LETTER = re.compile(f"[{THAI}]")
_GAP = re.compile(rf"(?<=[{THAI}])\s+(?=[^\W\d]|\d[\d.,]*\s+[^\W\d{THAI}])")
_CJK_GAP = re.compile(f"(?<=[{CJK}])[ \u3000]+(?=[{CJK}])")
_THAI_RUN, _CJK_RUN, _NUMBER, _FOREIGN = re.compile(f"[{THAI}]+"), re.compile(f"[{CJK}]+"), re.compile(r"[\d.,]+\s+"), re.compile(rf"[^\s{THAI}]+\s*")
_CJK_NEXT = re.compile(f"[{CJK}“「]")
_LINE = re.compile(r"[^\n]*\n?")
_HEADING = re.compile(r"[ \t]*#{1,6}[ \t]+")
_ITEM = re.compile(r"[ \t]*(?:[-*•+–][ \t]+|\d{1,3}[.)][ \t]+|\([A-Za-z0-9]{1,3}\)[ \t]*|[a-z]\)[ \t]+)")
_MARK_STARTS = frozenset("#|-*•+–(0123456789")
_TABLE = re.compile(r"[ \t]*\|")
_TAMIL_LETTER = re.compile(r"[அ-ஹ][ா-்]*$")
_INVISIBLE = "\xad͏​-‏‪-‮⁠-⁤⁦-⁯︀-️﻿᠎"
_HIDDEN = re.compile(f"[{_INVISIBLE}]")
#: One-to-one forms that the segmenter reads as their plain character; offsets don't change.
_PLAIN = {ord(c): " " for c in SPACES} | {ord(c): "-" for c in HYPHENS} | {0xFF01 + i: chr(0x21 + i) for i in range(94) if chr(0x21 + i).isalnum() or chr(0x21 + i) in "#|-*."}


_ODD = re.compile("[" + re.escape("".join(map(chr, _PLAIN))) + "]")


class Knowledge:
    """What a collection teaches: words that open and close runs, with how often at the edge of a paragraph or beside a
    terminator, beside a number, and at another gap; and abbreviations."""

    def __init__(self, opening: dict[str, tuple[int, int, int]] | None = None, closing: dict[str, tuple[int, int, int]] | None = None, abbreviations: frozenset[str] = frozenset()):
        self.opening, self.closing = opening or {}, closing or {}
        self.words = FINAL | OPEN_ENDED | CONTINUING | self.opening.keys() | self.closing.keys()
        self.abbreviations = ABBREVIATIONS | abbreviations
        self.edges = lru_cache(200_000)(self._edges)

    def _edges(self, run: str) -> tuple[str, str]:
        """First and last word of a run, by the path through its word lattice that costs least."""
        cost: list[tuple[float, int]] = [(0.0, 0)] + [(1e9, 0)] * len(run)
        for end in range(1, len(run) + 1):
            best = (cost[end - 1][0] + UNKNOWN, end - 1)
            for size in range(1, min(WORD, end) + 1):
                if run[end - size : end] in self.words and (c := cost[end - size][0] + KNOWN) < best[0]:
                    best = (c, end - size)
            cost[end] = best
        cuts, at = [len(run)], len(run)
        while at:
            at = cost[at][1]
            cuts.append(at)
        cuts.reverse()
        return (run[: cuts[1]], run[cuts[-2] :]) if len(cuts) > 1 else ("", "")

    def ends(self, left: str, right: str) -> int:
        """1 if the words beside a gap speak for the end of a sentence, -1 if they speak against it, 0 if neither."""
        last, first = self.edges(left)[1], self.edges(right)[0]
        if first in CONTINUING or last in OPEN_ENDED:
            return -1
        if last in FINAL:
            return 1
        closed, opened = self.closing.get(last, (0, 0, 0)), self.opening.get(first, (0, 0, 0))
        if any(beside >= 4 * LEAST and beside >= 10 * (edge + gap) for edge, beside, gap in (closed, opened)):
            return -1  # known from beside numbers
        return int(closed[0] >= LEAST and closed[0] >= 4 * (closed[1] + closed[2]))


def _quoted(text: str, lost: bool) -> list[tuple[int, int]]:
    """Spans of quotations, marks included; a mark without a partner in ``text`` makes none."""
    out, start, closing = [], -1, ""
    for m in _QUOTE.finditer(text):
        c = m[0]
        if start >= 0 and c in closing:
            out.append((start, m.end()))
            start, closing = -1, ""
        elif start < 0 and c in _OPEN and any(x in text[m.end() :] for x in _OPEN[c]):
            start, closing = m.start(), _OPEN[c]
    if lost:
        opened = -1
        for m in _LOST_QUOTE.finditer(text):
            if text[m.start() - 1] not in ".?!":
                opened = m.start()
            elif opened >= 0:
                out.append((opened, m.end()))
                opened = -1
    return out


def _gap_ends(text: str, m: re.Match, know: Knowledge) -> bool:
    """Whether a gap after a letter of a spaceless script ends a sentence."""
    if m.re is _CJK_GAP:
        return know.ends(_run_before(text, m.start(), _CJK_RUN), _CJK_RUN.match(text, m.end())[0]) > 0
    at = number.end() if (number := _NUMBER.match(text, m.end())) else m.end()
    if not "฀" <= text[at : at + 1] <= "๿":
        word = _FOREIGN.match(text, at)  # a single foreign name doesn't end a Thai sentence
        return not (word and "฀" <= text[word.end() : word.end() + 1] <= "๿")
    return know.ends(_run_before(text, m.start(), _THAI_RUN), _THAI_RUN.match(text, at)[0]) >= 0


def _run_before(text: str, end: int, letters: re.Pattern) -> str:
    """The unbroken run of ``letters`` that ends at ``end``."""
    start = end
    while start and letters.match(text, start - 1, start):
        start -= 1
    return text[start:end]


def _mark_ends(text: str, m: re.Match, inside: bool, know: Knowledge) -> bool:
    """Whether the terminator ``m`` ends a sentence; ``inside``: it lies in a quotation that ends with it."""
    mark, end = m[1], m.end()
    wide = mark[-1] in _WIDE or (mark[-1] in "!?" and _CJK_NEXT.match(text, end))
    if not wide and end < len(text) and not text[end].isspace():
        return False
    after = text[end:].lstrip()
    if not after:
        return True
    nxt = after[:4].lstrip("“„«\"'‘([「")[:1]
    if wide:
        return not inside or nxt.isupper()
    if nxt.islower():
        return False
    if inside:
        return nxt.isupper()
    if mark != ".":
        return True
    begin = max(text.rfind(" ", 0, m.start()), text.rfind("\n", 0, m.start())) + 1
    word = text[begin : m.start()].lstrip("“„«\"'‘([「")
    tail = re.split("[’'-]", word)[-1]
    if not tail.isascii():  # abbreviations typed with look-alike or decomposed letters
        tail = _folded(tail)
    low = tail.lower()
    if low in know.abbreviations or tail in SINHALA_INITIALS:
        return False
    if low in ("a.m", "p.m"):
        return not nxt.isdigit()
    if len(tail) == 1 and tail.isalpha() and tail.isupper():
        return False
    if _TAMIL_LETTER.fullmatch(tail):
        return False
    return not (tail.isdigit() and len(tail) <= 2 and (month := re.match(r"[^\W\d]+", after)) and month[0] in GERMAN_MONTHS)


def _prose(text: str, lost: bool, know: Knowledge):
    """(start, end) of the sentences of a paragraph."""
    quotes = _quoted(text, lost) if lost or _QUOTE.search(text) else []
    edges = _EDGE.finditer(text)
    gaps = [*(_GAP.finditer(text) if _THAI_LETTER.search(text) else ()), *_CJK_GAP.finditer(text)]
    if gaps:
        edges = sorted([*edges, *gaps], key=lambda m: m.start())
    at, q = 0, 0
    for m in edges:
        while q < len(quotes) and quotes[q][1] <= m.start():
            q += 1
        held = q < len(quotes) and quotes[q][0] <= m.start() < quotes[q][1]
        if held and m.end() < quotes[q][1]:
            continue
        gap = not m.re.groups
        if _gap_ends(text, m, know) if gap else _mark_ends(text, m, held, know):
            yield at, (m.start() if gap else m.end())
            at = m.end()
    if at < len(text):
        yield at, len(text)


@lru_cache(100_000)
def _folded(word: str) -> str:
    return folder()(word)


def _trim(text: str, start: int, end: int) -> tuple[int, int]:
    piece = text[start:end]
    return start + len(piece) - len(piece.lstrip()), end - (len(piece) - len(piece.rstrip()))


_PLAIN_KNOWLEDGE = Knowledge()


def plain_units(text: str, lost: bool = False, know: Knowledge = _PLAIN_KNOWLEDGE):
    """(start, end, kind) of the units of a text without invisible characters; kind is heading, item or sentence."""
    block: list[tuple[int, int]] = []  # lines of the open block
    kind = "sentence"

    def close():
        if not block:
            return
        start, end = block[0][0], block[-1][1]
        if kind == "sentence":
            for a, b in _prose(text[start:end], lost, know):
                a, b = _trim(text, start + a, start + b)
                if a < b:
                    yield a, b, kind
        else:
            a, b = _trim(text, start, end)
            if a < b:
                yield a, b, kind
        block.clear()

    for line in _LINE.finditer(text):
        if line.start() == line.end():
            continue
        first = text[line.start()]
        if first not in _MARK_STARTS and not first.isspace() and text[line.start() + 1 : line.start() + 2] != ")":
            block.append(line.span())
        elif not line[0].strip():
            yield from close()
            kind = "sentence"
        elif _TABLE.match(line[0]):
            yield from close()
            kind = "sentence"
        elif m := _HEADING.match(line[0]):
            yield from close()
            a, b = _trim(text, line.start() + m.end(), line.end())
            if a < b:
                yield a, b, "heading"
            kind = "sentence"
        elif m := _ITEM.match(line[0]):
            yield from close()
            kind = "item"
            block.append((line.start() + m.end(), line.end()))
        else:
            block.append(line.span())
    yield from close()


def units(text: str, know: Knowledge = _PLAIN_KNOWLEDGE) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, readable text) of the units of a stored text, in its own offsets."""
    first = last = None
    lost = False
    if encoding.suspect(text):
        new, first, last = encoding.restore_aligned(text)
        if new != text:
            lost, text = "�" in new, new
        else:
            first = last = None
            lost = "�" in text
    if _HIDDEN.search(text):
        keep, at = [], 0
        for m in _HIDDEN.finditer(text):
            keep += range(at, m.start())
            at = m.end()
        keep += range(at, len(text))
        clean = _HIDDEN.sub("", text)
        first, last = ([first[i] for i in keep], [last[i] for i in keep]) if first else (keep, [i + 1 for i in keep])
        text = clean
    if _ODD.search(text):
        text = text.translate(_PLAIN)
    found = plain_units(text, lost, know)
    if first is None:
        return [(a, b, k, text[a:b]) for a, b, k in found]
    return [(first[a], last[b - 1], k, text[a:b]) for a, b, k in found]


_RUN = re.compile(f"[{THAI}]+|[{CJK}]+")
_PERIOD = re.compile(r"(?<!\S)[\"'“„«(]*([^\W\d_][^\s.]{0,5}(?:\.[^\s.]{1,5}){0,2})\.[ \n]+(\w)")
_CONTEXT_BEFORE, _CONTEXT_AFTER = re.compile(rf"(?:^|\n\s*\n|[.!?…{_WIDE}][”\"»’'）\)\]」』]*)\s*$"), re.compile(rf"\s*(?:$|\n\s*\n|[.!?…{_WIDE}])")


def _contexts(text: str):
    """(script, whether it opens, beginning or reversed end of a run, context) of the runs of a text; context 0: edge of a
    paragraph or terminator, 1: a number, 2: another gap."""
    for m in _RUN.finditer(text):
        run, script = m[0], "th" if m[0][0] <= "๿" else "cjk"
        before, after = text[max(0, m.start() - 8) : m.start()], text[m.end() : m.end() + 8]
        if m.start() <= 8 and not before.strip():
            before = ""
        yield script, True, run[:WORD], 0 if _CONTEXT_BEFORE.search(before) else 1 if before.rstrip()[-1:].isdigit() else 2
        yield script, False, run[: -WORD - 1 : -1], 0 if _CONTEXT_AFTER.match(after) else 1 if after.lstrip()[:1].isdigit() else 2


def learn(pages: DataFrame) -> Knowledge:
    """The knowledge of ``pages(text)``: everything is counted over all rows in Spark, and tables of bounded size return."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, bool, str], list[int]] = {}
        for text in b.column(0).to_pylist():
            for word, after in _PERIOD.findall(text):
                found.setdefault(("", True, word.lower()), [0, 0, 0])[0 if after.islower() or after.isdigit() else 2] += 1
            if _RUN.search(text):
                for script, opens, piece, context in _contexts(text):
                    for size in range(1, len(piece) + 1):
                        found.setdefault((script, opens, piece[:size]), [0, 0, 0])[context] += 1
        rows = [(*k, *v) for k, v in found.items()]
        return batch(list(zip(("script", "opens", "piece", "edge", "number", "gap"), (pa.string(), pa.bool_(), pa.string(), *[pa.int64()] * 3))), rows)

    schema = "script string, opens boolean, piece string, edge bigint, number bigint, gap bigint"
    sums = [F.sum(c).alias(c) for c in ("edge", "number", "gap")]
    counted = map_batches(pages.where("length(text) > 0").select("text"), run, schema, rows=4000).groupBy("script", "opens", "piece").agg(*sums).withColumn("n", F.col("edge") + F.col("number") + F.col("gap")).where(F.col("n") >= LEAST).checkpoint()
    short = counted.where((F.col("script") == "") & (F.col("n") >= LEAST_ABBREVIATION) & (F.col("edge") >= SHARE * F.col("n")))
    abbreviations = frozenset(r.piece for r in short.orderBy(F.desc("n"), "piece").limit(MOST_ABBREVIATIONS).collect())
    pieces = counted.where("script != ''")
    longer = pieces.where("length(piece) > 1").groupBy("script", "opens", F.expr("left(piece, length(piece) - 1)").alias("piece")).agg(F.count("*").alias("followers"), F.max("n").alias("first"))
    varied = (F.coalesce("first", F.lit(0)) < LEADING * F.col("n")) & ((F.coalesce("followers", F.lit(0)) >= VARIETY) | F.col("first").isNull())
    words = pieces.join(longer.hint("merge"), ["script", "opens", "piece"], "left").where(varied & ((F.col("script") != "th") | (F.length("piece") > 1)))
    rank = F.row_number().over(Window.partitionBy("script", "opens").orderBy(F.desc("n"), "piece"))
    opening, closing = {}, {}
    for r in words.withColumn("rank", rank).where(F.col("rank") <= MOST_WORDS).collect():
        (opening if r.opens else closing)[r.piece if r.opens else r.piece[::-1]] = (r.edge, r.number, r.gap)
    return Knowledge(opening, closing, abbreviations)


def sentences(df: DataFrame, know: Knowledge | None = None) -> DataFrame:
    """``df(record_id, text)`` to ``(record_id, n, start_at, end_at, kind, sentence)``; ``sentence`` as stored.

    ``know``: of ``learn``; without it, particles and the short lists alone.
    """
    known = know or _PLAIN_KNOWLEDGE
    shared = df.sparkSession.sparkContext.broadcast((known.opening, known.closing, known.abbreviations))  # at most four times MOST_WORDS words
    mark = uuid4().hex

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        own, rows = _loaded(mark, shared), []
        for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows += [(i, n, s, e, k, text[s:e]) for n, (s, e, k, _) in enumerate(units(text, own))]
        return batch(list(zip(("record_id", "n", "start_at", "end_at", "kind", "sentence"), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()))), rows)

    source = df.select(F.col("record_id").cast("bigint"), "text").where("text is not null")
    return map_batches(source, run, "record_id bigint, n int, start_at int, end_at int, kind string, sentence string")


_held: dict[str, Knowledge] = {}


def _loaded(mark: str, shared) -> Knowledge:
    """The worker's knowledge, put together once a Python worker."""
    if mark not in _held:
        _held.clear()
        _held[mark] = Knowledge(*shared.value)
    return _held[mark]
