"""Problem 5: repair text of scanned pages into continuous readable paragraphs.

* Running heads, feet and page numbers are edge lines of a known shape, or edge lines that other pages of the file repeat.
* Word counts of the collection give, for each language, a dictionary of all words counted often enough, names apart. A
  rarer word is joined in SQL, by a shuffle, to the dictionary words from which its anagram value differs by that of one or
  two confusions; candidates are checked, ranked by confusions and frequency, and the best is the correction. How much
  commoner the dictionary word must be depends on the confidences with which the rare one was read.
* Languages of Latin script are told apart by their commonest words, learned from labelled pages where there are any.
  Languages without a table of confusions get theirs from the collection: exchanges of one letter that many pairs of a
  rare and a frequent word show.
* A word broken at a line end is joined unless the compound with the mark is itself a word of the dictionary.

Defined results: null and blank texts give no lines; a repeated delivery counts once; unknown confidences, and lists of
confidences that don't fit the text, change nothing; numbers are never corrected. Scripts without spaces between words
(Thai, Chinese, Japanese) have furniture only: their lines hold no words that a line end could break.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.deliveries import once
from .common import batch, map_batches

# Usual misreadings of scanned letters, as read and as printed, by script.
MISREADINGS = {
    "latin": [("c", "e"), ("l", "i"), ("1", "l"), ("5", "s"), ("0", "o"), ("f", "t"), ("n", "u"), ("u", "n"), ("b", "h"), ("cl", "d"), ("d", "cl"), ("rn", "m"), ("m", "rn"), ("q", "g"), ("vv", "w"), ("ii", "ü"), ("ê", "é"), ("a", "ä"), ("o", "ö"), ("u", "ü"), ("è", "é"), ("e", "é"), ("B", "ß"), ("b", "ß"), ("i", "l"), ("I", "l"), ("l", "I"), ("8", "B"), ("O", "0")],
    "ta": [("ந", "த"), ("சு", "க"), ("ீ", "ி"), ("ா", "ர"), ("ய", "ப"), ("ன", "ை"), ("ழ", "ம"), ("வ", "ல"), ("ள", "ன"), ("ன", "ள")],
    "si": [("ශ", "ය"), ("ෘ", "ා"), ("ී", "ි"), ("ච", "ව"), ("ස", "ප"), ("ථ", "ර"), ("න", "ක"), ("ළ", "ල"), ("හ", "ග"), ("ව", "ම"), ("ූ", "ු"), ("ඳ", "ද")],
}
#: Words that tell the Latin-script languages apart.
STOP_WORDS = {"en": frozenset("the of and to was by is in for it not".split()), "fr": frozenset("le la les de du et un une pas été au".split()), "de": frozenset("der die das und hat wurde für aus sind den in".split())}
#: Least count of a dictionary word. A word of ``CAPITALS`` languages that is hardly written in lower case, and with a capital inside sentences in at least PROPER of its places, is a name, unless it has NAME_SHARE of the language's words (months).
LEAST_COUNT, NAME_SHARE, PROPER = 5, 1 / 1200, 1 / 4
CAPITALS = ("en", "fr")
#: Words of this share are looked up where they are read, all others by a join.
SHARE = 1 / 8000
#: Mean confidence below which a word is suspect and above which it is sure, and what either does to the ratio below.
SUSPECT, SURE, SUSPECT_FACTOR, SURE_FACTOR = 60.0, 96.0, 0.5, 2.0
#: Bounds of what is learned: words that tell a language, languages, confusions of all languages without a table. Share of a
#: word that its language must have; pairs of words that a confusion needs, of words of at least so many letters.
TELLING_WORDS, MOST_LANGUAGES, MOST_CONFUSIONS, OWN_SHARE, CONFUSED_PAIRS, CONFUSED_LETTERS = 40, 64, 2000, 0.6, 5, 5
#: How much commoner than the rare word its correction must be; for words of two letters.
RATIO, RATIO_SHORT = 12, 60
MARKS = "-‐\xad¬"

_PLAIN_WORD = re.compile("[a-zß-ɏ]{1,12}")
_EDGE_PUNCT = "\"“”„«»‘'()[]{}.,;:!?…|*#—–"
_TOKEN = re.compile(r"\S+")
_DATE = r"[\diIlO'.,]{1,3}[.,'1i][\diIlO'.,]{1,3}[.,'1i][\diIlO'.]{3,4}"
_HEAD = re.compile(rf"^.{{3,100}}[—–'.-]\s?{_DATE}(?:\s+.{{1,14}})?$")
_FOOT = re.compile(r"^[^\d\s]\S*(?:\s\S+){0,4}?\s?\S?[\dilIO.'’]{1,3}/[\dilIO.'’]{2,4}$|^[^\d\s]\S*(?:\s\S+){1,4}\s\d{1,2}[.1il'’]\d{3}$")
_NUMBER = re.compile(r"^[\[(—–|-]*\s?(?:\d{1,4}|[ivxlcIl]{1,8})\s?[\])—–|-]*$|^[^\W\d_]\S{2,9}\s[\dilI]{1,4}(?:\s?/\s?[\dilI]{1,4})?$")
_SCRIPTS = (("si", re.compile("[඀-෿]")), ("ta", re.compile("[஀-௿]")), ("latin", re.compile("[A-Za-zÀ-ɏ]")), ("hi", re.compile("[ऀ-ॿ]")), ("", re.compile("[฀-๿぀-ヿ㐀-䶿一-鿿]")), ("other", re.compile(r"[^\W\d_]")))
EDGE = 4
#: What the word before the first word of a sentence ends with, closing marks apart.
_ENDS, _CLOSING = frozenset(".!?…:;"), "\"”»“’')]"


def furniture(lines: list[str]) -> tuple[set[int], list[int]]:
    """Line numbers of the edge lines of a furniture shape, and those of the other edge lines."""
    filled = [k for k, x in enumerate(lines) if x.strip()]
    found: set[int] = set()
    rest: list[int] = []
    for place, k in enumerate(filled):
        top, bottom = place, len(filled) - 1 - place
        if top >= EDGE and bottom >= 2:
            continue
        x = lines[k].strip()
        clean_above = all(j in found for j in filled[:place])
        clean_below = bottom == 0
        if (_HEAD.match(x) and (top < 3 or bottom < 2)) or (_FOOT.match(x) and len(x.split()) <= 5 and (top < EDGE or bottom < 2)) or (_NUMBER.match(x) and (clean_above or clean_below)):
            found.add(k)
        elif top < 2 or bottom < 2:
            rest.append(k)
    # A page number above a foot, or a foot above a page number: the inner one is an edge once the outer is gone.
    left = [k for k in filled if k not in found]
    if left and _NUMBER.match(lines[left[-1]].strip()) and left[-1] != filled[-1] and all(k in found for k in filled if k > left[-1]):
        found.add(left[-1])
    return found, [k for k in rest if k not in found]


@lru_cache(200_000)
def _script(word: str) -> str | None:
    return next((name for name, p in _SCRIPTS if p.search(word)), None) or None


def _telling(words: dict[str, frozenset[str]]) -> dict[str, tuple[str, ...]]:
    return {w: tuple(lang for lang, own in words.items() if w in own) for own in words.values() for w in own}


_STOPS = _telling(STOP_WORDS)
_LATIN = _SCRIPTS[2][1]


def _latin(text: str, otherwise: str, stops: dict[str, tuple[str, ...]]) -> str:
    """The language with most telling words in ``text``; ``otherwise`` without any, and of equals."""
    if not _LATIN.search(text):
        return otherwise
    found = Counter(lang for w in text.split() for lang in stops.get(w.lower(), ()))
    return max(found, key=lambda lang: (found[lang], lang == otherwise, lang), default=otherwise)


def telling_words(pages: DataFrame) -> dict[str, frozenset[str]]:
    """The commonest words of each Latin-script language that are mostly its own, from ``pages(langs, text)`` with one label.

    Counted over all pages in Spark; at most MOST_LANGUAGES times TELLING_WORDS return. They go beside those of
    STOP_WORDS.
    """

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        n: Counter = Counter()
        for lang, text in zip(*(c.to_pylist() for c in b.columns)):
            if len(_LATIN.findall(text)) * 2 > len(text):
                n.update((lang, w) for w in text.lower().split() if _PLAIN_WORD.fullmatch(w))
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["lang", "word", "n"])

    labelled = pages.where("size(langs) = 1 and length(text) > 0").select(F.element_at("langs", 1).alias("lang"), "text").where("lang is not null")
    counted = map_batches(labelled, run, "lang string, word string, n bigint", rows=4000).groupBy("lang", "word").agg(F.sum("n").alias("n"))
    # Shares of a language's words are compared, so that a large language doesn't own the words of a small one.
    share = counted.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    own = share.withColumn("own", F.col("share") / F.sum("share").over(Window.partitionBy("word"))).where((F.col("own") >= OWN_SHARE) & (F.col("n") >= LEAST_COUNT))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    found: dict[str, set[str]] = {}
    for r in own.withColumn("rank", rank).where(F.col("rank") <= TELLING_WORDS).orderBy("rank", "lang").limit(MOST_LANGUAGES * TELLING_WORDS).collect():
        found.setdefault(r.lang, set()).add(r.word)
    return {lang: STOP_WORDS.get(lang, frozenset()) | found.get(lang, frozenset()) for lang in {**STOP_WORDS, **found}}


class _PageWords:
    """Words of a page with their lines; a word broken over two lines is one word."""

    def __init__(self, text: str, stops: dict[str, tuple[str, ...]] = _STOPS, confs: list[float | None] | None = None):
        self.lines = text.split("\n")
        self.furniture, self.rest = furniture(self.lines)
        whole, latins, first = _latin(text, "en", stops), {}, 0
        for k in range(len(self.lines) + 1):  # a page may hold blocks of other languages
            if k == len(self.lines) or not self.lines[k].strip():
                if k > first:
                    own = _latin("\n".join(self.lines[first:k]), whole, stops)
                    if own != whole:
                        latins |= dict.fromkeys(range(first, k), own)
                first = k + 1
        # language, word, line, length of the part before the break or -1, mark, whether it has a capital inside a sentence, least confidence
        self.words: list[tuple[str, str, int, int, str, bool, float | None]] = []
        found = [_TOKEN.findall(x) for x in self.lines]
        starts = list(accumulate(map(len, found), initial=0))
        known = confs if confs and len(confs) == starts[-1] else [None] * starts[-1]
        tokens = {k: x for k, x in enumerate(found) if x and k not in self.furniture}
        used: set[int] = set()  # lines whose first token ends a word of the line above
        before = "."
        for k, own in tokens.items():
            latin = latins.get(k, whole)
            if k - 1 not in tokens:
                before = "."
            for n, t in enumerate(own):
                proper = t[0].isupper() and before.rstrip(_CLOSING)[-1:] not in _ENDS
                before = t
                if n == 0 and k in used:
                    continue
                if n == len(own) - 1 and t[-1] in MARKS and len(t) > 1 and _letter_or_mark(t[-2]) and k + 1 in tokens:
                    after = tokens[k + 1][0]
                    if _letter_or_mark(after[0]):
                        used.add(k + 1)
                        head, tail = t[:-1].lstrip(_EDGE_PUNCT), after.rstrip(_EDGE_PUNCT)
                        parts = [c for c in (known[starts[k] + n], known[starts[k + 1]]) if c is not None]
                        self._add(latin, head + tail, k, len(head), t[-1], proper, min(parts, default=None))
                        continue
                self._add(latin, t.strip(_EDGE_PUNCT), k, -1, "", proper, known[starts[k] + n])

    def _add(self, latin: str, word: str, line: int, cut: int, mark: str, proper: bool, conf: float | None) -> None:
        s = _script(word)
        if s and len(word) > 1:
            self.words.append((latin if s == "latin" else s, word, line, cut, mark, proper, conf))


def _letter_or_mark(c: str) -> bool:
    return c.isalpha() or "ऀ" <= c <= "෿" or c == "‍"


def _fold(word: str) -> str:
    return word.lower()


def counts(pages: DataFrame, stops: dict[str, tuple[str, ...]] = _STOPS) -> DataFrame:
    """Counts of words outside furniture: ``(lang, word, n, lower, proper, conf)``; ``word`` in lower case, ``lower``: how often
    it was written so, ``proper``: how often with a capital inside a sentence, ``conf``: the mean confidence where known."""
    names = ["lang", "word", "n", "lower", "proper", "conf_sum", "conf_n"]

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[tuple[str, str], list] = {}
        for text, confs in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for lang, word, _, _, mark, proper, conf in _PageWords(text, stops, confs).words:
                if mark != "-":  # whether that mark belongs to the word isn't known yet
                    low = _fold(word)
                    own = found.setdefault((lang, low), [0, 0, 0, 0.0, 0])
                    own[0] += 1
                    own[1] += word[0] == low[0]
                    own[2] += proper
                    if conf is not None:
                        own[3] += conf
                        own[4] += 1
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64())
        return batch(list(zip(names, kinds)), [(*k, *v) for k, v in found.items()])

    rows = map_batches(pages.select("text", "confs"), run, "lang string, word string, n bigint, lower bigint, proper bigint, conf_sum double, conf_n bigint", rows=4000)
    return rows.groupBy("lang", "word").agg(*[F.sum(c).alias(c) for c in names[2:]]).select("lang", "word", "n", "lower", "proper", F.try_divide("conf_sum", "conf_n").alias("conf"))


#: Anagram value of a word: fifth powers of its characters, added up; equal for anagrams, so that a confusion adds a constant.
VALUE = "aggregate(split({0}, ''), 0L, (a, c) -> a + cast(power(ascii(c) % 256 + 1, 5) as bigint))"


def _value(text: str) -> int:
    return sum((ord(c) % 256 + 1) ** 5 for c in text)


def learned_confusions(counted: DataFrame) -> list[tuple[str, str, str]]:
    """``(lang, read, print)`` of the languages without a table: one letter for another, as many pairs of a rare word and a
    RATIO times commoner one show. Words meet in a join on what is left of them without one letter."""
    words = counted.where(~F.col("lang").isin(*STOP_WORDS, *MISREADINGS) & (F.length("word") >= CONFUSED_LETTERS))
    places = words.select("lang", "word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("i"))
    keyed = places.select("lang", "word", "n", F.expr("substr(word, i, 1)").alias("letter"), F.expr("concat(left(word, i - 1), '\n', substr(word, i + 1))").alias("rest"))
    often = keyed.where(F.col("n") >= RATIO).select("lang", "rest", F.col("letter").alias("print"), F.col("n").alias("often"), F.col("word").alias("fixed"))
    pairs = keyed.join(often, ["lang", "rest"]).where((F.col("letter") != F.col("print")) & (F.col("often") >= RATIO * F.col("n")))
    seen = pairs.groupBy("lang", F.col("letter").alias("read"), "print").agg(F.count_distinct("word", "fixed").alias("pairs")).where(F.col("pairs") >= CONFUSED_PAIRS)
    return [(r.lang, r.read, r["print"]) for r in seen.orderBy(F.desc("pairs"), "lang", "read", "print").limit(MOST_CONFUSIONS).collect()]


def _confusions(spark: SparkSession, learned: list[tuple[str, str, str]], latins: list[str]) -> DataFrame:
    """One and two confusions by language: ``(lang, read1, read2, print1, print2, delta, steps, reach)``; learned ones one at a time."""
    rows = [(lang, r, "", p, "", _value(p) - _value(r), 1, 1) for lang, r, p in learned]
    for script, pairs in MISREADINGS.items():
        for lang in latins if script == "latin" else (script,):
            one = [(r, "", p, "", _value(p) - _value(r), 1, max(len(r), len(p))) for r, p in pairs]
            two = [(a[0], b[0], a[2], b[2], a[4] + b[4], 2, a[6] + b[6]) for i, a in enumerate(one) for b in one[i:]]
            rows += [(lang, *x) for x in one + two]
    return spark.createDataFrame(rows, "lang string, read1 string, read2 string, print1 string, print2 string, delta bigint, steps int, reach int")


def dictionary(counted: DataFrame) -> DataFrame:
    """Words counted often enough, names apart: ``(lang, word, n, share)``; ``share`` of their language's words."""
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    name = F.col("lang").isin(*CAPITALS) & (F.col("lower") < 0.1 * F.col("n")) & (F.col("proper") >= PROPER * F.col("n"))
    shared = counted.join(F.broadcast(totals), "lang").withColumn("share", F.col("n") / F.col("total"))
    return shared.where((F.col("n") >= LEAST_COUNT) & (F.length("word") > 1) & (~name | (F.col("share") >= NAME_SHARE))).select("lang", "word", "n", "share")


def corrections(spark: SparkSession, counted: DataFrame, words: DataFrame, latins: tuple[str, ...] = tuple(STOP_WORDS)) -> DataFrame:
    """The best correction of each rare word: ``(lang, word, fixed)``; ``latins``: the languages of Latin script.

    The confusions are undone from the dictionary's side, which has fewer words: only those of at least RATIO places can be
    RATIO times as common as another. Both sides of the join are shuffled.
    """
    rules = F.broadcast(_confusions(spark, learned_confusions(counted), sorted({*latins, *STOP_WORDS})))
    known = words.where(F.col("n") >= SUSPECT_FACTOR * min(RATIO, RATIO_SHORT)).select("lang", F.col("word").alias("fixed"), F.col("n").alias("often"), F.expr(VALUE.format("word")).alias("whole"))
    spoilt = known.join(rules, "lang").where("contains(fixed, print1) and contains(fixed, print2)").select("lang", "fixed", "often", "read1", "read2", "steps", "reach", (F.col("whole") - F.col("delta")).alias("value"))
    least = F.when(F.col("lang").isin("si", "ta", "hi"), 2).otherwise(1)
    conf = F.col("conf") if "conf" in counted.columns else F.lit(None).cast("double")
    rare = counted.where(F.length("word") > least).select("lang", "word", "n", conf.alias("conf"), F.expr(VALUE.format("word")).alias("value"))
    trust = F.when(F.col("conf") < SUSPECT, SUSPECT_FACTOR).when(F.col("conf") > SURE, SURE_FACTOR).otherwise(1.0)
    ratio = F.col("often") >= F.when(F.length("word") > 2, RATIO).otherwise(RATIO_SHORT) * trust * F.col("n")
    fits = rare.join(spoilt, ["lang", "value"]).where(ratio & F.expr("contains(word, read1) and contains(word, read2)") & (F.levenshtein("word", "fixed") <= F.col("reach")) & ((F.col("steps") == 1) | (F.length("fixed") > 4)))
    best = Window.partitionBy("lang", "word").orderBy("steps", F.desc("often"), "fixed")
    fixes = fits.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("lang", "word", "fixed").checkpoint()
    # A frequent misreading is in the dictionary as well: what it is corrected to takes its place. Each link is RATIO times as common, so this ends.
    while True:
        further = fixes.select("lang", F.col("word").alias("fixed"), F.col("fixed").alias("last"))
        if fixes.join(further, ["lang", "fixed"], "left_semi").isEmpty():
            return fixes
        fixes = fixes.join(further, ["lang", "fixed"], "left").select("lang", "word", F.coalesce("last", "fixed").alias("fixed")).checkpoint()


class Findings:
    """Steps that share the counted words of one collection of scanned pages ``(ocr_id, doc, text)``, with their confidences
    in a column ``confs`` where known; ``labelled``: pages ``(langs, text)`` from which languages of Latin script are told."""

    def __init__(self, spark: SparkSession, pages: DataFrame, labelled: DataFrame | None = None):
        self.spark = spark
        confs = F.col("confs") if "confs" in pages.columns else F.lit(None).cast("array<float>")
        self.pages = once(pages.where("length(trim(text)) > 0").select(F.col("ocr_id").cast("bigint"), "doc", "text", confs.alias("confs")), "ocr_id")
        words = STOP_WORDS if labelled is None else telling_words(labelled)
        self.stops = _telling(words)
        self.counted = counts(self.pages, self.stops).checkpoint()
        self.words = dictionary(self.counted)
        self.fixes = corrections(spark, self.counted, self.words, tuple(words))

    def _places(self) -> DataFrame:
        """Furniture and hyphens by shape, other edge lines, and words that may have a correction with their places."""
        # Bounded by 1 / SHARE words a language, and only a short way for the commonest: words not held are joined.
        often = self.words.where(F.col("share") >= SHARE).join(self.fixes, ["lang", "word"], "left_anti")
        held = frozenset((r.lang, r.word) for r in often.select("lang", "word").toLocalIterator())

        stops = self.stops

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for i, doc, text in zip(*(c.to_pylist() for c in b.columns)):
                page = _PageWords(text, stops)
                rows += [(i, k, "furniture", None, None, -1, doc, None) for k in page.furniture]
                rows += [(i, k, "edge", None, re.sub(r"[\W\d_]+", " ", page.lines[k]).strip(), -1, doc, None) for k in page.rest if not re.search(r"[.!?।]$", page.lines[k]) and len(page.lines[k].split()) > 1]
                for lang, word, line, cut, mark, _, _ in page.words:
                    low, compound = _fold(word), None
                    if cut >= 0:
                        compound = f"{low[:cut]}-{low[cut:]}" if mark == "-" else None
                        if (lang, compound) in held:
                            continue
                        rows.append((i, line, "hyphen", lang, low, cut, doc, compound))
                    if (lang, low) not in held:
                        rows.append((i, line, "word", lang, low, cut, doc, compound))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ocr_id", "line_no", "kind", "lang", "word", "cut", "doc", "compound"])

        places = map_batches(self.pages.select("ocr_id", "doc", "text"), run, "ocr_id bigint, line_no int, kind string, lang string, word string, cut int, doc string, compound string").checkpoint()
        compounds = self.counted.where((F.col("n") >= LEAST_COUNT) & F.contains("word", F.lit("-"))).select("lang", F.col("word").alias("compound"))
        return places.where("compound is null").unionByName(places.where("compound is not null").join(compounds, ["lang", "compound"], "left_anti").select(*places.columns)).drop("compound")

    def found(self) -> DataFrame:
        """``(ocr_id, line_no, kind)`` with the misread word and its correction: ``word, fixed``."""
        places = self._places()
        nothing = F.lit(None).cast("string")
        shaped = places.where("kind in ('furniture', 'hyphen')").select("ocr_id", "line_no", "kind", F.when(F.col("kind") == "hyphen", F.col("word")).alias("word"), nothing.alias("fixed"))
        edges = places.where("kind = 'edge' and length(word) > 3")
        again = edges.groupBy("doc", "word").agg(F.min("ocr_id").alias("a"), F.max("ocr_id").alias("z")).where("a < z").select("doc", "word")
        repeated = edges.join(again, ["doc", "word"], "left_semi").select("ocr_id", "line_no", F.lit("furniture").alias("kind"), nothing.alias("word"), nothing.alias("fixed"))
        read = places.where("kind = 'word'").join(self.fixes, ["lang", "word"])
        # Of a broken word, the lines whose part holds a difference.
        first = F.expr("coalesce(array_min(filter(sequence(1, length(word)), i -> substr(word, i, 1) != substr(fixed, i, 1))), length(word)) - 1")
        last = F.expr("length(word) - coalesce(array_min(filter(sequence(1, length(word)), i -> substr(word, length(word) - i + 1, 1) != substr(fixed, length(fixed) - i + 1, 1))), length(word)) + 1")
        spread = read.withColumn("first", first).withColumn("last", last)
        lines = F.when(F.col("cut") < 0, F.array("line_no")).otherwise(F.array_compact(F.array(F.when(F.col("first") < F.col("cut"), F.col("line_no")), F.when(F.col("last") > F.col("cut"), F.col("line_no") + 1))))
        misread = spread.select("ocr_id", F.explode(lines).alias("line_no"), F.lit("misread").alias("kind"), "word", "fixed").join(repeated.select("ocr_id", "line_no"), ["ocr_id", "line_no"], "left_anti")
        return shaped.unionByName(repeated).unionByName(misread.select("ocr_id", "line_no", "kind", "word", "fixed")).distinct()


def _cased(word: str, fixed: str) -> str:
    return fixed.upper() if word.isupper() and len(word) > 1 else fixed[:1].upper() + fixed[1:] if word[:1].isupper() else fixed


def repaired(text: str, found: list[tuple[int, str, str | None, str | None]]) -> str:
    """The page as paragraphs: furniture gone, broken words joined, misread words replaced, lines joined by spaces."""
    lines = text.split("\n")
    gone = {k for k, kind, _, _ in found if kind == "furniture"}
    broken = {k for k, kind, _, _ in found if kind == "hyphen"}
    fixes = {w: f for _, kind, w, f in found if kind == "misread"}
    paragraphs: list[str] = [""]
    glue = ""
    for k, line in enumerate(lines):
        if k in gone:
            continue
        x = line.strip()
        if not x:
            if paragraphs[-1]:
                paragraphs.append("")
            glue = ""
            continue
        paragraphs[-1] += (glue if paragraphs[-1] else "") + (x[:-1] if k in broken else x)
        glue = "" if k in broken else "" if x[-1] in MARKS else " "
    out = []
    for p in paragraphs:
        if p:
            out.append(_TOKEN.sub(lambda m: _mend(m[0], fixes), p))
    return "\n\n".join(out)


def _mend(token: str, fixes: dict[str, str]) -> str:
    core = token.strip(_EDGE_PUNCT)
    fixed = fixes.get(_fold(core)) if core else None
    return token.replace(core, _cased(core, fixed), 1) if fixed else token


def paragraphs(findings: Findings) -> DataFrame:
    """``(ocr_id, text)`` of every page with text, repaired."""
    per_page = findings.found().groupBy("ocr_id").agg(F.collect_list(F.struct("line_no", "kind", "word", "fixed")).alias("found"))  # bounded by the page's words
    joined = findings.pages.join(per_page, "ocr_id", "left").select("ocr_id", "text", "found")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [repaired(t, [(x["line_no"], x["kind"], x["word"], x["fixed"]) for x in f or []]) for t, f in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["ocr_id", "text"])

    return map_batches(joined, run, "ocr_id bigint, text string")
