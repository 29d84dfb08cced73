"""Text-layer health: sums of what each white-space word of a text is, judged by column expressions.

Every measure is a sum over words, and words repeat: an Arrow function looks each up in a bounded table and judges only new
ones. Ratios and verdicts are expressions over those sums, in 32-bit steps. Null text is judged as empty.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import chars
from . import script
from .tables import FUNCTION_WORDS, INNER_SYMBOLS


@dataclass(frozen=True)
class Thresholds:
    min_letters: int = 20
    max_visual_order: float = 0.03
    max_foreign: float = 0.02
    max_latin_gibberish: float = 0.5
    max_replacement: float = 0.01


#: What is counted in a text: letters by script, words with Sinhala or Tamil letters, signs out of order, such words with a
#: foreign character; outside markup the tokens of two Latin letters, those that are function words, those with odd symbols.
COUNTS = ("si", "ta", "latin", "words", "errors", "bad", "tokens", "function", "weird")
_KEPT_WORDS, _KEPT_CHARS = 400_000, 64


def _python(body: str) -> str:
    """A class body for Python's engine."""
    return re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), body)


_SI, _TA, _LATIN, _LETTERS = (re.compile(f"[{_python(x)}]") for x in (chars.SI, chars.TA, "A-Za-z", "A-Za-z"))
_SIGN = re.compile(f"(?<![{_python(chars.SI_CONSONANTS)}])[{_python(chars.SI_SIGNS)}]|(?<![{_python(chars.TA_CONSONANTS)}])[{_python(chars.TA_SIGNS)}]")
_JOINERS = re.compile(f"[{_python(chars.JOINERS)}]+")
_STRANGE = re.compile(f"[^{_python(chars.ALLOWED)}A-Za-z]")
_WEIRD = re.compile("[A-Za-z][" + "".join(map(re.escape, INNER_SYMBOLS)) + "][A-Za-z]|[\xa1-\xff]")
_NOT_LATIN = re.compile("[^A-Za-z]+")
_TAG = re.compile("<[^>]*(?:>|$)")
_MARKS = str.maketrans("*_#", "   ")
_WHITE_RUN = re.compile(f"[{re.escape(chars.WHITE)}]+")
#: What Python's own split takes for white space besides.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_FUNCTION = frozenset(w for w in FUNCTION_WORDS if len(w) > 1)


def _split(text: str) -> list[str]:
    return [x for x in _WHITE_RUN.split(text) if x] if _SEPARATORS.search(text) else text.split()


def _token(word: str) -> tuple[int, int, int]:
    """Whether a word counts as a Latin token, is a function word, holds odd symbols."""
    letters = _NOT_LATIN.sub("", word)
    return (1, int(letters.lower() in _FUNCTION), int(_WEIRD.search(word) is not None)) if len(letters) > 1 else (0, 0, 0)


def _word(word: str) -> tuple[int, ...]:
    """COUNTS of one word without tags."""
    si, ta, latin = len(_SI.findall(word)), len(_TA.findall(word)), len(_LATIN.findall(word))
    indic = si + ta > 0
    errors = len(_SIGN.findall(_JOINERS.sub("", word))) if indic else 0
    tokens = [_token(x) for x in word.translate(_MARKS).split()] if latin > 1 else []
    return (si, ta, latin, int(indic), errors, int(indic and _STRANGE.search(word) is not None), *(sum(t[k] for t in tokens) for k in range(3)))


class _Table(dict):
    """Numbers of known words, whose counts are rows of an array; forgotten when there are too many."""

    def __init__(self) -> None:
        self.rows = np.zeros((_KEPT_WORDS, len(COUNTS)), np.int64)

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.rows[number] = _word(word)
        return number

    def counts(self, text: str) -> np.ndarray:
        words = _split(text)
        if len(self) + len(words) > _KEPT_WORDS:
            self.clear()
        out = np.zeros(len(COUNTS), np.int64)
        if len(words) > _KEPT_WORDS or len(text) > _KEPT_CHARS * max(len(words), 1):  # more than fits, or very long words
            for w in words:
                out += _word(w)
            return out
        return out + self.rows[[self[w] for w in words]].sum(0)


_tables: list[_Table] = []


def count_words(texts: list[str | None]) -> np.ndarray:
    """COUNTS of each text, a row a text; null as empty."""
    if not _tables:
        _tables.append(_Table())
    table, out = _tables[0], np.zeros((len(texts), len(COUNTS)), np.int64)
    for k, text in enumerate(texts):
        if text:
            out[k] = table.counts(text)
            if "<" in text:  # tags may hold or join words: tokens are those of the text without them
                out[k, 6:] = table.counts(_TAG.sub("", text))[6:]
    return out


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def _counted(texts: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(c) for c in count_words(texts.to_pylist()).T], names=list(COUNTS))


def counts(text: Column) -> Column:
    """Struct of COUNTS."""
    return _counted(text)


def _float(c: Column | float) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("float")


def _ratio(part: Column, whole: Column) -> Column:
    return _float(F.when(whole == 0, F.lit(0.0)).otherwise(part / F.greatest(whole, F.lit(1))))


def visual_order_ratio(c: Column) -> Column:
    """Signs whose previous character, joiners aside, isn't a consonant of their script, for each Sinhala or Tamil word; from ``counts``."""
    return _ratio(c["errors"], c["words"])


def foreign_ratio(c: Column) -> Column:
    """Share of Sinhala and Tamil words with a character that neither they nor ASCII text have; from ``counts``."""
    return _ratio(c["bad"], c["words"])


def strip_markup(text: Column) -> Column:
    """Without tags (an open tag drops the rest), emphasis and heading marks as spaces."""
    return F.translate(F.regexp_replace(text, "<[^>]*(?:>|$)", ""), "*_#", "   ")


def latin_gibberish_score(c: Column) -> Column:
    """0 for plausible English to 1 for legacy-font text, in 32-bit steps; 0 below 30 tokens; from ``counts``."""
    n = F.greatest(c["tokens"], F.lit(1))
    unit = lambda x: F.greatest(F.least(x, _float(1.0)), _float(0.0))
    lack = unit(_float(_float(1.0) - _float(_float(c["function"] / n) / _float(0.15))))
    symbols = unit(_float(_float(c["weird"] / n) / _float(0.15)))
    return F.when(c["tokens"] < 30, _float(0.0)).otherwise(_float(lack * symbols))


def replacement_share(text: Column) -> Column:
    lost = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    return _float(lost / F.greatest(F.length(text), F.lit(1)))


def _reasons(m: dict[str, Column], expected: Column | None, t: Thresholds) -> Column:
    counts = m["letters"]
    wrong = F.lit(False)
    if expected is not None:
        own = F.when(expected == "si", script.share(counts, "si")).when(expected == "ta", script.share(counts, "ta"))
        wrong = F.coalesce((script.letters(counts) >= 100) & (own < _float(0.2)) & (script.share(counts, "latin") > _float(0.6)), F.lit(False))
    return F.array_compact(
        F.array(
            F.when(m["replacement"] > _float(t.max_replacement), "replacement_chars"),
            F.when(m["visual_order"] > _float(t.max_visual_order), "visual_order"),
            F.when(m["foreign"] > _float(t.max_foreign), "foreign_code_points"),
            F.when(m["latin_gibberish"] >= _float(t.max_latin_gibberish), "latin_gibberish"),
            F.when(wrong, "wrong_script"),
        )
    )


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, each computed exactly once a row: a one-row generator keeps the optimizer from copying them into every use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def assessed(df: DataFrame, text: str, name: str = "h", expected: Column | None = None, t: Thresholds = Thresholds(), flat_columns: bool = False) -> DataFrame:
    """Add struct ``name`` of letters, measures, ``verdict`` (healthy, empty, broken) and ``reasons`` in a fixed order.

    ``flat_columns``: columns ``name_...`` instead; further generators must not read struct fields from below them.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    c, indic = F.col(f"_{name}"), F.col(f"_{name}.si") + F.col(f"_{name}.ta")
    latin = F.col(f"_{name}.latin")
    gated = lambda test, m: F.when(test, m).otherwise(_float(0.0))
    measures = {"visual_order": gated(indic >= 50, visual_order_ratio(c)), "foreign": gated(indic >= 50, foreign_ratio(c)), "latin_gibberish": gated(latin >= 100, latin_gibberish_score(c)), "replacement": replacement_share(body)}
    d = df.withColumn(f"_{name}", counts(body))
    d = once(d, **{f"_{name}_{k}": m for k, m in measures.items()})
    letters = F.struct(*[c[x].alias(x) for x in ("si", "ta", "latin")])
    m = {"letters": letters} | {k: F.col(f"_{name}_{k}") for k in measures}
    d = once(d, **{f"_{name}_reasons": _reasons(m, expected, t)})
    reasons = F.col(f"_{name}_reasons")
    verdict = F.when(F.size(reasons) > 0, "broken").when(indic + latin < t.min_letters, "empty").otherwise("healthy")
    own = {x: c[x] for x in ("si", "ta", "latin")} | {k: F.col(f"_{name}_{k}") for k in measures} | {"verdict": verdict, "reasons": reasons}
    gone = [f"_{name}", f"_{name}_reasons", *(f"_{name}_{k}" for k in measures)]
    if flat_columns:
        return d.withColumns({f"{name}_{k}": v for k, v in own.items()}).drop(*gone)
    return d.withColumn(name, F.struct(letters.alias("letters"), *[v.alias(k) for k, v in own.items() if k not in ("si", "ta", "latin")])).drop(*gone)


def script_hint(h: Column) -> Column:
    """Languages that a broken text layer implies, from its ``assessed`` struct; none for legacy-font or Latin-only text."""
    n = h["letters"]
    langs = F.filter(script.languages(n, 0.03, 50), lambda x: F.when(x == "si", n["si"]).when(x == "ta", n["ta"]).otherwise(n["latin"]) >= 30)
    none = F.array().cast("array<string>")
    return F.when((h["latin_gibberish"] >= _float(0.5)) | ~F.exists(langs, lambda x: x != "en"), none).otherwise(langs)
