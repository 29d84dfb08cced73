"""Letters by script, language selection and language names. Columns only: everything stays in generated code.

Null text counts as no letters.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import chars

# Languages in order of precedence, their OCR names and spellings.
LANGS = ("si", "ta", "en")
TESSERACT = {"si": "sin", "ta": "tam", "en": "eng"}
SPELLINGS = {"si": "si sin sinhala", "ta": "ta tam tamil", "en": "en eng english"}


def count_of(text: Column, members: str) -> Column:
    """Characters of a class: what is gone when its runs are removed, which takes far fewer matches than counting them."""
    return F.coalesce(F.length(text) - F.length(F.regexp_replace(text, f"[{members}]+", "")), F.lit(0)).cast("bigint")


def script_counts(text: Column) -> Column:
    """Struct ``si, ta, latin`` of letter counts; dependent signs count, joiners don't."""
    return F.struct(count_of(text, chars.SI).alias("si"), count_of(text, chars.TA).alias("ta"), count_of(text, chars.LATIN).alias("latin"))


def letters(counts: Column) -> Column:
    return counts["si"] + counts["ta"] + counts["latin"]


def share(counts: Column, field: str) -> Column:
    """Share of a script as a 32-bit float; 0 without letters."""
    return (counts[field] / F.greatest(letters(counts), F.lit(1))).cast("float")


def languages(counts: Column, min_share: float, min_letters: int) -> Column:
    """Languages with at least ``min_share`` of the letters, most letters first, ties in the order of LANGS; none below ``min_letters``."""
    rows = F.array(*[F.struct((-counts[f]).alias("n"), F.lit(i).alias("prio"), F.lit(lang).alias("lang"), share(counts, f).alias("share")) for i, (lang, f) in enumerate(zip(LANGS, ("si", "ta", "latin")))])
    kept = F.filter(rows, lambda r: (r["share"] >= F.lit(min_share).cast("float")) & (r["n"] < 0))
    return F.when(letters(counts) < min_letters, F.array().cast("array<string>")).otherwise(F.transform(F.array_sort(kept), lambda r: r["lang"]))


def probed(counts: Column) -> Column:
    """Languages of a trial recognition: a twelfth of at least 20 letters (8 %), and 15 letters of their own."""
    own = lambda x: F.when(x == "si", counts["si"]).when(x == "ta", counts["ta"]).otherwise(counts["latin"])
    return F.filter(languages(counts, 0.08, 20), lambda x: own(x) >= 15)


def dominant(counts: Column) -> Column:
    """The language with most letters; of equals the last of LANGS; null without letters."""
    most = F.greatest(counts["si"], counts["ta"], counts["latin"])
    return F.when(most == 0, F.lit(None)).when(counts["latin"] == most, "en").when(counts["ta"] == most, "ta").otherwise("si")


def parse_lang(name: Column) -> Column:
    low = F.lower(F.trim(name))
    out = F.lit(None).cast("string")
    for code, spellings in SPELLINGS.items():
        out = F.when(low.isin(*spellings.split()), code).otherwise(out)
    return out


def lang_arg(langs: Column) -> Column:
    """OCR language argument: distinct languages in order of LANGS, joined by +; English for none."""
    kept = F.array(*[F.when(F.array_contains(langs, x), TESSERACT[x]) for x in LANGS])
    joined = F.array_join(F.array_compact(kept), "+")
    return F.when(F.coalesce(joined, F.lit("")) == "", "eng").otherwise(joined)


def sum_counts(counts: Column) -> Column:
    """Aggregate of ``script_counts`` over rows: counts of joined texts are sums, since separators have no letters."""
    return F.struct(F.coalesce(F.sum(counts["si"]), F.lit(0)).alias("si"), F.coalesce(F.sum(counts["ta"]), F.lit(0)).alias("ta"), F.coalesce(F.sum(counts["latin"]), F.lit(0)).alias("latin"))
