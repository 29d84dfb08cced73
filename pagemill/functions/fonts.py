"""Legacy font families from PDF font names, as one CASE over a table of prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tables import FONT_FAMILIES, LATIN_FONTS


def normal_name(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "^[A-Z]{6}\\+", ""), "[^A-Za-z0-9]", ""))


def legacy_font(name: Column) -> Column:
    """Struct ``family, lang`` or null; the first prefix of the table wins, then the TAM- and TAB- families."""
    none = F.lit(None).cast("struct<family:string,lang:string>")
    pair = lambda family, lang: F.struct(F.lit(family).alias("family"), F.lit(lang).alias("lang"))
    tail = F.upper(F.regexp_replace(name, "^[^+]*\\+", ""))
    other = F.when(tail.rlike("^TA[MB]-"), pair("tam-tab", "ta")).otherwise(none)

    def first(n: Column) -> Column:
        known = other
        for prefix, family, lang in reversed(FONT_FAMILIES):
            known = F.when(n.startswith(prefix), pair(family, lang)).otherwise(known)
        return known

    # The lambda binds the normalised name, so that it is computed once and not for each prefix.
    return F.get(F.transform(F.array(normal_name(name)), first), 0)


def is_prior_ocr(name: Column) -> Column:
    n = normal_name(name)
    return n.contains("glyphlessfont") | n.contains("hiddenhorzocr")


def is_unnamed_truetype(name: Column) -> Column:
    return normal_name(name).startswith("mstt31")


def has_latin(fonts: Column) -> Column:
    return F.coalesce(F.exists(fonts, lambda f: F.lower(f).rlike("|".join(LATIN_FONTS))), F.lit(False))
