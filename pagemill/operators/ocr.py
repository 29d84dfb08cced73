"""Recognised words back to pages: TSV rows, paragraphs, confidences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import chars
from ..functions import fonts, normalize, render

TSV = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left int, top int, width int, height int, conf float, text string"


def parse_tsv(lines: DataFrame) -> DataFrame:
    """Lines ``(doc, value)`` of twelve tab-separated columns to word rows; headers, other levels and blank words are dropped.

    Numbers that don't parse are 0, pages are at least 1, a confidence that doesn't parse is null.
    """
    cell = lambda i, kind: F.expr(f"try_cast(get(split(value, '\t'), {i}) as {kind})")
    number = lambda i: F.greatest(F.coalesce(cell(i, "int"), F.lit(0)), F.lit(0))
    return (
        lines.where((F.size(F.split("value", "\t")) >= 12) & (F.get(F.split("value", "\t"), 0) == "5"))
        .select("doc", F.greatest(number(1), F.lit(1)).alias("page"), number(2).alias("block"), number(3).alias("par"), number(4).alias("line"), number(5).alias("word_no"), cell(10, "float").alias("conf"), render.trim(F.get(F.split("value", "\t"), 11)).alias("text"))
        .where("text != ''")
    )


def paragraphs(words: DataFrame) -> DataFrame:
    """Word rows ``(doc, page, block, par, line, word_no, conf, text)`` to pages ``(doc, page, text, confidence, words)``.

    Words are joined to lines, lines to paragraphs, paragraphs to pages; words of negative confidence keep their text but
    don't count.
    """
    joined = lambda order, value, sep: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]), sep)
    where = ["doc", "page"]
    lines = words.groupBy(*where, "block", "par", "line").agg(joined(["word_no"], "text", " ").alias("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"])
    pars = lines.groupBy(*where, "block", "par").agg(render.join_lines(ordered).alias("text")).where("text != ''")
    texts = pars.groupBy(*where).agg(joined(["block", "par"], "text", "\n\n").alias("text"))
    measured = words.groupBy(*where).agg(F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).cast("float").alias("confidence"), F.count_if(F.col("conf") >= 0).alias("words"))
    return measured.join(texts, where, "left").select(*where, F.coalesce("text", F.lit("")).alias("text"), "confidence", "words")


def confidence_map(words: DataFrame) -> DataFrame:
    """Least confidence of each token in normal form: ``words(id, token, conf)``; unknown confidences are left out.

    Distinct tokens are normalised, not their places.
    """
    least = words.where("conf is not null").groupBy("id", "token").agg(F.min("conf").alias("conf"))
    return least.select("id", normalize.normalize(F.col("token")).alias("token"), "conf").groupBy("id", "token").agg(F.min("conf").alias("conf"))


def glyph_counts(glyphs: DataFrame) -> DataFrame:
    """Glyph rows ``(doc, page, font, ch)`` to ``(doc, page, fm, other)``: those of the convertible legacy family and all others, white space apart."""
    fm = F.coalesce(fonts.legacy_font(F.col("font"))["family"] == "fm-abhaya", F.lit(False))
    seen = glyphs.where(F.col("ch").rlike(f"[^{chars.WS}]"))
    return seen.groupBy("doc", "page").agg(F.count_if(fm).alias("fm"), F.count_if(~fm).alias("other"))


def word_breaks(glyphs: DataFrame) -> DataFrame:
    """Glyph rows ``(doc, page, seq, ch, legacy, left, right, bottom, size)`` to words: white space, a moved base line
    (half the size) or a gap (a fifth of it) ends one. ``(doc, page, word_no, word, flags)``, flags true for legacy glyphs."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc", "page").orderBy("seq")
    blank = F.col("ch").rlike(f"^[{chars.WS}]*$")
    moved = F.abs(F.col("bottom") - F.lag("bottom").over(w)) > 0.5 * F.col("size")
    gap = F.col("left") - F.lag("right").over(w) > 0.2 * F.col("size")
    starts = F.coalesce(F.lag(blank).over(w) | moved | gap, F.lit(True))
    numbered = glyphs.withColumn("blank", blank).withColumn("word_no", F.sum(starts.cast("int")).over(w)).where("not blank")
    own = F.array_sort(F.collect_list(F.struct("seq", "ch", "legacy")))
    return numbered.groupBy("doc", "page", "word_no").agg(own.alias("g")).select("doc", "page", "word_no", F.array_join(F.transform("g", lambda x: x["ch"]), "").alias("word"), F.transform("g", lambda x: x["legacy"]).alias("flags"))
