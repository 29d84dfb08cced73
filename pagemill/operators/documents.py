"""Documents from pages: method counts, confidence, languages, flags, rendering and sinks.

Null markdown counts as empty; a document without pages has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import chars
from ..functions import render, script


def method_counts(pages: DataFrame) -> DataFrame:
    """``pages(doc, kind)`` to ``(doc, label, pages)``."""
    return pages.groupBy("doc", render.method_label(F.col("kind")).alias("label")).agg(F.count("*").alias("pages"))


def summary(pages: DataFrame, key: str | None = None) -> DataFrame:
    """``pages(doc, kind, markdown, confidence, seconds)`` to one row a document: pages, methods by label, mean confidence
    over the pages that have one, languages with at least a twentieth of the letters, failed pages, seconds.

    With ``key``, pages of one key count once; only their counts are shuffled to tell.
    """
    counted = pages.withColumn("c", script.script_counts(F.col("markdown"))).withColumn("label", render.method_label(F.col("kind"))).drop("markdown")
    if key:
        counted = counted.dropDuplicates([key])
    per_label = counted.groupBy("doc", "label").agg(F.count("*").alias("n"), F.sum("c.si").alias("si"), F.sum("c.ta").alias("ta"), F.sum("c.latin").alias("latin"), F.sum("confidence").alias("conf"), F.count("confidence").alias("confs"), F.sum("seconds").alias("seconds"))
    methods = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n"))))
    c = F.struct(F.sum("si").alias("si"), F.sum("ta").alias("ta"), F.sum("latin").alias("latin"))
    d = per_label.groupBy("doc").agg(F.sum("n").alias("pages"), methods.alias("methods"), (F.sum("conf") / F.sum("confs")).alias("confidence"), c.alias("c"), F.sum("seconds").alias("seconds"), F.sum(F.when(F.col("label") == "failed", F.col("n")).otherwise(0)).alias("failed"))
    return d.select("doc", "pages", "methods", "confidence", script.languages(F.col("c"), 0.05, 20).alias("langs"), "failed", "seconds")


def summary_line(doc: Column, methods: Column, langs: Column, confidence: Column, seconds: Column) -> Column:
    """One line of text about a document."""
    parts = F.array_join(F.transform(F.map_entries(methods), lambda e: F.concat_ws(" ", e["value"].cast("string"), e["key"])), ", ")
    return F.concat_ws(" · ", doc, parts, F.when(F.size(langs) > 0, F.array_join(langs, "+")), F.when(confidence.isNotNull(), F.format_string("conf %.0f", confidence)), F.when(seconds.isNotNull(), F.format_string("%.1f s", seconds)))


def flagged(pages: DataFrame, most: int = 6) -> DataFrame:
    """The first ``most`` flagged pages of each document, by page."""
    rows = pages.where("size(flags) > 0").groupBy("doc").agg(F.slice(F.array_sort(F.collect_list(F.struct("page", "flags"))), 1, most).alias("first"))
    return rows.select("doc", F.inline("first"))


def markdown(pages: DataFrame, markers: bool = False) -> DataFrame:
    """``pages(doc, page, markdown)`` to ``(doc, text)``: trimmed pages in order with blank lines between; a page delivered again counts once."""
    body = render.trim(F.coalesce("markdown", F.lit("")))
    piece = F.concat_ws("\n\n", F.format_string("<!-- page %d -->", "page"), F.when(body != "", body)) if markers else F.when(body != "", body)
    parts = pages.select("doc", "page", piece.alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("page", "piece"))), lambda x: x["piece"]), "\n\n")
    text = F.regexp_replace(joined, f"[{chars.WS}]+\\z", "")
    return parts.groupBy("doc").agg(F.when(text == "", "").otherwise(F.concat(text, F.lit("\n"))).alias("text"))


def to_json(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents ``(doc, doc_format, metadata, warnings, seconds, version)`` with their pages as one JSON text each; absent fields are left out, metadata is sorted."""
    own = F.array_sort(F.collect_list(F.struct("page", "method", "markdown", "langs", "confidence", "flags")))
    grouped = pages.groupBy("doc").agg(own.alias("pages"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    meta = F.when(F.size("metadata") > 0, F.map_from_entries(F.array_sort(F.map_entries("metadata"))))
    row = F.struct(F.col("doc").alias("source"), F.col("doc_format").alias("format"), F.coalesce("pages", F.array().cast(grouped.schema["pages"].dataType)).alias("pages"), meta.alias("metadata"), some("warnings").alias("warnings"), "seconds", "version")
    return documents.join(grouped, "doc", "left").select("doc", F.to_json(row, {"pretty": "true"}).alias("json"))


# Extension of each rendered form.
EXTENSIONS = {"markdown": "md", "json": "json", "text": "txt"}


def target_path(out: str, doc: Column, form: str, single: bool = False) -> Column:
    """Where a rendered document goes: below ``out`` under its own path with the form's extension; one document alone goes
    to ``out`` itself if that names a file."""
    if single and "." in out.rstrip("/").rsplit("/", 1)[-1].lstrip("."):
        return F.lit(out)
    stem = F.regexp_replace(doc, "(?<=[^/])\\.[^./]*$", "")
    return F.concat(F.lit(out.rstrip("/") + "/"), stem, F.lit("." + EXTENSIONS[form]))


def write(texts: DataFrame, path: str, kind: str) -> None:
    """Rendered documents as text, json (a line a row) or parquet files, one row a document."""
    target = texts.write.mode("overwrite")
    {"text": lambda: target.text(path), "json": lambda: target.json(path), "parquet": lambda: target.parquet(path)}[kind]()
