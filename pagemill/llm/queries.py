"""Queries pN_... over the test tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.deliveries import once
from . import encoding, languages, leaks, lookalike, scans, sentences, split, terms, tokens
from .common import scan


def _visible(spark: SparkSession, d: str) -> DataFrame:
    pages = scan(spark, d, "pages", F.lit("page").alias("record_kind"), F.lit(0).cast("bigint").alias("scope"), F.col("page_id").alias("id"), F.col("markdown").alias("text"))
    words = scan(spark, d, "lexicon_counts", F.lit("lexicon").alias("record_kind"), F.col("lexicon_id").alias("scope"), F.col("entry_id").alias("id"), F.col("word").alias("text"))
    return pages.unionByName(words)


def p1_consistent(spark: SparkSession, d: str) -> DataFrame:
    """Every page and list word in its consistent form."""
    texts = _visible(spark, d)
    return lookalike.canonical(once(texts, "record_kind", "id"), lookalike.learn(texts)).select("record_kind", "id", "text")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    texts = _visible(spark, d)
    return lookalike.lookalike_pairs(lookalike.keyed(texts, lookalike.learn(texts)))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every record that has differing look-alikes, with its class and their number."""
    texts = _visible(spark, d)
    return lookalike.lookalike_classes(lookalike.keyed(texts, lookalike.learn(texts)))


def _segments(spark: SparkSession, d: str) -> DataFrame:
    pages = scan(spark, d, "pages", "page_id", "langs", F.coalesce(F.col("method.kind") == "ocr", F.lit(False)).alias("scanned"), F.col("markdown").alias("text"))
    return languages.segments(pages, languages.learn(pages))


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of one language in every page, with a confidence."""
    return _segments(spark, d).drop("langs").distinct()


def p2_pages(spark: SparkSession, d: str) -> DataFrame:
    """Languages of every page by length, with their share and confidence."""
    size = F.col("end_at") - F.col("start_at")
    found = _segments(spark, d).drop("langs").distinct().groupBy("page_id", "lang").agg(F.sum(size).alias("chars"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    return found


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return languages.relabelled(_segments(spark, d))


def p3_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentence units of every page, with their order, kind and stored text."""
    pages = scan(spark, d, "pages", F.col("page_id").alias("record_id"), F.col("markdown").alias("text"))
    return sentences.sentences(once(pages, "record_id"), sentences.learn(pages)).withColumnRenamed("record_id", "page_id")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pages = scan(spark, d, "pages").where("method.kind in ('text_layer', 'office')").select(F.col("page_id").alias("record_id"), F.col("markdown").alias("text"))
    know = sentences.learn(scan(spark, d, "pages", F.col("markdown").alias("text")))
    return sentences.sentences(pages, know).select(F.col("record_id").alias("page_id"), "start_at", "end_at").distinct()


def _terms(spark: SparkSession, d: str) -> DataFrame:
    entries = scan(spark, d, "lexicon_counts", "lang", "word", F.col("lexicon_id").alias("record_id"), "entry_id", "freq")
    lists = scan(spark, d, "lexicons", "lexicon_id", "lang", "tokens").groupBy("lexicon_id", "lang").agg(F.max("tokens").alias("tokens"))
    sizes = lists.groupBy("lang").agg(F.count("lexicon_id").alias("n_lists"), F.sum("tokens").alias("n_tokens"))
    return terms.marked(terms.term_counts(entries), sizes)


def p4_term_counts(spark: SparkSession, d: str) -> DataFrame:
    """Total, lists, share of the language's lists and marks of every word of every language."""
    return _terms(spark, d).select("lang", "word", "total", "lists", "n_lists", "n_tokens", F.array_join("marks", ",").alias("marks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("lang", "word", F.explode("marks").alias("mark"))


def _scans(spark: SparkSession, d: str) -> scans.Findings:
    pages = scan(spark, d, "ocr_pages", "ocr_id", "doc", "text", F.expr("transform(word_confidences, x -> x.conf)").alias("confs"))
    return scans.Findings(spark, pages, scan(spark, d, "pages", "langs", F.col("markdown").alias("text")))


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Every scanned page as continuous paragraphs."""
    return scans.paragraphs(_scans(spark, d))


def p5_pages(spark: SparkSession, d: str) -> DataFrame:
    """The markdown of every scanned page as continuous paragraphs, whether its recognition is on record or not."""
    pages = scan(spark, d, "pages", "page_id", "doc", "langs", F.col("method.kind").alias("kind"), F.col("markdown").alias("text"))
    confs = scan(spark, d, "ocr_pages", "page_id", F.expr("transform(word_confidences, x -> x.conf)").alias("confs")).where("confs is not null").dropDuplicates(["page_id"])
    scanned = pages.where("kind = 'ocr'").join(confs, "page_id", "left").select(F.col("page_id").alias("ocr_id"), "doc", "text", "confs")
    return scans.paragraphs(scans.Findings(spark, scanned, pages.select("langs", "text"))).withColumnRenamed("ocr_id", "page_id")


def p5_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Rare words with the dictionary word each is a misreading of."""
    return _scans(spark, d).fixes


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _scans(spark, d).found().select("ocr_id", "line_no", "kind").distinct()


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled records with the encodings found and their restored text."""
    pages = encoding.restored(scan(spark, d, "pages", "page_id", "markdown"), "page_id", "markdown").withColumn("record_kind", F.lit("page"))
    fonts = encoding.restored(scan(spark, d, "font_words", "fw_id", "text"), "fw_id", "text").withColumn("record_kind", F.lit("font_words"))
    return pages.unionByName(fonts).dropDuplicates(["record_kind", "record_id"]).select("record_kind", "record_id", "kinds", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_restored(spark, d).select("record_kind", "record_id")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(scan(spark, d, "documents", "doc_id", "text"), tokens.vocabulary())


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the test items they leak, the words they share in alignment and the longest unbroken run."""
    return leaks.find(scan(spark, d, "documents", "doc_id", "text"), scan(spark, d, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_leaks(spark, d).select("doc_id", "item_id").distinct()


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split(scan(spark, d, "documents", "doc_id", "text"), tokens.vocabulary())


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the splitter had to cut."""
    return p9_pieces(spark, d).where("piece_no = 1").select("doc_id")


_P4 = """
WITH e AS (SELECT DISTINCT entry_id, lexicon_id, lang, word, freq FROM lexicon_counts WHERE word IS NOT NULL),
t AS (SELECT lang, word, CAST(sum(coalesce(freq, 0)) AS BIGINT) AS total, count(DISTINCT lexicon_id) AS lists FROM e GROUP BY lang, word),
l AS (SELECT lexicon_id, lang, max(tokens) AS tokens FROM lexicons GROUP BY lexicon_id, lang),
s AS (SELECT lang, count(lexicon_id) AS n_lists, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM l GROUP BY lang),
j AS (SELECT t.*, s.n_lists, s.n_tokens FROM t LEFT JOIN s ON t.lang IS NOT DISTINCT FROM s.lang)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_consistent, p1_found, p1_classes, p2_segments, p2_pages, p2_found, p3_sentences, p3_found, p4_term_counts, p4_found, p5_paragraphs, p5_pages, p5_corrections, p5_found, p6_restored, p6_found, p7_ids, p8_leaks, p8_found, p9_pieces, p9_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_term_counts": _P4
        + "SELECT *, concat_ws(',', CASE WHEN total <= 2 THEN 'rare' END, CASE WHEN lists > 0.25 * n_lists THEN 'common' END) AS marks FROM j",
        "p4_found": _P4
        + "SELECT lang, word, 'rare' AS mark FROM j WHERE total <= 2 UNION ALL SELECT lang, word, 'common' FROM j WHERE lists > 0.25 * n_lists",
    }
