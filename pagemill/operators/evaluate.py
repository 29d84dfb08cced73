"""Evaluation: error rates against a truth, grouped comparisons, quantiles, surveys and sampling. Null measures are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import chars
from ..functions import metrics, normalize, render, script


def bench(rows: DataFrame) -> DataFrame:
    """``rows(file, reference, text, seconds)``, canonical texts, to ``(file, lang, cer, wer, seconds)`` and further columns; language of the truth."""
    lang = script.dominant(script.script_counts(F.col("reference")))
    return rows.select("file", lang.alias("lang"), metrics.cer(F.col("reference"), F.col("text")).alias("cer"), metrics.wer(F.col("reference"), F.col("text")).alias("wer"), "seconds", *[c for c in rows.columns if c not in ("file", "reference", "text", "seconds")])


def bench_run(files: DataFrame, truths: DataFrame) -> DataFrame:
    """Rendered files ``(file, markdown, methods, seconds)`` against the ground truths that belong to them, ``(file, text)``:
    ``(file, lang, cer, wer, seconds, methods)``. Files without a truth are left out."""
    texts = files.select("file", render.plain_text(F.col("markdown")).alias("text"), "methods", "seconds")
    paired = with_truth(texts.select("file", "text"), truths)
    own = paired.select("file", normalize.canonical(F.col("text")).alias("text"), normalize.canonical(F.col("reference")).alias("reference"))
    return bench(own.join(texts.select("file", "methods", "seconds"), "file"))


def results_json(rows: DataFrame) -> DataFrame:
    """Results as one JSON array of objects, pretty, ordered by file: one row ``(json)``. For bounded reports, not for corpora."""
    own = F.struct("file", "lang", "cer", "wer", "seconds", "methods")
    return rows.agg(F.array_sort(F.collect_list(own)).alias("r")).select(F.to_json("r", {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def results_table(rows: DataFrame) -> DataFrame:
    """Results as lines of fixed columns ``(line)``: a header, the files in order, a blank line, the languages."""
    shown = lambda c: F.col(c) * 100.0
    line = F.format_string("%-40s %4s %8.2f %8.2f %7.1f  %s", "file", "lang", shown("cer"), shown("wer"), F.col("seconds").cast("double"), "methods")
    head = rows.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.format_string("%-40s %4s %8s %8s %7s  method", F.lit("file"), F.lit("lang"), F.lit("CER %"), F.lit("WER %"), F.lit("sec")).alias("line"))
    each = rows.select(F.lit(1).alias("part"), F.col("file").alias("key"), line.alias("line"))
    gap = rows.sparkSession.range(1).select(F.lit(2).alias("part"), F.lit("").alias("key"), F.lit("").alias("line"))
    mean = F.format_string("%-4s n=%-3d mean CER %6.2f%%  mean WER %6.2f%%  %.1f s/file", F.coalesce("lang", F.lit("")), "pages", shown("cer"), shown("wer"), "seconds")
    langs = by_language(rows.withColumn("seconds", F.col("seconds").cast("double"))).select(F.lit(3).alias("part"), F.coalesce("lang", F.lit("")).alias("key"), mean.alias("line"))
    return head.unionByName(each).unionByName(gap).unionByName(langs).orderBy("part", "key").select("line")


def conversion(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Converted pages ``(doc, page, kind, markdown, flags, seconds)`` against their recognition ``(doc, page, text, seconds)``:
    ``(doc, page, kind, flags, cer, word_f1, agreement, seconds, ocr_seconds, chars)``; pages without recognition are left out."""
    both = pages.join(read.select("doc", "page", F.col("text").alias("read"), F.col("seconds").alias("ocr_seconds")), ["doc", "page"])
    clean = lambda c: F.replace(normalize.canonical(c), F.lit(chars.ZWNJ), F.lit(""))
    t = both.select("doc", "page", "kind", "flags", "seconds", "ocr_seconds", clean(render.plain_text(F.col("markdown"))).alias("own"), clean(render.plain_text(F.col("read"))).alias("read"))
    empty = (F.col("own") == "") | (F.col("read") == "")
    f1 = F.when(empty, F.lit(0.0)).otherwise(metrics.word_f1(F.col("read"), F.col("own")))
    return t.select("doc", "page", "kind", "flags", metrics.cer(F.col("read"), F.col("own")).alias("cer"), f1.alias("word_f1"), metrics.agreement(F.col("own"), F.col("read")).alias("agreement"), "seconds", "ocr_seconds", F.length("own").alias("chars"))


def conversion_report(results: DataFrame) -> DataFrame:
    """Of ``conversion``: number, mean, median, least and most of each measure over the converted pages ``(measure, ...)``."""
    kept = results.where("kind = 'legacy_converted'")
    each = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in ("cer", "word_f1", "agreement", "seconds", "ocr_seconds")])
    return stats(kept.select(F.inline(each)), ["measure"], "v")


def other_methods(results: DataFrame) -> DataFrame:
    """Methods of the pages that were not converted, with their numbers."""
    return results.where("kind != 'legacy_converted'").groupBy("kind").agg(F.count("*").alias("pages"))


def by_language(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang").agg(F.count("*").alias("pages"), F.avg("cer").alias("cer"), F.avg("wer").alias("wer"), F.avg("seconds").alias("seconds"))


def with_truth(files: DataFrame, truths: DataFrame) -> DataFrame:
    """Files ``(file, text)`` with the first of three truths ``(file, text)``: stem.gt.txt, stem.gt.md, stem without its last part .gt.txt."""
    stem = F.regexp_replace("file", "\\.[^./]*$", "")
    keys = F.array(F.concat(stem, F.lit(".gt.txt")), F.concat(stem, F.lit(".gt.md")), F.concat(F.regexp_replace(stem, "_[^_/]*$", ""), F.lit(".gt.txt")))
    wanted = files.select("file", "text", F.posexplode(keys).alias("place", "key"))
    hits = wanted.join(truths.select(F.col("file").alias("key"), F.col("text").alias("reference")), "key")
    return hits.groupBy("file", "text").agg(F.min_by("reference", "place").alias("reference"))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs ``(file, cer, wer)`` with files named lang_font_number_variant, by (font, variant), variant and all, in percent."""
    parts = F.split(F.regexp_replace("file", "\\.[^.]*$", ""), "_")
    font = F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 3, F.lit(0))), "_")).otherwise("all")
    both = before.select("file", F.col("cer").alias("cer0"), F.col("wer").alias("wer0")).join(after.select("file", F.col("cer").alias("cer1"), F.col("wer").alias("wer1")), "file")
    keyed = both.select("*", font.alias("font"), F.element_at(parts, -1).alias("variant"))
    # A file without a font is counted under "all" by both of the first groupings, as the published tool does.
    sets = F.array(F.struct(F.col("font"), F.col("variant")), F.struct(F.lit("all").alias("font"), F.col("variant")), F.struct(F.lit("all").alias("font"), F.lit("all").alias("variant")))
    grouped = keyed.select(F.explode(sets).alias("g"), "cer0", "cer1", "wer0", "wer1").groupBy("g.font", "g.variant")
    mean = lambda c: (100.0 * F.avg(c)).alias(c)
    return grouped.agg(F.count("*").alias("pages"), mean("cer0"), mean("cer1"), mean("wer0"), mean("wer1")).orderBy(F.col("font") == "all", "font", "variant")


def unmatched(before: DataFrame, after: DataFrame) -> DataFrame:
    """Numbers of files in either run and in both."""
    joined = before.select("file", F.lit(1).alias("b")).join(after.select("file", F.lit(1).alias("a")), "file", "full")
    return joined.agg(F.count("b").alias("before"), F.count("a").alias("after"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"))


def ranked(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Distinct values of each key ``(key, value, n, upto, total)``: how often, how many values up to there and in all.

    No task holds a group: values are counted before the shuffle, range-partitioned by key and value, numbered within each
    range, and moved on by what lies in the ranges before. A null key is a key.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*key, value).agg(F.count("*").alias("n"))
    ranges = counted.repartitionByRange(*key, value).withColumn("part", F.spark_partition_id()).checkpoint()  # both uses below must see the same ranges
    sizes = ranges.groupBy(*key, "part").agg(F.sum("n").alias("size"))  # a row a key and range
    before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = sizes.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("part").alias("_part"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"), F.sum("size").over(Window.partitionBy(*key)).alias("total"))
    local = Window.partitionBy(*key, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("part") == F.col("_part")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = ranges.withColumn("inside", F.sum("n").over(local))
    return inside.join(moved, same).select(*key, value, "n", (F.col("before") + F.col("inside")).alias("upto"), "total")


def _at(place: Column, value: str) -> Column:
    """Aggregate over ``ranked`` rows: the value at a place of its key."""
    return F.max(F.when((F.col("upto") - F.col("n") < place) & (place <= F.col("upto")), F.col(value)))


def quantiles_exclusive(rows: DataFrame, key: list[str], value: str, percents: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """Exclusive quantiles of twenty steps, as 5 % multiples; groups of fewer than two values have none."""
    total, out = F.col("total"), []
    for p in percents:
        step = p // 5
        j = F.least(F.greatest(F.floor((total + 1) * step / 20), F.lit(1)), total - 1)
        delta = F.max((total + 1) * step - j * 20)
        out.append(((_at(j, value) * (20 - delta) + _at(j + 1, value) * delta) / 20.0).alias(f"p{p}"))
    return ranked(rows, key, value).where("total > 1").groupBy(*key).agg(*out)


def below(rows: DataFrame, key: list[str], value: str, thresholds: tuple[float, ...]) -> DataFrame:
    """Share of the values under each threshold."""
    return rows.groupBy(*key).agg(*[(F.count_if(F.col(value) < t) / F.greatest(F.count(value), F.lit(1))).alias(f"below_{t:g}") for t in thresholds])


def stats(rows: DataFrame, key: list[str], value: str) -> DataFrame:
    """Number, mean, median, least and most of the values; a key whose values are all null has a row of nulls."""
    half = F.floor((F.col("total") + 1) / 2)
    middle = ranked(rows, key, value).groupBy(*key).agg(((_at(half, value) + _at(F.floor(F.col("total") / 2) + 1, value)) / 2).alias("median"))
    plain = rows.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    same = F.lit(True)
    for k in key:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return plain.alias("a").join(middle.alias("b"), same, "left").select(*[f"a.{k}" for k in key], "n", "mean", "median", "least", "most")


def unmatched_tokens(pages: DataFrame) -> DataFrame:
    """Sum of the numbers in ``legacy_unmatched_tokens`` flags by document: ``pages(doc, flags)``."""
    flag = pages.select("doc", F.explode("flags").alias("flag")).where(F.col("flag").startswith("legacy_unmatched_tokens:"))
    return flag.groupBy("doc").agg(F.sum(F.regexp_extract("flag", ":(\\d+)$", 1).cast("bigint")).alias("tokens"))


def bucket(path: Column) -> Column:
    """0 to 99 from the SHA-1 of a path."""
    return F.conv(F.substring(F.sha1(path), 1, 8), 16, 10).cast("bigint") % 100


def split_of(path: Column, train: int = 80, learn: int = 10) -> Column:
    b = bucket(path)
    return F.when(b < train, "train").when(b < train + learn, "learn").otherwise("heldout")


def shuffled(rows: DataFrame, path: str, seed: int = 7) -> DataFrame:
    """The rows with a column ``place`` that puts them in an order which depends on the seed and on nothing else."""
    return rows.withColumn("place", F.sha1(F.concat(F.lit(f"{seed}:"), F.col(path))))


def hash_sample(rows: DataFrame, path: str, n: int) -> DataFrame:
    """The ``n`` rows of smallest SHA-1, a sample that doesn't depend on order."""
    return rows.orderBy(F.sha1(path), path).limit(n)


def most_common(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def font_survey(pages: DataFrame) -> DataFrame:
    """``pages(doc, page, family)``, one row a font family of a page or null, to documents and pages of each family."""
    seen = pages.where("family is not null").select("doc", "page", "family").distinct()
    return seen.groupBy("family").agg(F.count_distinct("doc").alias("docs"), F.count("*").alias("pages"))


def font_combinations(pages: DataFrame) -> DataFrame:
    """Documents by the sorted families they use, ``(none)`` for none."""
    per_doc = pages.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("family")), "+").alias("combo"))
    return per_doc.groupBy(F.when(F.col("combo") == "", "(none)").otherwise(F.col("combo")).alias("combo")).agg(F.count("*").alias("docs"))


def select_pages(pages: DataFrame, least: int = 600, per_doc: int = 2, max_pages: int = 50) -> DataFrame:
    """The first pages of each document with enough legacy glyphs, ``pages(doc, page, fm, other)``; every third document by hash is held out."""
    first = Window.partitionBy("doc").orderBy("page")
    kept = pages.where((F.col("fm") >= least) & (F.col("page") < max_pages)).withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_doc)
    return kept.select("doc", "page", "fm", "other", F.when(bucket(F.col("doc")) % 3 == 0, "holdout").otherwise("train").alias("part"))


def fill_sets(pages: DataFrame, paths: DataFrame, train_pages: int, holdout_pages: int, **limits: int) -> DataFrame:
    """``select_pages`` filled into two sets in hash order of all ``paths(doc)``: every third document to the holdout set and
    the others to the train set until one is full, all further ones to the other, until both are.

    Only documents that can still be needed, at most as many as pages are wanted, are put in order.
    """
    order = F.sha1("doc")
    picked = select_pages(pages, **limits).drop("part")
    sizes = picked.groupBy("doc").agg(F.count("*").alias("n")).orderBy(order).limit(train_pages + holdout_pages)
    last = sizes.agg(F.max(order).alias("last"))
    # The place of a document among all paths, counted for those up to the last one needed.
    places = paths.select("doc").distinct().join(F.broadcast(last), F.sha1("doc") <= F.col("last")).withColumn("k", F.row_number().over(Window.orderBy(order, "doc")) - 1)
    line = sizes.join(places.select("doc", "k"), "doc")
    so_far = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    third = F.col("k") % 3 == 0
    d = line.withColumn("h", F.sum(F.when(third, F.col("n")).otherwise(0)).over(so_far)).withColumn("t", F.sum(F.when(third, 0).otherwise(F.col("n"))).over(so_far))
    d = d.withColumn("open", (F.coalesce(F.max("h").over(before), F.lit(0)) < holdout_pages) & (F.coalesce(F.max("t").over(before), F.lit(0)) < train_pages))
    d = d.withColumn("held", F.coalesce(F.max(F.when(F.col("open"), F.col("h"))).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0)) >= holdout_pages)
    # Once one set is full, the other takes all.
    d = d.withColumn("part", F.when(F.col("open"), F.when(third, "holdout").otherwise("train")).otherwise(F.when(F.col("held"), "train").otherwise("holdout")))
    filled = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = d.withColumn("filled", filled).where(F.col("filled") < F.when(F.col("part") == "holdout", holdout_pages).otherwise(train_pages))
    return picked.join(kept.select("doc", "part"), "doc")
