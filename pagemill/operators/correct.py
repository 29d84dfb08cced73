"""Lexicon-constrained word correction as joins over distinct words.

Each distinct word outside the lexicon is expanded once: two rounds of an equi-join of its short runs of characters with the
sources of the rules, keeping the best weight of each variant. Variants are joined with the lexicon, ranked, and the accepted
correction of a word is mapped back to all its occurrences. Rule tables of any size are joined by key: the optimizer sends a
small one to all executors and shuffles a large one.

Null words are ignored; a word without an accepted candidate has no row; ties between candidates go to the smaller word.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import chars
from ..functions import normalize, script
from ..functions.tables import SINHALA_CONFUSIONS
from . import lexicon as lexicons
from . import ocr

RULES_SCHEMA = "src string, dst string, weight float"


@dataclass(frozen=True)
class Options:
    max_edits: int = 2
    min_freq: int = 1
    min_score: float = 0.05
    margin: float = 3.0
    confidence_gate: float | None = 97.0
    min_len: int = 3


def sinhala_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in SINHALA_CONFUSIONS], RULES_SCHEMA)


def parse_rules(lines: DataFrame) -> DataFrame:
    """Rules from lines ``(value)`` of tab-separated source, target and weight; comments, short and identical rows are skipped."""
    cells = F.split("value", "\t")
    weight = F.expr("try_cast(get(split(value, '\t'), 2) as float)")
    rows = lines.where(~F.col("value").startswith("#")).select(F.get(cells, 0).alias("src"), F.get(cells, 1).alias("dst"), weight.alias("weight"))
    return rows.where("src is not null and dst is not null and weight is not null and src != dst and src != ''").withColumn("weight", F.least(F.greatest("weight", F.lit(0.0).cast("float")), F.lit(1.0).cast("float")))


def _expand(frontier: DataFrame, rules: DataFrame, longest: int, depth: int, sets: list[str]) -> DataFrame:
    """Every rule at every place of ``form``: runs of up to ``longest`` characters meet the rules' sources."""
    places = lambda k: F.transform(F.sequence(F.lit(1), F.length("form") - k + 1), lambda i: F.struct(i.alias("i"), F.col("form").substr(i, F.lit(k)).alias("src")))
    none = F.expr("cast(array() as array<struct<i: int, src: string>>)")
    runs = F.flatten(F.array(*[F.when(F.length("form") >= k, places(k)).otherwise(none) for k in range(1, longest + 1)]))
    placed = frontier.select(*sets, "word", "form", "score", F.inline(runs))
    joined = placed.join(rules, [*sets, "src"])
    put = F.concat(F.col("form").substr(F.lit(1), F.col("i") - 1), F.col("dst"), F.substring("form", F.col("i") + F.length("src"), F.length("form")))
    return joined.select(*sets, "word", put.alias("form"), (F.col("score") * F.col("weight").cast("double")).alias("score"), F.lit(depth).alias("edits"))


def variants(words: DataFrame, rules: DataFrame, max_edits: int = 2, sets: list[str] | None = None) -> DataFrame:
    """``words(word)``, distinct, to ``(word, form, edits, weight)``: each form once, with its best weight product.

    ``sets``: columns of ``rules`` that tell several tables apart; each is applied for itself and comes out beside the forms.
    """
    sets = sets or []
    table = rules.where("src != ''").select(*sets, "src", "dst", "weight")
    longest = table.agg(F.coalesce(F.max(F.length("src")), F.lit(0))).first()[0]
    frontier = words.where("word is not null").select("word", F.col("word").alias("form"), F.lit(1.0).alias("score"))
    if sets:
        frontier = frontier.join(F.broadcast(table.select(*sets).distinct()))  # a row a set
    best = lambda df: df.groupBy(*sets, "word", "form").agg(F.max(F.struct("score", (-F.col("edits")).alias("less"))).alias("best")).select(*sets, "word", "form", F.col("best.score").alias("score"), (-F.col("best.less")).cast("int").alias("edits"))
    out = None
    for depth in range(1, max_edits + 1):
        level = best(_expand(frontier, table, longest, depth, sets).where("form != word"))
        out = level if out is None else out.unionByName(level)
        frontier = level.select(*sets, "word", "form", "score")
    return best(out).withColumnRenamed("score", "weight")


def candidates(forms: DataFrame, lexicon: DataFrame, sets: list[str] | None = None) -> DataFrame:
    """Forms that are in ``lexicon(word, freq)``, with their score and rank."""
    known = lexicon.where("freq > 0").select(F.col("word").alias("form"), "freq")
    scored = forms.join(known, "form").withColumn("score", F.col("freq").cast("double") * F.col("weight"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*(sets or []), "word").orderBy(F.desc("score"), "form")))


def corrections(words: DataFrame, lexicon: DataFrame, rules: DataFrame, options: Options = Options()) -> DataFrame:
    """``words(word)`` to ``(word, fixed)`` for the words outside the lexicon that have an accepted correction."""
    unknown = words.select("word").distinct().where(F.length("word") >= options.min_len).join(lexicon.select("word"), "word", "left_anti")
    ranked = candidates(variants(unknown, rules, options.max_edits), lexicon)
    second = F.lead("score").over(Window.partitionBy("word").orderBy("rank"))
    best = ranked.withColumn("second", second).where("rank = 1")
    ok = (F.col("freq") >= options.min_freq) & (F.col("score") >= options.min_score) & (F.col("second").isNull() | (F.col("score") >= options.margin * F.col("second")))
    return best.where(ok).select("word", F.col("form").alias("fixed"), "edits", "score")


def correct_texts(texts: DataFrame, confidences: DataFrame | None, lexicon: DataFrame, rules: DataFrame, lang: str, options: Options = Options()) -> DataFrame:
    """``texts(id, text)`` to ``(id, text, changed)``; all but words of ``lang`` stays as it is.

    ``confidences(id, token, conf)`` holds the confidence of whole white-space tokens, where known.
    """
    letter = {"si": chars.SI + chars.JOINERS, "ta": chars.TA + chars.JOINERS, "en": chars.LATIN}[lang]
    tokens = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(f"[{chars.WS}]+|[^{chars.WS}]+"), F.lit(0))).alias("at", "token"))
    if confidences is not None:
        tokens = tokens.join(confidences.select("id", "token", "conf"), ["id", "token"], "left")
    else:
        tokens = tokens.withColumn("conf", F.lit(None).cast("float"))
    parts = tokens.select("id", "at", "conf", F.posexplode(F.regexp_extract_all("token", F.lit(f"[{letter}]+|[^{letter}]+"), F.lit(0))).alias("sub", "part"))
    lead, trail = F.regexp_extract("part", f"^[{chars.JOINERS}]*", 0), F.regexp_extract("part", f"(?<=[^{chars.JOINERS}])[{chars.JOINERS}]*$", 0)
    core = F.regexp_replace("part", f"^[{chars.JOINERS}]+|[{chars.JOINERS}]+$", "")
    gate = F.lit(True) if options.confidence_gate is None else F.coalesce(F.col("conf") < options.confidence_gate, F.lit(True))
    word = F.when(F.col("part").rlike(f"[{letter}]") & gate, core)
    keyed = parts.select("id", "at", "sub", "part", lead.alias("lead"), trail.alias("trail"), word.alias("word"))
    fixes = corrections(keyed.where("word is not null and word != ''").select("word"), lexicon, rules, options).select("word", "fixed")
    joined = keyed.join(fixes, "word", "left").withColumn("new", F.when(F.col("fixed").isNotNull(), F.concat("lead", "fixed", "trail")).otherwise(F.col("part")))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "sub", "new"))), lambda x: x["new"]), "")
    done = joined.groupBy("id").agg(ordered.alias("text"), F.count("fixed").alias("changed"))
    return texts.select("id", F.col("text").alias("_old")).join(done, "id", "left").select("id", F.coalesce("text", "_old").alias("text"), F.coalesce("changed", F.lit(0)).alias("changed"))


def finish(pages: DataFrame, words: DataFrame | None, lexicon: DataFrame | None, rules: DataFrame | None, lang: str = "si", options: Options = Options()) -> DataFrame:
    """Recognised pages ``(doc, page, text)`` to ``(doc, page, text, flags)``: normalised and, with a lexicon, corrected.

    ``words(doc, page, token, conf)`` holds confidences, where known. Pages without a letter of ``lang`` stay as they are;
    ``corrected:N`` says how many words changed. Null text stays null.
    """
    body = pages.select("doc", "page", normalize.normalize(F.col("text")).alias("text"))
    none = F.expr("cast(array() as array<string>)")
    if lexicon is None:
        return body.withColumn("flags", none)
    key = F.to_json(F.struct("doc", "page"))
    own = script.script_counts(F.col("text"))[{"si": "si", "ta": "ta", "en": "latin"}[lang]]
    candidates = body.where(own > 0).select(key.alias("id"), "text")
    conf = None if words is None else ocr.confidence_map(words.select(key.alias("id"), "token", "conf"))
    done = correct_texts(candidates, conf, lexicon, rules if rules is not None else sinhala_rules(pages.sparkSession), lang, options)
    joined = body.withColumn("id", key).join(done.select("id", F.col("text").alias("fixed"), "changed"), "id", "left")
    flag = F.when(F.col("changed") > 0, F.array(F.concat(F.lit("corrected:"), F.col("changed").cast("string")))).otherwise(none)
    return joined.select("doc", "page", F.coalesce("fixed", "text").alias("text"), flag.alias("flags"))


def load(spark: SparkSession, lang: str, path: str) -> tuple[lexicons.Lexicon | None, str | None]:
    """The word list for correcting ``lang``, or none, and a note that says why there is none. Only Sinhala has rules."""
    if lang != "si":
        return None, None
    try:
        found = lexicons.read(spark, path)
    except ValueError as e:
        return None, f"{e}: recognised text is not corrected"
    except AnalysisException:
        return None, f"{path}: no Sinhala word list there, recognised text is not corrected"
    if found.lang != lang or found.counts.isEmpty():
        return None, f"{path}: not a word list of {lang}, recognised text is not corrected"
    return found, None
