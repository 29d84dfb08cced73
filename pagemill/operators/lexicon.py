"""Word lists: counting, pruning, writing and strict reading. Null texts and empty tables give empty lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import chars

# Fixed value: first line of the file format.
MAGIC = "#pagemill-lexicon 1"
_RUN = {"si": f"[{chars.SI}{chars.JOINERS}]+", "ta": f"[{chars.TA}{chars.JOINERS}]+", "en": f"[{chars.LATIN}]+"}


def words(text: Column, lang: str) -> Column:
    """Runs of a language's word characters, without joiners at their ends."""
    runs = F.regexp_extract_all(text, F.lit(_RUN[lang]), F.lit(0))
    return F.filter(F.transform(runs, lambda w: F.regexp_replace(w, f"^[{chars.JOINERS}]+|[{chars.JOINERS}]+$", "")), lambda w: w != "")


@dataclass
class Lexicon:
    """Counts ``(word, freq)`` of a language; ``tokens``, one row ``(tokens)``, counts what was read before pruning."""

    lang: str
    counts: DataFrame
    tokens: DataFrame

    def prune(self, least: int) -> Lexicon:
        return Lexicon(self.lang, self.counts.where(F.col("freq") >= least), self.tokens)

    def lines(self) -> DataFrame:
        """The file as ordered lines ``(value)``: a header, then words by falling count."""
        size = self.counts.agg(F.count("*").alias("types")).crossJoin(self.tokens)  # two single rows
        head = size.select(F.format_string(f"{MAGIC} lang={self.lang} types=%d tokens=%d", "types", "tokens").alias("value"), F.lit(-1).cast("bigint").alias("n"), F.lit("").alias("w"))
        rows = self.counts.select(F.concat_ws("\t", "word", F.col("freq").cast("string")).alias("value"), F.col("freq").alias("n"), F.col("word").alias("w"))
        return head.unionByName(rows).orderBy(F.col("n") >= 0, F.desc("n"), "w").select("value")

    def save(self, path: str) -> None:
        """Write as text; range partitions keep the order over the part files."""
        self.lines().write.mode("overwrite").text(path)


def build(texts: DataFrame, lang: str) -> Lexicon:
    """From ``texts(text)``, normalised: counts are added up in each partition before the shuffle."""
    found = texts.select(F.explode(words(F.col("text"), lang)).alias("word"))
    counts = found.groupBy("word").agg(F.count("*").alias("freq"))
    return Lexicon(lang, counts, counts.agg(F.coalesce(F.sum("freq"), F.lit(0)).alias("tokens")))


def read(spark: SparkSession, path: str, magic: str = MAGIC) -> Lexicon:
    """A saved list; a wrong header or line is an error. Lists of other programs are read by naming their first words as ``magic``."""
    rows = spark.read.text(path)
    head = rows.where(F.col("value").startswith(magic)).head()
    if head is None:
        raise ValueError(f"{path}: not a lexicon, {magic!r} expected")
    fields = dict(x.split("=", 1) for x in head.value[len(magic) :].split() if "=" in x)
    if fields.get("lang") not in _RUN or not fields.get("tokens", "0").isdigit():
        raise ValueError(f"{path}: header without a known language and token count")
    body = rows.where((F.length("value") > 0) & ~F.col("value").startswith("#"))
    count = F.regexp_extract("value", "\\t\\s*(\\d+)\\s*$", 1)
    checked = F.when(count == "", F.raise_error(F.concat(F.lit("bad line: "), F.col("value")))).otherwise(count)
    counts = body.select(F.regexp_replace("value", "\\t[^\\t]*$", "").alias("word"), checked.cast("bigint").alias("freq"))
    return Lexicon(fields["lang"], counts, spark.range(1).select(F.lit(int(fields.get("tokens", "0"))).cast("bigint").alias("tokens")))
