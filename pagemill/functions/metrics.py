"""Error rates and agreement of texts. Inputs are canonical text; see ``functions.normalize.canonical``. Null on either side gives null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import chars
from . import sequences


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"[^{chars.WS}]+"), F.lit(0))


def edits(a: Column, b: Column) -> Column:
    """Edit distance of code points; near texts need only a narrow band of the table, so growing bands are tried first."""
    near = lambda most: F.nullif(F.levenshtein(a, b, most), F.lit(-1))
    return F.when(a == b, F.lit(0)).otherwise(F.coalesce(near(16), near(256), F.levenshtein(a, b)))


def cer(reference: Column, other: Column) -> Column:
    """Edit distance of code points over the length of the reference."""
    return edits(reference, other) / F.greatest(F.length(reference), F.lit(1)).cast("double")


@F.arrow_udf(T.IntegerType())
def _word_edits(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else sequences.distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def wer(reference: Column, other: Column) -> Column:
    """Edit distance of words over the number of words of the reference."""
    return _word_edits(words(reference), words(other)) / F.greatest(F.size(words(reference)), F.lit(1)).cast("double")


def bigrams(text: Column) -> Column:
    """Pairs of neighbouring characters without white space."""
    packed = F.regexp_replace(text, f"[{chars.WS}]", "")
    return F.when(F.length(packed) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.length(packed) - 1), lambda i: packed.substr(i, F.lit(2))))


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection: over distinct members, the smaller count."""
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))


def dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(2.0 * _common(a, b) / F.greatest(total, F.lit(1)))


def agreement(a: Column, b: Column) -> Column:
    """Dice coefficient of character bigrams; 1 for two empty texts."""
    return dice(bigrams(a), bigrams(b))


def agreement_of(pairs: DataFrame, key: list[str]) -> DataFrame:
    """``pairs(key, a, b)``, keys unique, to ``(key, score)``: the same for long texts, as counts of exploded bigrams.

    Counts are added up in each partition before the shuffle; a pair without bigrams scores 1.
    """
    sides = pairs.select(*key, F.posexplode(F.array(bigrams(F.coalesce("a", F.lit(""))), bigrams(F.coalesce("b", F.lit("")))) ).alias("side", "grams"))
    grams = sides.select(*key, "side", F.explode("grams").alias("gram"))
    per_gram = grams.groupBy(*key, "gram").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    scores = per_gram.groupBy(*key).agg((2.0 * F.sum(F.least("na", "nb")) / F.sum(F.col("na") + F.col("nb"))).alias("score"))
    return pairs.select(*key).join(scores, key, "left").select(*key, F.coalesce("score", F.lit(1.0)).alias("score"))


def word_f1(a: Column, b: Column) -> Column:
    return dice(words(a), words(b))


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of boxes (x0, y0, x1, y1); 0 without overlap."""
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    shared = width * height
    return F.when((width <= 0) | (height <= 0), F.lit(0.0)).otherwise(shared / (area(a) + area(b) - shared))
