"""Problem 4: occurrences and records of every term by a range-partitioned sort and a run-length scan.

Rows are range-partitioned and sorted by (language, term, record, entry), so that a hot term is spread over several
partitions by record. Each partition is scanned once for runs; only one partial row per term and partition is shuffled
for the final sums.

Defined results: a null term is left out; a null language is a language of its own; a null count adds nothing to the
total while its record still counts; a repeated entry counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RARE, COMMON = 2, 0.25


def _changed(column: pa.Array, last) -> np.ndarray:
    """True where a value differs from the one before; nulls equal each other."""
    before = pa.concat_arrays([pa.array([last], column.type), column.slice(0, len(column) - 1)])
    differs = pc.fill_null(pc.not_equal(column, before), False)
    return np.asarray(pc.or_(differs, pc.xor(pc.is_null(column), pc.is_null(before))))


def _runs(batches):
    """Partial (lang, word, total, lists) of one sorted partition; a run may span batches."""
    names = ["lang", "word", "total", "lists"]
    last, held = None, None  # the last row's keys; the open run
    for b in batches:
        if not b.num_rows:
            continue
        lang, word, record, entry, freq = b.columns
        prior = last or (None, None, None, None)
        term = _changed(lang, prior[0]) | _changed(word, prior[1])
        if last is None:
            term[0] = True
        lists = term | _changed(record, prior[2])
        entries = lists | _changed(entry, prior[3]) | np.asarray(pc.is_null(entry))
        amount = np.where(entries, np.asarray(pc.fill_null(freq, 0)), 0)
        last = (lang[-1].as_py(), word[-1].as_py(), record[-1].as_py(), entry[-1].as_py())
        starts = np.flatnonzero(term)
        edges = starts if len(starts) and starts[0] == 0 else np.concatenate([[0], starts])
        totals, counts = np.add.reduceat(amount, edges), np.add.reduceat(lists.astype(np.int64), edges)
        keys_lang, keys_word = lang.take(pa.array(edges)), word.take(pa.array(edges))
        if not term[0]:
            held = (held[0], held[1], held[2] + totals[0], held[3] + counts[0])
            totals, counts, keys_lang, keys_word = totals[1:], counts[1:], keys_lang.slice(1), keys_word.slice(1)
        if len(totals):
            out = [([held[i]] if held else []) + list(x[:-1]) for i, x in enumerate((keys_lang.to_pylist(), keys_word.to_pylist(), totals, counts))]
            held = (keys_lang[-1].as_py(), keys_word[-1].as_py(), int(totals[-1]), int(counts[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())], names=names)
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(held, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=names)


def term_counts(entries: DataFrame) -> DataFrame:
    """``entries(lang, word, record_id, entry_id, freq)`` to ``(lang, word, total, lists)``."""
    rows = entries.select("lang", "word", F.col("record_id").cast("bigint"), F.col("entry_id").cast("bigint"), F.col("freq").cast("bigint")).where(F.col("word").isNotNull())
    key = ["lang", "word", "record_id"]
    ordered = rows.repartitionByRange(*key).sortWithinPartitions(*key, "entry_id")
    partial = ordered.mapInArrow(_runs, "lang string, word string, total bigint, lists bigint")
    return partial.groupBy("lang", "word").agg(F.sum("total").alias("total"), F.sum("lists").alias("lists"))


def marked(counts: DataFrame, sizes: DataFrame, rare: int = RARE, common: float = COMMON) -> DataFrame:
    """``counts`` with the share of records and the marks ``rare`` and ``common``.

    ``sizes(lang, n_lists, n_tokens)`` has one row per language, a few dozen at most; its join key is null-safe.
    """
    s = sizes.select(F.col("lang").alias("_lang"), "n_lists", "n_tokens")
    joined = counts.join(s, counts["lang"].eqNullSafe(s["_lang"]), "left").drop("_lang")
    marks = F.array_compact(F.array(F.when(F.col("total") <= rare, F.lit("rare")), F.when(F.col("lists") > common * F.col("n_lists"), F.lit("common"))))
    return joined.withColumn("marks", marks)
