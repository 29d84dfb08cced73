"""Records delivered several times, counted once without shuffling all of them.

The ids alone tell which records are repeated. Their hashes go into a Bloom filter of fixed size; rows that it lets pass can be
no repetition and stay where they are, only the others (the repeated ones, and few more) are shuffled to be told apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of the filter, 4 MiB whatever the number of records, and bits of each of its parts.
BITS, PART = 25, 16


def _fill(batches):
    bits = np.zeros(1 << BITS, bool)
    for b in batches:
        bits[np.asarray(b.column(0))] = True
    parts = np.packbits(bits).reshape(-1, 1 << (PART - 3))
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([parts[k].tobytes() for k in used], pa.binary())], names=["_part", "_bits"])


def _unite(table: pa.Table) -> pa.Table:
    whole = np.bitwise_or.reduce([np.frombuffer(x, np.uint8) for x in table.column("_bits").to_pylist()])
    return pa.table({"_part": table.column("_part").slice(0, 1), "_bits": pa.array([whole.tobytes()], pa.binary())})


def once(df: DataFrame, *key: str) -> DataFrame:
    """One row for each value of the key, null being one; of rows that differ in other columns, any one.

    ``df`` is read three times (its key columns once more), which costs less than a shuffle of its texts.
    """
    place = F.shiftrightunsigned(F.xxhash64(*key), 64 - BITS)
    again = df.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").select(place.alias("_place"))
    schema = "_part bigint, _bits binary"
    empty = df.sparkSession.range(1 << (BITS - PART)).select(F.col("id").alias("_part"), F.lit(bytes(1 << (PART - 3))).alias("_bits"))  # the filter is as large for few records as for many
    known = again.mapInArrow(_fill, schema).unionByName(empty).groupBy("_part").applyInArrow(_unite, schema)
    byte = F.conv(F.hex(F.expr(f"substring(_bits, cast((_place & {(1 << PART) - 1}) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("cast(7 - _place % 8 as int)")
    placed = df.withColumn("_place", place).join(F.broadcast(known.withColumnRenamed("_part", "_own")), F.shiftright("_place", PART) == F.col("_own"), "left")
    maybe = F.coalesce(F.call_function("getbit", byte, bit) == 1, F.lit(False))
    flagged = placed.select(*df.columns, maybe.alias("_maybe"))
    return flagged.where("not _maybe").drop("_maybe").unionByName(flagged.where("_maybe").drop("_maybe").dropDuplicates(list(key)))
