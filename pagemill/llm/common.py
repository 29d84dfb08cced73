"""Shared plumbing of the training-data operators: table scans and Arrow batch maps."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import checkpoint_dir, ship

TOKENIZER_DIR = os.environ.get("PAGEMILL_TOKENIZERS", "/opt/tokenizers")


def scan(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """Read ``table`` and keep only ``columns`` so that the parquet scan is pruned."""
    ship(spark)
    checkpoint_dir(spark, fallback="/tmp/pagemill-checkpoints")  # the fallback serves tests in one process only
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch] | None], schema: str, rows: int = 2000) -> DataFrame:
    """mapInArrow with batches re-cut to at most ``rows`` rows, so that a worker's memory follows ``rows``, not the session's Arrow batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = fn(batch.slice(at, rows))
                if out is None:
                    continue
                if isinstance(out, pa.RecordBatch):
                    yield out
                else:
                    yield from out

    return df.mapInArrow(run, schema)


def batch(types: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    """A record batch of ``rows`` (tuples in the order of ``types``)."""
    columns = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types)], names=[n for n, _ in types])
