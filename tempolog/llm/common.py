"""Helpers shared by the training-data operators: batches of texts, bounded caches, stored intermediates."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tempolog.session import durable

__all__ = ["Cache", "WordHashes", "durable", "int64", "map_batches", "map_partitions", "ragged", "ship", "text_bytes", "text_or_empty"]

# Entries kept by a cache of a Python worker; beyond it, entries are computed again each time they are met.
CACHE_ENTRIES = 150_000
# Rows that are worked on at once, of the batches that arrive: bounds the Python copies of texts.
ROWS = 2000


class Cache(dict):
    """A dict that computes missing entries and keeps a bounded number of them."""

    def __init__(self, compute: Callable, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.compute, self.entries = compute, entries

    def __missing__(self, key):
        value = self.compute(key)
        if len(self) < self.entries:
            self[key] = value
        return value


class WordHashes(Cache):
    """64-bit hashes of words given as bytes."""

    def __init__(self):
        super().__init__(xxhash.xxh64_intdigest)

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null counts as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def int64(values) -> pa.Array:
    """Unsigned 64-bit values as the signed longs that Spark stores."""
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def ragged(parts: list[np.ndarray], kind) -> pa.ListArray:
    """A list column from one array per row."""
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.astype(kind)))


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application; their Python need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-')}/{package.name}", "zip", package.parent, package.name)
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def map_partitions(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, start: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str | StructType,
                rows: int = ROWS) -> DataFrame:
    """Arrow batches, ``rows`` at a time, through a function that ``start`` makes once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = work(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out

    return map_partitions(df, run, schema)
