"""Shared set-up of the operators: worker code, checkpoint folder and byte-bounded batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from colloquy.session import ensure_checkpoint_dir, ship_package, staging_path, stored

#: Text bytes that a task handles at once; longer single texts form a batch of their own.
BATCH_BYTES = 1 << 20

__all__ = ["BATCH_BYTES", "prepare", "staging_path", "stored", "text_batches", "tidy", "read"]


def prepare(spark: SparkSession) -> None:
    """Ship the package to the Python workers and make sure that a checkpoint folder is set."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tidy() -> None:
    """Give freed memory back to the system: workers are kept between tasks, and what the allocators
    hold on to would count against the executor for good."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_TRIM = _trim()


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the Arrow batches with about ``BATCH_BYTES`` of text each, and the texts as
    UTF-8 (null: empty)."""
    for batch in batches:
        texts = [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > BATCH_BYTES:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]
        del texts
        tidy()
