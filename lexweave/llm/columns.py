"""Tables that have columns of their own with the names that an operator uses."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def replaced(docs: DataFrame, own: Iterable[str]) -> DataFrame:
    """``docs`` without the columns whose names an operator gives its results."""
    taken = {x.lower() for x in own}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def sheltered(docs: DataFrame, kept: Iterable[str] = ("doc_id", "text", "n_chars")) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but ``kept`` under names that no operator uses, and the columns that undo it."""
    kept = {x.lower() for x in kept}
    names = {c: c if c.lower() in kept else f"__own_{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`") if c == n else F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


def as_kind(docs: DataFrame, column: str, name: str, kind: str) -> Column:
    """A column of this name and type; bare where it is so already, as an alias keeps Spark from seeing that two exchanges are one."""
    return F.col(column) if column == name and docs.schema[column].dataType.simpleString() == kind else F.col(column).cast(kind).alias(name)


def trimmed(work: Callable[..., Iterator[pa.RecordBatch]]) -> Callable[..., Iterator[pa.RecordBatch]]:
    """``work`` on batches that gives back to the system what it no longer needs: Python workers are used again, and would keep it."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch], **options) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches, **options)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform.startswith("linux") else None
            if trim:
                trim(0)

    return run
