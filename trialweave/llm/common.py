"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from inspect import signature

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def text_of(column: str = "text") -> Column:
    """The text, null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that clash with no column of ``df``, whatever its columns are."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that an operator is about to add under the same names."""
    lower = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in lower])


def release_memory(collect: bool = True) -> None:
    """Give back what this Python process holds and does not use; ``collect``: cycles of objects too."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library, which returns memory by its own rules


def with_text(docs: DataFrame, text_col: str) -> tuple[DataFrame, str, bool]:
    """``docs`` with its text as a column of strings, the name of that column, and whether it was added.

    A column of strings is taken as it is, nulls included, so that tasks get each text once.
    """
    if dict(docs.dtypes).get(text_col) == "string":
        return docs, text_col, False
    (plain,) = fresh(docs, "plain_text")
    return docs.withColumn(plain, text_of(text_col)), plain, True


def slices(batch: pa.RecordBatch, column: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about ``most`` bytes of that column, so that memory stays bounded."""
    sizes = np.fromiter((len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)),
                        np.int64, batch.num_rows)
    parts = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def releasing_groups(run: Callable[..., pa.Table]):
    """``run`` over the rows of a group or a pair of groups; memory goes back after each."""
    def group(*tables: pa.Table) -> pa.Table:
        try:
            return run(*tables)
        finally:
            release_memory(collect=False)

    # Spark looks at the number of arguments.
    return (lambda left, right: group(left, right)) if len(signature(run).parameters) == 2 else (lambda rows: group(rows))


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over the batches of a task; memory goes back before and after it.

    Workers are reused by later stages, which else run on top of what earlier ones left.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        try:
            yield from run(batches)
        finally:
            release_memory()

    return task
