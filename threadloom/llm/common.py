"""What the operators share: the shared folder, written tables, column picking, folds and Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import drop_table, new_path, scratch, shared_dir, write_table

__all__ = ["chunks", "drop_table", "fold", "held_out", "new_path", "pick", "rest", "scratch", "shared_dir", "slices", "with_text_filter", "write_table"]

#: Characters of text that are worked on at once in a Python worker. One longer text is taken alone.
CHUNK_CHARS = 2_000_000


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns only, found by exact name first and by name without case after that; other columns may clash with any of them."""
    cols = df.columns
    spots = []
    for name in names:
        exact = [i for i, c in enumerate(cols) if c == name]
        loose = [i for i, c in enumerate(cols) if c.lower() == name.lower()]
        if not loose:
            raise ValueError(f"no column {name!r} among {cols}")
        spots.append((exact or loose)[0])
    return df.toDF(*[f"_c{i}" for i in range(len(cols))]).select(*[F.col(f"_c{i}").alias(n) for i, n in zip(spots, names, strict=True)])


def with_text_filter(df: DataFrame, text_col: str, keep) -> DataFrame:
    """The rows of df, all columns as they are, for which keep(Column of the text) holds."""
    cols = df.columns
    at = next((i for i, c in enumerate(cols) if c == text_col), None)
    if at is None:
        raise ValueError(f"no column {text_col!r} among {cols}")
    return df.toDF(*[f"_c{i}" for i in range(len(cols))]).where(keep(F.col(f"_c{at}"))).toDF(*cols)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 2


def chunks(batch: pa.RecordBatch, text_at: int = 1, chars: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of a batch that hold about so many characters of text, with that column as a list."""
    start, size = 0, 0
    lengths = pc.binary_length(batch.column(text_at)).fill_null(0).to_numpy(zero_copy_only=False)
    for i, n in enumerate(lengths):
        if size and size + n > chars:
            part = batch.slice(start, i - start)
            yield part, part.column(text_at).to_pylist()
            start, size = i, 0
        size += int(n)
    if batch.num_rows > start:
        part = batch.slice(start)
        yield part, part.column(text_at).to_pylist()


def slices(texts: pd.Series, chars: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """A series of texts in lists of about so many characters, with None for null."""
    part: list[str | None] = []
    size = 0
    for text in texts:
        own = None if text is None or text is pd.NA else text
        if size and size + len(own or "") > chars:
            yield part
            part, size = [], 0
        part.append(own)
        size += len(own or "")
    if part:
        yield part


def rest() -> None:
    """Hands memory that a task has freed back to the system, since a worker lives on and others share its machine."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)
