"""Column expressions on text that the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The white space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
#: What separates words of letters and digits: every ASCII character that is neither. All of non-ASCII is word.
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone. Where all is ASCII, lower() does the same and is faster."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def without_spaces(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE_CLASS}+", "")


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def small_slices(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most so many rows and, but for a single larger row, so many bytes of that column.
    At the end Arrow's pool gives back what it no longer uses, which a reused worker would hold from stage to stage."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = min(max(start + 1, int(np.searchsorted(ends, before + size, side="right"))), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end
    pa.default_memory_pool().release_unused()
