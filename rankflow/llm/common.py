"""Reading tables, bounded Arrow slices and stored stages for the operators of this folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.sources.scratch import materialize

__all__ = ["crc_mod", "materialize", "offsets", "ragged", "sliced", "table", "text_bytes"]

SLICE_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(name: str) -> Column:
    """A text column as UTF-8 bytes, null as empty."""
    return F.coalesce(F.col(f"`{name}`"), F.lit("")).cast("binary")


def crc_mod(name: str, n: int) -> Column:
    """crc32 of an id written as text, modulo n. A null id counts as remainder 0 of the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")).cast("binary")) % n


def plain_sizes(values: pa.Array) -> np.ndarray:
    return pc.binary_length(values).fill_null(0).to_numpy(zero_copy_only=False)


def sliced(batches: Iterator[pa.RecordBatch], column: int, limit: int = SLICE_BYTES, sizes: Callable[[pa.Array], np.ndarray] = plain_sizes) -> Iterator[pa.RecordBatch]:
    """Row slices whose column holds about ``limit`` bytes by ``sizes``, one row at least: bounds a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(sizes(batch.column(column)).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def offsets(lengths: np.ndarray) -> np.ndarray:
    """Start of each of consecutive runs, and the end of the last."""
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of the runs [start, start + length) one after another."""
    at = offsets(lengths)
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths)
