"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.plans.stages import fresh_path, materialise, shared_dir  # noqa: F401

#: The white space that the text contracts name: space and U+0009 to U+000D.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col):
    return F.translate(col, UPPER, LOWER)


def text_slices(column, size: int = 1 << 21):
    """Slices (from, to, list of strings) of an Arrow string column, of about ``size`` bytes each, one text at least: what Python holds at a time doesn't depend on the batch."""
    import numpy as np
    import pyarrow.compute as pc

    upto = np.cumsum(pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(column):
        done = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + size, "right")))
        yield lo, hi, column.slice(lo, hi - lo).to_pylist()
        lo = hi
