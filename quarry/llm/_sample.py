"""Labelled samples for fitting classifiers: bounded, the same on every run, and free of held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(key: str | Column) -> Column:
    """crc32 of the key's text modulo 5 is 0; false for a null key."""
    column = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def pick(rows: DataFrame, key: str | list[str], most: int, seed: int) -> DataFrame:
    """About `most` rows, chosen by a hash of the key columns alone, so reruns choose the same.

    The number of different keys is binomial: above 1.1 * most with probability below exp(-most / 300).
    Rows that agree in all key columns are chosen together; callers count them once.
    """
    n = rows.count()
    if n <= most:
        return rows
    unit = 1 << 30
    return rows.filter(F.pmod(F.xxhash64(F.lit(seed), *([key] if isinstance(key, str) else key)), F.lit(unit)) < int(unit * most / n))
