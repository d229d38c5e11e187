"""Exact seeded samples by hash threshold: a filter, not a global sort.

The hash is the first 60 bits of an MD5 of seed and key, so any engine that has MD5 names the same rows, and neither
splits nor partitions change them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 60
#: Leading bits of the sketch: counts by bucket of the hash, which add up over partitions.
SKETCH_BITS = 14


def seeded_hash(key: Column, seed: int) -> Column:
    """A number from 0 to 2 ** 60 - 1."""
    text = F.concat(F.lit(f"{seed}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sketch(df: DataFrame, h: Column) -> list[tuple[int, int]]:
    """(bucket, rows) by leading bits of the hash, in order: one job, at most 2 ** SKETCH_BITS sums."""
    counts = df.groupBy(F.shiftright(h, HASH_BITS - SKETCH_BITS).alias("bucket")).count()
    return sorted((r["bucket"], r["count"]) for r in counts.collect())


def limit(df: DataFrame, wanted: Callable[[int], int], seed: int, key: str = "_row_id") -> tuple[int, int] | int:
    """(hash, key) of the last of the wanted(rows) rows of smallest hash; 0 if none is wanted, -1 if all are.

    One job counts by bucket, which gives the number of rows and the bucket that holds the last row; a second looks at
    that bucket alone. What reaches the driver is counts and one row.
    """
    h = seeded_hash(F.col(key), seed)
    counts = sketch(df.select(key), h)
    n = sum(c for _, c in counts)
    k, before = wanted(n), 0
    if k >= n:
        return -1
    if k <= 0:
        return 0
    for bucket, c in counts:
        if before + c >= k:
            break
        before += c
    inside = df.select(F.struct(h.alias("h"), F.col(key).alias("k")).alias("x")).where(F.shiftright("x.h", HASH_BITS - SKETCH_BITS) == bucket)
    return tuple(inside.orderBy("x").limit(k - before).agg(F.max("x").alias("x")).first()["x"])


def up_to(df: DataFrame, last: tuple[int, int] | int, seed: int, key: str = "_row_id") -> DataFrame:
    """The rows up to a limit: a filter."""
    if not isinstance(last, tuple):
        return df if last else df.limit(0)
    h = seeded_hash(F.col(key), seed)
    return df.where((h < last[0]) | ((h == last[0]) & (F.col(key) <= F.lit(last[1]))))


def exact_rows(df: DataFrame, k: int, seed: int, key: str = "_row_id") -> DataFrame:
    """The k rows of smallest (hash of seed and key, key), or all; `key` is unique and not null."""
    return up_to(df, limit(df, lambda _: k, seed, key), seed, key)


def sample_fraction(df: DataFrame, frac: float | None, seed: int, key: str = "_row_id") -> DataFrame:
    """Exactly round(frac * n) rows (half to even) without replacement; no fraction, or one from 1 on, keeps all."""
    if not frac or frac >= 1:
        return df
    return up_to(df, limit(df, lambda n: round(frac * n), seed, key), seed, key)


def sample_numbered(df: DataFrame, n: int, frac: float | None, seed: int, key: str = "_row_id") -> DataFrame:
    """`sample_fraction` of rows whose keys are 0 to n - 1: the limit is found from the numbers, so `df` is not read for it."""
    if not frac or frac >= 1:
        return df
    numbers = df.sparkSession.range(n).select(F.col("id").alias(key))
    return up_to(df, limit(numbers, lambda _: round(frac * n), seed, key), seed, key)
