"""Buckets of consecutive keys by bytes: even whatever ids and lengths are like."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm.common import ByteBuckets


def sums(spark, keys, bucket_bytes, least=1):
    df = spark.createDataFrame(keys, "d long, tie long, size long").repartition(5)
    buckets = ByteBuckets(df, bucket_bytes, least)
    placed = df.select("d", "tie", "size", buckets.of(F.col("d"), F.col("tie")).alias("b"))
    rows = placed.select("*", buckets.is_first(F.col("b"), F.col("d"), F.col("tie")).alias("first")).collect()
    out, last = collections.Counter(), 0
    for r in sorted(rows, key=lambda r: (r["d"], r["tie"])):
        assert r["b"] in (last, last + 1) and r["first"] == (r["b"] not in out or (r["d"], r["tie"]) == head)
        if r["b"] not in out:
            head = (r["d"], r["tie"])
        last = r["b"]
        out[r["b"]] += r["size"]
    assert sum(out.values()) == sum(k[2] for k in keys) and len(out) == len(buckets)
    return out


def test_all_length_in_the_last_ids(spark):
    got = sums(spark, [(i, 0, 10 if i < 9800 else 10_000) for i in range(10_000)], 50_000)
    mean = sum(got.values()) / len(got)
    assert max(got.values()) <= 60_000 and max(got.values()) <= 2 * mean


def test_uneven_ids(spark):
    rng = random.Random(1)
    got = sums(spark, [(int(10 ** rng.uniform(0, 18)), i, 11) for i in range(20_000)], 1_000)
    mean = sum(got.values()) / len(got)
    assert max(got.values()) <= 1_011 and max(got.values()) <= 2 * mean


@pytest.mark.parametrize("d", [7, -(2**63)])
def test_one_id_alone(spark, d):
    got = sums(spark, [(d, i * 17 - 8000, 10) for i in range(1000)], 500)
    assert len(got) == 20 and max(got.values()) == 500


def test_few_and_equal_rows(spark):
    assert len(sums(spark, [(1, 1, 5)], 100, 64)) == 1
    assert len(sums(spark, [(1, 1, 5), (2, 0, 5), (3, 0, 5)], 100, 64)) == 3
    assert dict(sums(spark, [(1, 1, 5)] * 50 + [(2, 1, 5)] * 50, 20)) == {0: 250, 1: 250}
    empty = spark.createDataFrame([], "d long, tie long, size long")
    assert len(ByteBuckets(empty, 10)) == 1
