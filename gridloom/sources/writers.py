"""Sinks: wide and sparse matrices, clustered rows, models and metrics; Parquet and JSON, no pickles."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_wide(matrix: DataFrame, names: list[str], path: str, column: str = "features") -> None:
    """One double column for each feature."""
    matrix.select("_row_id", *[F.get(column, F.lit(i)).cast("double").alias(n) for i, n in enumerate(names)]).write.mode("overwrite").parquet(path)


def sparse_long(matrix: DataFrame, column: str = "features") -> DataFrame:
    """(row_id, col, value) of the entries that are not 0."""
    return matrix.select(F.col("_row_id").alias("row_id"), F.posexplode(column).alias("col", "value")).where("value <> 0")


def write_sparse(matrix: DataFrame, path: str) -> None:
    sparse_long(matrix).write.mode("overwrite").parquet(path)


def write_clustered(rows: DataFrame, path: str) -> None:
    rows.drop("_row_id").write.mode("overwrite").parquet(path)


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document in a one-row text file, in any store."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> bool:
    """False, and nothing written, where there are no metrics."""
    if metrics:
        write_json(spark, metrics, path)
    return bool(metrics)
