"""Sources: delimited files with their own type inference, and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import SEED
from gridloom.functions import scalar
from gridloom.functions.sampling import sample_numbered
from gridloom.sources import delimited

ROW_ID = "_row_id"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether any store that Spark reads has the path."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def infer_types(df: DataFrame) -> dict[str, str]:
    """Type of each text column over all rows: long, double (also longs with nulls), boolean or string; one pass."""
    asks = []
    for i, c in enumerate(df.columns):
        v = scalar.null_tokens(F.col(f"`{c}`"))
        number = scalar.to_number(v)
        whole = F.when(F.trim(v).rlike("^[+-]?[0-9]+$"), F.trim(v)).try_cast("long")
        flag = v.isin("True", "TRUE", "true", "False", "FALSE", "false")
        asks += [F.count(v).alias(f"n{i}"), F.count(whole).alias(f"l{i}"), F.count(number).alias(f"d{i}"), F.count_if(flag).alias(f"b{i}")]
    got = df.agg(F.count(F.lit(1)).alias("n"), *asks).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = got[f"n{i}"]
        if n and got[f"l{i}"] == n:
            out[c] = "long" if n == got["n"] else "double"
        elif got[f"d{i}"] == n:
            out[c] = "double"
        else:
            out[c] = "boolean" if got[f"b{i}"] == got["n"] else "string"
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns that have a type in `types` cast to it, others as they are."""
    cols = []
    for c in df.columns:
        if c not in types:
            cols.append(F.col(f"`{c}`"))
            continue
        v, kind = scalar.null_tokens(F.col(f"`{c}`")), types[c]
        cols.append((v if kind == "string" else scalar.to_number(v) if kind == "double" else F.trim(v).try_cast(kind)).alias(c))
    return df.select(*cols)


def load(spark: SparkSession, path: str, sample_frac: float | None = None, sep: str = ";", seed: int = SEED) -> DataFrame:
    """Typed rows with `_row_id`, their number in the file, by which labels are joined back; optionally an exact sample.

    Types are those of all rows. Numbers, and so the sampled rows, are the same however the file is split.
    """
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    raw, n = delimited.read_columns(spark, path, sep, ROW_ID)
    types = infer_types(raw.drop(ROW_ID))
    return sample_numbered(typed(raw, types), n, sample_frac, seed, ROW_ID)


def vectors(df: DataFrame, column: str, key: str) -> DataFrame:
    """Any table with a vector column as (`_row_id`, `features`)."""
    return df.select(F.col(key).cast("long").alias(ROW_ID), F.col(column).cast("array<double>").alias("features"))
