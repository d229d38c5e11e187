"""Profiling: row counts, types, nulls, distinct values, summaries, frequent values, matrix density."""

from __future__ import annotations

import resource
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    """Text columns; booleans are in neither list."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def shape_nulls(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, null_cells."""
    nulls = sum((F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in df.columns), F.lit(0).cast("long"))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), F.coalesce(nulls, F.lit(0)).alias("null_cells"))


def type_counts(df: DataFrame) -> DataFrame:
    rows = sorted(Counter(t for _, t in df.dtypes).items(), key=lambda x: (-x[1], x[0]))
    return df.sparkSession.createDataFrame(rows, "dtype string, n long")


def _stacked(df: DataFrame, columns: list[str], exprs: list, name: str) -> DataFrame:
    """One row a column from a one-row aggregate."""
    wide = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)])
    pairs = ", ".join(f"'{c.replace(chr(39), chr(39) * 2)}', c{i}" for i, c in enumerate(columns))
    return wide.selectExpr(f"stack({len(columns)}, {pairs}) AS (column, {name})")


def top_missing(df: DataFrame, k: int = 20) -> DataFrame:
    """Columns with most nulls, columns without any included."""
    cols = df.columns
    return _stacked(df, cols, [F.sum(F.col(f"`{c}`").isNull().cast("long")) for c in cols], "nulls").orderBy(F.desc("nulls"), "column").limit(k)


#: Values of a column that a task holds before it sends them.
DICTIONARY = 1 << 18


def _dictionaries(values: DataFrame, most: int) -> DataFrame:
    """(column, value): the different values of each column that a task has met; once, but where a dictionary was full."""
    names, n_columns = ["column", "value"], len(values.columns)

    def told(k: int, found: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k] * len(found), pa.int32()), found], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[pa.Array]] = [[] for _ in range(n_columns)]
        for b in batches:
            for k, column in enumerate(b.columns):
                held[k].append(column.unique().drop_null())
                if sum(map(len, held[k])) > most:
                    found = pa.concat_arrays(held[k]).unique()
                    held[k] = [found]
                    if len(found) > most // 2:
                        yield told(k, found)
                        held[k] = []
        for k, parts in enumerate(held):
            if parts:
                yield told(k, pa.concat_arrays(parts).unique())

    return values.mapInArrow(rows, "column int, value string")


def distinct_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Exact distinct counts without nulls, of all columns by one pass.

    Tasks merge dictionaries of the columns' values, so a row is nowhere copied for each column, and what is shuffled
    follows the different values. Both zeros are one value, as are all NaN; values of nested types are counted by Spark.
    """
    cols = columns or df.columns
    kinds = {f.name: f.dataType for f in df.schema.fields}
    nested = [c for c in cols if isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType, T.VariantType, T.BinaryType))]
    flat = [c for c in cols if c not in nested]
    real = lambda c: isinstance(kinds[c], (T.DoubleType, T.FloatType))
    text = [(F.col(f"`{c}`") + F.lit(0.0).cast(kinds[c]) if real(c) else F.col(f"`{c}`")).cast("string").alias(f"c{i}") for i, c in enumerate(flat)]
    out = []
    if flat:
        counts = _dictionaries(df.select(*text), DICTIONARY).groupBy("column", "value").agg(F.lit(1)).groupBy("column").agg(F.count(F.lit(1)).alias("n"))
        names = df.sparkSession.createDataFrame(list(enumerate(flat)), "k int, name string")
        out.append(names.join(F.broadcast(counts), F.col("k") == F.col("column"), "left").select(F.col("name").alias("column"), F.coalesce("n", F.lit(0)).alias("distinct_values")))
    if nested:
        out.append(_stacked(df, nested, [F.count_distinct(F.col(f"`{c}`")) for c in nested], "distinct_values"))
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    cols = columns or numeric_columns(df)
    wide = df.agg(*[f(F.col(f"`{c}`").cast("double")).alias(f"{n}{i}") for i, c in enumerate(cols) for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))])
    pairs = ", ".join(f"'{c}', lo{i}, hi{i}, mean{i}" for i, c in enumerate(cols))
    return wide.selectExpr(f"stack({len(cols)}, {pairs}) AS (column, min_value, max_value, mean_value)")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) of all text columns in one pass, nulls left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
    return df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """The k commonest values a column; ties by value."""
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return value_counts(df, columns).withColumn("rank", rank).where(F.col("rank") <= k)


def matrix_density(matrix: DataFrame, column: str = "features") -> DataFrame:
    """n_rows, n_features, n_nonzero, density."""
    nonzero = F.size(F.filter(column, lambda v: v != 0)).cast("long")
    got = matrix.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size(column)).cast("long").alias("n_features"), F.sum(nonzero).alias("n_nonzero"))
    return got.withColumn("density", F.try_divide("n_nonzero", F.col("n_rows") * F.col("n_features")))


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the table's size."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def driver_memory_mb() -> float:
    """Resident memory of the driver's Python in MB; 0.0 if it can't be read."""
    try:
        return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024
    except (OSError, ValueError):
        return 0.0


def memory_available(required_mb: float = 1000) -> bool:
    """Whether so many MB are free on the driver; True if that can't be read."""
    try:
        with open("/proc/meminfo") as f:
            return next(int(x.split()[1]) for x in f if x.startswith("MemAvailable")) / 1024 >= required_mb
    except (OSError, StopIteration, ValueError):
        return True


def narrow_types(df: DataFrame) -> DataFrame:
    """double to float and long to int, other columns as they are. A long out of range keeps its low 32 bits."""

    def narrow(c: str, t: str):
        v = F.col(f"`{c}`")
        return v.cast("float").alias(c) if t == "double" else F.shiftright(F.shiftleft(v, 32), 32).cast("int").alias(c) if t == "bigint" else v

    return df.select(*[narrow(c, t) for c, t in df.dtypes])
