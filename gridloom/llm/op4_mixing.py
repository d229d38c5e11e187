"""Mixing sources to target weights by hash-threshold histograms. DataFrame operations only.

Every document has a fixed 60-bit hash of its id. A source's budget becomes a hash threshold: documents below it are
taken. The threshold is found from exact word sums by source and hash bucket; only the bucket on the boundary is split
again, so no round sorts documents, and a source of any size is spread over its buckets before anything is shuffled.
Thresholds are nested: a larger budget takes every document that a smaller one takes.

Null or blank text: size 0. Null source: a source of its own, last in order. Repeated rows share a hash and stand or
fall together. Empty table: no rows. Extra columns: ignored by `plan_mix`; `mix` keeps the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import WORD, fresh, materialize

WEIGHTS = (3, 1, 2)
HASH_BITS = 60
#: Bits of the hash resolved in a round: 4,096 sums a source and round.
ROUND_BITS = 12


def doc_hash(doc_id: Column) -> Column:
    """60 bits of md5 of the id as text; null ids hash as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id"),
        F.col("source"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        doc_hash(F.col("doc_id")).alias("h"),
    )


def targets(sizes: Sequence[int], weights: Sequence[int], share: Fraction, most: int) -> list[Fraction]:
    """Split share * sum(sizes) by weight, none above most * its size; what is cut off is shared again by weight."""
    left, free, out = share * sum(sizes), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while free:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > most * sizes[i]]
        if not full:
            for i in free:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = Fraction(most * sizes[i])
        left -= sum(out[i] for i in full)
        free -= set(full)
    return out


def _boundary(rows: DataFrame, needs: DataFrame, shift: int) -> DataFrame:
    """For each need (source, base hash, need): the bucket in which the running sum crosses it."""
    bits = min(ROUND_BITS, HASH_BITS)
    open_rows = rows.join(F.broadcast(needs), rows["source"].eqNullSafe(needs["n_source"])).where(
        F.shiftright("h", min(shift + bits, 62)) == F.shiftright("base", min(shift + bits, 62))
    )
    hist = open_rows.groupBy("n_id", F.shiftright("h", shift).alias("bucket")).agg(
        F.sum("size").alias("mass"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("need").alias("need")
    )
    upto = Window.partitionBy("n_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hist.withColumn("cum", F.sum("mass").over(upto))
        .where((F.col("cum") > F.col("need")) & (F.col("cum") - F.col("mass") <= F.col("need")))
        .select("n_id", "bucket", "mass", "lo", "hi", (F.col("need") - F.col("cum") + F.col("mass")).alias("rest"))
    )


def thresholds(rows: DataFrame, needs: dict[int, tuple[str | None, int]]) -> dict[int, int]:
    """Exclusive hash bound for each need: documents of its source below the bound sum to nearly the needed words."""
    spark = rows.sparkSession
    schema = T.StructType(
        [T.StructField("n_id", T.IntegerType()), T.StructField("n_source", T.StringType()), T.StructField("need", T.LongType()), T.StructField("base", T.LongType())]
    )
    pending = {i: (source, need, 0) for i, (source, need) in needs.items()}
    found: dict[int, int] = {}
    shift = HASH_BITS - ROUND_BITS
    while pending:
        frame = spark.createDataFrame([(i, *v) for i, v in pending.items()], schema)
        crossed = {r["n_id"]: r for r in _boundary(rows, frame, shift).collect()}
        for i, (source, _, _) in list(pending.items()):
            r = crossed.get(i)
            if r is None:  # all that is left of the source fits
                found[i] = 1 << HASH_BITS
            elif r["lo"] == r["hi"] or not shift:  # one hash value: all of it or nothing, whichever is nearer
                found[i] = r["hi"] + 1 if r["mass"] - r["rest"] < r["rest"] else r["lo"]
            else:
                pending[i] = (source, r["rest"], r["bucket"] << shift)
                continue
            del pending[i]
        shift = max(0, shift - ROUND_BITS)
    return found


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, times, taken for every document.

    The number of sources must fit the driver (one row each); the number of documents of a source need not.
    """
    spark = docs.sparkSession
    rows = materialize(sized(docs), "mix-sizes")
    totals = sorted(((r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size")).collect()), key=lambda x: (x[0] is None, x[0] or ""))
    goal = targets([n for _, n in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    whole = [min(most, int(t // n)) if n else 0 for t, (_, n) in zip(goal, totals, strict=True)]
    rest = {i: round(t - w * n) for i, (t, w, (_, n)) in enumerate(zip(goal, whole, totals, strict=True))}
    bounds = thresholds(rows, {i: (totals[i][0], need) for i, need in rest.items() if need > 0})
    schema = T.StructType(
        [
            T.StructField("p_source", T.StringType()),
            T.StructField("source_size", T.LongType()),
            T.StructField("target", T.DoubleType()),
            T.StructField("whole", T.IntegerType()),
            T.StructField("bound", T.LongType()),
        ]
    )
    plan = spark.createDataFrame([(s, n, float(goal[i]), whole[i], bounds.get(i, 0)) for i, (s, n) in enumerate(totals)], schema)
    times = F.least(F.col("whole") + (F.col("h") < F.col("bound")).cast("int"), F.lit(most))
    return rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["p_source"])).select(
        "doc_id", "source", "size", "source_size", "target", times.alias("times"), (F.col("size") * times).alias("taken"), "h", "whole", "bound"
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = Fraction(3, 2), most: int = 2) -> DataFrame:
    """The mixed table: each document as many times as the mix takes it, with the columns of `docs`. No text is shuffled."""
    spark = docs.sparkSession
    plan = plan_mix(docs, weights, share, most).groupBy("source").agg(F.first("whole").alias("whole"), F.first("bound").alias("bound"))
    name = fresh(docs, "plan")
    schema = T.StructType([T.StructField("source", T.StringType()), T.StructField("whole", T.IntegerType()), T.StructField("bound", T.LongType())])
    small = spark.createDataFrame([(tuple(r),) for r in plan.collect()], T.StructType([T.StructField(name, schema)]))
    times = F.least(F.col(f"{name}.whole") + (doc_hash(F.col("doc_id")) < F.col(f"{name}.bound")).cast("int"), F.lit(most))
    out = docs.join(F.broadcast(small), docs["source"].eqNullSafe(F.col(f"{name}.source")))
    return out.withColumn(name, F.explode(F.array_repeat(F.lit(0), times))).drop(name)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _level(n: int, last: bool = False) -> str:
    """One step of sharing out: sources above their cap are fixed; by the last step none is."""
    return f"""g{n + 1} AS MATERIALIZED (SELECT src, n, w, coalesce(fixed, CASE WHEN l * w / f > 2.0 * n THEN 2.0 * n END) AS fixed FROM (
      SELECT *, (SELECT 1.5 * sum(n) - coalesce(sum(fixed), 0) FROM g{n}) AS l, (SELECT sum(w) FROM g{n} WHERE fixed IS NULL) AS f FROM g{n}))"""


ORACLE = f"""
WITH d AS (SELECT doc_id, source AS src, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT src, sum(size)::BIGINT AS n FROM d GROUP BY src),
o AS (SELECT *, row_number() OVER (ORDER BY src IS NULL, encode(src)) - 1 AS k FROM s),
g0 AS (SELECT src, n, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, NULL::DOUBLE AS fixed FROM o),
{",".join(_level(i) for i in range(21))},
t AS (SELECT src, n, coalesce(fixed, ((SELECT 1.5 * sum(n) - coalesce(sum(fixed), 0) FROM g21) * w / (SELECT sum(w) FROM g21 WHERE fixed IS NULL))::DOUBLE) AS target FROM g21),
u AS (SELECT *, CASE WHEN n > 0 THEN least(2, floor(target / n))::BIGINT ELSE 0 END AS whole FROM t),
v AS (SELECT d.*, u.n, u.target, u.whole, round(u.target - u.whole * u.n) AS need FROM d JOIN u ON d.src IS NOT DISTINCT FROM u.src),
m AS (SELECT src, h, sum(size) AS mass FROM v GROUP BY src, h),
c AS (SELECT *, sum(mass) OVER (PARTITION BY src ORDER BY h) AS cum FROM m),
r AS (SELECT v.*, c.cum, c.mass FROM v JOIN c ON v.src IS NOT DISTINCT FROM c.src AND v.h = c.h)
SELECT doc_id, size, n AS source_size, target::DOUBLE AS target,
  (size * least(2, whole + CASE WHEN need > 0 AND (cum <= need OR (cum - mass <= need AND 2 * (need - cum + mass) > mass)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
