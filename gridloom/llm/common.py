"""Helpers shared by the corpus operators: words, shared scratch tables, driver-side size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Keys that a broadcast filter may hold (16 bytes a key); above it the same filter is a shuffled semi join.
BROADCAST_KEYS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir`.

    Where the session has none, a temporary folder is set, which is only right for a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Folders of tables that operators wrote for themselves, in order.
_WRITTEN: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, which `discard` may delete."""
    _WRITTEN.append(f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}")
    return _WRITTEN[-1]


def written() -> int:
    """How many such folders there are: where a later `discard` starts."""
    return len(_WRITTEN)


def discard(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since then, but the last `keep`. What was read from them must have been used up.

    A result that is not written out yet still reads them; so operators leave this to their callers.
    """
    stop = len(_WRITTEN) - keep
    for path in _WRITTEN[since:stop]:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    del _WRITTEN[since:stop]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until `df` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once to the shared folder as Parquet and read it back; cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of texts at most: some MB of ordinary documents.
TEXT_BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Send texts to Python in small Arrow batches (a session setting): a worker holds a batch in several copies."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= TEXT_BATCH_ROWS:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts give an empty array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it in `body`: inside a lambda a plain column would be evaluated per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def semi_join_ids(df: DataFrame, ids: DataFrame, key: str, n_ids: int, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on `key`, broadcast only while the counted keys are under `BROADCAST_KEYS`."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_KEYS else ids, key, how)


def fold_mod5(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5, the fold that decides which labels and texts may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


#: Buckets at most: their first keys are a literal of the plan (some 20 bytes each).
MOST_BUCKETS = 1_000_000


class ByteBuckets:
    """Runs of rows in the order of (d, tie) of about equal bytes: none passes `bucket_bytes` by more than its last row.

    Keys and sizes alone are sorted by one range exchange; sums of what lies before a row give its bucket, and the first
    key of each bucket reaches the driver. Rows that share one d are cut by tie; rows equal in both are one key.
    """

    def __init__(self, keys: DataFrame, bucket_bytes: int, least: int = 1):
        """keys: d, tie, size, not null."""
        total = keys.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        goal = max(1, min(bucket_bytes, -(-total // least)), -(-total // MOST_BUCKETS))
        at = F.monotonically_increasing_id()
        dealt = keys.repartitionByRange("d", "tie").sortWithinPartitions("d", "tie").select("d", "tie", "size", at.alias("at"))
        dealt = materialize(dealt.withColumn("part", F.shiftright("at", 33)), "bucket-keys")
        earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part
        parts = dealt.groupBy("part").agg(F.sum("size").alias("bytes")).select("part", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("base"))
        inside = F.sum("size").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        below = dealt.withColumn("inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(parts), "part")
        firsts = below.groupBy(F.floor((F.col("base") + F.col("inside")) / goal).alias("bucket")).agg(F.min(F.struct("d", "tie")).alias("first"))
        self.firsts = sorted({(r["first"]["d"], r["first"]["tie"]) for r in firsts.select("first").collect()})

    def __len__(self) -> int:
        return max(1, len(self.firsts))

    def _literal(self, place: int) -> Column:
        return F.split(F.lit(",".join(str(f[place]) for f in self.firsts)), ",").cast("array<bigint>")  # folded once

    def of(self, d: Column, tie: Column) -> Column:
        """The bucket of a key: how many first keys are not above it, by halving."""
        if len(self.firsts) < 2:
            return F.lit(0)
        ds, ties = self._literal(0), self._literal(1)
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(self.firsts).bit_length()))])

        def wider(n: Column, step: Column) -> Column:
            a, b = F.get(ds, n + step - 1), F.get(ties, n + step - 1)
            return F.when((a < d) | ((a == d) & (b <= tie)), n + step).otherwise(n)

        return F.greatest(F.aggregate(steps, F.lit(0), wider) - 1, F.lit(0))

    def is_first(self, bucket: Column, d: Column, tie: Column) -> Column:
        """Whether a key is the first of its bucket."""
        if not self.firsts:
            return F.lit(False)
        return (F.get(self._literal(0), bucket) == d) & (F.get(self._literal(1), bucket) == tie)
