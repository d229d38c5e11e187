"""Sharding by histogram sort: equal bytes to each shard, one exchange.

Sort key: (hash of the text, doc_id), so that equal texts lie side by side and a group of copies of any size can still
be cut between two documents. The driver holds candidate key boundaries; each round counts, over all partitions, the
exact bytes below them and narrows only the intervals that hold a splitter, until every splitter is within tolerance.
Only sums by interval leave the executors. Then each document goes once to its slice, a run of keys within a shard.

Null text: hash of null, size 1. Null doc_id: sorts first. Rows equal in text and doc_id are one key and stay together.
Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.llm.common import fresh, materialize

SHARDS = 16
#: Rows that one slice (the unit of the exchange and of the slot count) should hold at most.
SLICE_ROWS = 250_000
#: A splitter may be off its goal by this part of a shard's bytes.
TOLERANCE = 1e-3
#: Probes in an interval and round.
PROBES = 256
#: Leading bits of the key hash that find a document's splitters.
PREFIX_BITS = 12


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (h, d); h is not negative."""
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64("text"), 1).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("d"),
    )


def _count(keys: DataFrame, intervals: list[tuple[int, int, int, int]]) -> dict[int, list]:
    """Exact bytes and rows in PROBES equal steps of each interval (lo_h, hi_h, lo_d, hi_d)."""
    spark = keys.sparkSession
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("i", "lo_h", "hi_h", "lo_d", "hi_d", "prefix")])
    shift = 63 - PREFIX_BITS
    rows = [(i, *x, p) for i, x in enumerate(intervals) for p in range(x[0] >> shift, (x[1] >> shift) + 1)]
    probes = spark.createDataFrame(rows, schema)
    inside = F.col("h").between(F.col("lo_h"), F.col("hi_h")) & ((F.col("lo_h") < F.col("hi_h")) | F.col("d").between(F.col("lo_d"), F.col("hi_d")))
    big = "decimal(38,0)"
    step = lambda v, lo, hi: F.floor((F.col(v).cast(big) - F.col(lo).cast(big)) * F.lit(PROBES).cast("decimal(4,0)") / (F.col(hi).cast("decimal(20,0)") - F.col(lo).cast("decimal(20,0)") + 1))
    bin_ = F.when(F.col("lo_h") < F.col("hi_h"), step("h", "lo_h", "hi_h")).otherwise(step("d", "lo_d", "hi_d")).cast("int")
    got = (
        keys.withColumn("prefix", F.shiftright("h", shift))
        .join(F.broadcast(probes), "prefix")
        .where(inside)
        .groupBy("i", bin_.alias("bin"))
        .agg(F.sum("size"), F.min("h"), F.max("h"), F.min("d"), F.max("d"))
        .collect()
    )
    out: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r[0], r[1])):
        out.setdefault(r[0], []).append(tuple(r)[2:])
    return out


def splitters(keys: DataFrame, parts: int, tolerance: float) -> tuple[list[tuple[int, int]], int]:
    """Last key (h, d) of each part but the last, and the rounds it took; bytes of parts are equal within tolerance.

    The driver keeps parts - 1 intervals, never keys of documents beyond their bounds.
    """
    first = keys.agg(F.sum("size"), F.min("h"), F.max("h"), F.min("d"), F.max("d")).first()
    if first[0] is None:
        return [], 0
    total = first[0]
    slack = tolerance * total / parts
    state = [(tuple(first)[1:], 0, total * (j + 1) / parts) for j in range(parts - 1)]  # interval, bytes below it, goal
    done: list[tuple[int, int] | None] = [None] * len(state)
    rounds = 0
    while any(x is None for x in done):
        rounds += 1
        pending = list(dict.fromkeys((s[0], s[1]) for s, x in zip(state, done, strict=True) if x is None))
        counts, place = _count(keys, [p[0] for p in pending]), {p: i for i, p in enumerate(pending)}
        for j, ((interval, below, goal), x) in enumerate(zip(state, done, strict=True)):
            if x is not None:
                continue
            cum, last = below, None
            for mass, lo_h, hi_h, lo_d, hi_d in counts[place[interval, below]]:
                if abs(cum + mass - goal) <= slack:
                    done[j] = (hi_h, hi_d if lo_h == hi_h else 2**63 - 1)
                    break
                if cum + mass > goal:
                    if goal - cum <= slack and last is not None:
                        done[j] = last
                    elif lo_h == hi_h and lo_d == hi_d:  # one key
                        done[j] = last if last is not None and goal - cum < cum + mass - goal else (hi_h, hi_d)
                    else:
                        state[j] = ((lo_h, hi_h, lo_d, hi_d), cum, goal)
                    break
                cum += mass
                last = (hi_h, hi_d if lo_h == hi_h else 2**63 - 1)
    return sorted(x for x in done if x is not None), rounds


def _part(h: Column, d: Column, base: Column, inside: Column) -> Column:
    """Parts whose last key is below (h, d): those of smaller prefixes, plus the few with the same prefix."""
    return base + F.size(F.filter(inside, lambda s: (s["h"] < h) | ((s["h"] == h) & (s["d"] < d))))


def assign(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every document; slots follow the key within a shard."""
    spark = docs.sparkSession
    keys = materialize(keyed(docs), "shard-keys")
    n = keys.count()
    per_shard = max(2, -(-n // (shards * slice_rows)))
    cuts, _ = splitters(keys, shards * per_shard, tolerance / per_shard)
    shift = 63 - PREFIX_BITS
    prefixes = [h >> shift for h, _ in cuts]
    rows = []
    for p in range(1 << PREFIX_BITS):
        lo, hi = bisect_right(prefixes, p - 1), bisect_right(prefixes, p)
        rows.append((p, lo, [(h, d) for h, d in cuts[lo:hi]]))
    table = spark.createDataFrame(rows, "prefix long, base int, inside array<struct<h: bigint, d: bigint>>")
    parts = keys.withColumn("prefix", F.shiftright("h", shift)).join(F.broadcast(table), "prefix")
    parts = parts.select("doc_id", "size", "text_crc32", "h", "d", _part(F.col("h"), F.col("d"), F.col("base"), F.col("inside")).alias("part"))
    filled = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    before, offsets = 0, []
    for p in range(shards * per_shard):
        before = 0 if p % per_shard == 0 else before
        offsets.append((p, p // per_shard, before))
        before += filled.get(p, 0)
    places = spark.createDataFrame(offsets, "part int, shard int, offset long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("h", "d"))
    return (
        parts.withColumn("__rank", rank)
        .join(F.broadcast(places), "part")
        .select("doc_id", "size", "text_crc32", "shard", (F.col("offset") + F.col("__rank") - 1).alias("slot"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """Write whole documents by shard (`shard=<n>/`), in slot order; rows that share a doc_id and text share a shard.

    Where `docs` has a column `shard`, that of the folders has underscores behind its name.
    """
    shard, slot = fresh(docs, "shard"), fresh(docs, "slot")
    places = assign(docs, shards).groupBy("doc_id", "text_crc32").agg(F.min(F.struct("shard", "slot")).alias("place"))
    places = places.select(F.struct("doc_id", "text_crc32").alias(fresh(docs, "key")), F.col("place.shard").alias(shard), F.col("place.slot").alias(slot))
    key = places[places.columns[0]]
    same = docs["doc_id"].eqNullSafe(key["doc_id"]) & F.crc32(docs["text"].cast("binary")).eqNullSafe(key["text_crc32"])
    out = docs.join(places, same).drop(key)
    out.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).drop(slot).write.partitionBy(shard).parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return assign(docs).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
