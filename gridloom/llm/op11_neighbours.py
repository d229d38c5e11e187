"""Approximate nearest neighbours by shifted space-filling curves: smallest Euclidean distance.

Vectors are projected on a few random directions and ordered along a Hilbert curve through the grid of their quantiles,
several times, each time with other directions and another shift. Every ordering is sorted by a range exchange of keys
alone, which gives each row its exact rank, and cut into blocks of equal row counts. A second exchange brings to each
block its rows, as bytes with an error bound, and the queries whose window of neighbouring keys reaches into it. A block
keeps every row that may be among a query's nearest by those bounds; the windows of all orderings are merged, and what is
still possible is ranked again by distances of the original vectors.

The width of the windows is measured, not set: for a bounded number of probes the true neighbours are found by one pass
over all rows, and the window is what holds TARGET of them in some ordering. Vectors of little structure need windows of
a part of all rows, whatever the index; the block grows with the window, so that a query is sent to five blocks an
ordering at most.

Equal vectors are indexed once, under their smallest id, and expanded in the result, so copies cost nothing and their
ties go to the smaller ids. Null ids, and vectors that are null, empty, zero or hold null or non-finite components take no
part; nor do vectors of another length than the commonest (the shorter, if several are). Of rows that repeat an id one
counts, that of the smallest hash. Fewer than k candidates: all. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import BROADCAST_KEYS, materialize
from gridloom.llm.hilbert import Curves

K, EVERY = 10, 100
ORDERINGS, DIMS, BITS = 8, 8, 7
#: Numbers (rows times components) of the sample that directions and quantiles are fitted on; rows at most.
SAMPLE_VALUES, SAMPLE_ROWS = 2_000_000, 20_000
#: Probes, and the part of their neighbours that the windows must hold.
PROBES, TARGET = 128, 0.95
LEAST_WINDOW, LEAST_BLOCK = 1024, 1024
#: Blocks of all orderings at most: their first keys are sent to all tasks.
MOST_BLOCKS = 1_000_000
#: Distances computed at once.
PRODUCT = 1 << 21


def usable(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, int]:
    """((id, v, k1, k2) of the rows that take part, length of the vectors); k1 and k2 are hashes of the vector."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.exists("v", lambda x: x != 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common[0] if common else 0
    plain = F.transform("v", lambda x: x + F.lit(0.0))  # -0.0 becomes 0.0
    rows = rows.where(F.size("v") == dim).withColumns({"k1": F.xxhash64(plain), "k2": F.xxhash64(F.lit(1), plain)})
    hashes = F.struct("k1", "k2")
    again = materialize(rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(hashes).alias("one")).where("n > 1").select("id", "one"), "ann-repeated")
    if again.isEmpty():
        return rows, dim
    few = F.broadcast(again) if again.count() <= BROADCAST_KEYS else again
    return rows.join(few, "id", "left_anti").unionByName(rows.join(few, "id").where(hashes == F.col("one")).drop("one").dropDuplicates(["id"])), dim


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    square = (q**2).sum(axis=1)[:, None] - 2 * q @ x.T + (x**2).sum(axis=1)[None]
    return np.sqrt(np.maximum(square, 0))


def ranked(rows: DataFrame, curves: Curves) -> DataFrame:
    """(o, key, id, rank): every row's rank in every ordering, by one range exchange of keys."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b["v"])
                for o in range(len(curves)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), o, np.int32)), pa.array(curves.keys(x, o)), b["id"]], ["o", "key", "id"])

    dealt = rows.select("id", "v").mapInArrow(keys, "o int, key long, id long").repartitionByRange("o", "key", "id").sortWithinPartitions("o", "key", "id")
    dealt = materialize(dealt.select("o", "key", "id", F.monotonically_increasing_id().alias("at")).withColumn("part", F.shiftright("at", 33)), "ann-keys")
    sums = dealt.groupBy("o", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("o").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("o", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))  # a row for each part and ordering in it
    return dealt.join(F.broadcast(offsets), ["o", "part"]).select("o", "key", "id", (F.col("at") + F.col("shift")).alias("rank"))


def window(rows: DataFrame, places: DataFrame, ids: np.ndarray, probes: np.ndarray, k: int, target: float = TARGET) -> int:
    """Ranks to either side that hold `target` of the probes' true neighbours in the ordering that suits each best."""
    spark = rows.sparkSession

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, c = np.full((len(ids), k), np.inf), np.zeros((len(ids), k), np.int64)
        for b in batches:
            x, own, most = _matrix(b["v"]), b["id"].to_numpy(), max(1, PRODUCT // len(ids))
            for at in range(0, len(own), most):
                part = own[at : at + most]
                gap = _distances(probes, x[at : at + most])
                gap[ids[:, None] == part[None]] = np.inf
                d, c = np.hstack([d, gap]), np.hstack([c, np.broadcast_to(part, gap.shape)])
                best = np.argpartition(d, k - 1, axis=1)[:, :k]
                d, c = np.take_along_axis(d, best, 1), np.take_along_axis(c, best, 1)
        p, j = np.nonzero(np.isfinite(d))
        yield pa.RecordBatch.from_arrays([pa.array(ids[p], pa.int64()), pa.array(c[p, j]), pa.array(d[p, j])], ["probe", "id", "d"])

    order = F.row_number().over(Window.partitionBy("probe").orderBy("d", "id"))
    found = rows.select("id", "v").mapInArrow(nearest, "probe long, id long, d double").withColumn("r", order).where(F.col("r") <= k).select("probe", "id").collect()
    if not found:
        return 0
    wanted = sorted({r[0] for r in found} | {r[1] for r in found})  # (k + 1) x probes
    seen = places.join(F.broadcast(spark.createDataFrame([(i,) for i in wanted], "id long")), "id").select("id", "o", "rank").collect()
    rank = {(r["id"], r["o"]): r["rank"] for r in seen}
    orderings = {r["o"] for r in seen}
    gaps = [min(abs(rank[q, o] - rank[c, o]) for o in orderings) for q, c in found]
    return int(np.quantile(gaps, target, method="higher"))


class Blocks:
    """First (key, id) of each block of each ordering, to find the block of any row."""

    def __init__(self, firsts: pa.Table):
        self.by = {}
        o = firsts["o"].to_numpy()
        for x in np.unique(o):
            own = firsts.filter(pa.array(o == x))
            key, id_ = own["key"].to_numpy(), own["id"].to_numpy()
            order = np.lexsort((id_, key))
            self.by[int(x)] = key[order], id_[order]

    def find(self, o: int, key: np.ndarray, id_: np.ndarray) -> np.ndarray:
        keys, ids = self.by[o]
        lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
        out = hi - 1
        for a, b in {(a, b) for a, b in zip(lo, hi, strict=True) if a < b}:  # blocks that start within one key
            same = np.nonzero((lo == a) & (hi == b))[0]
            out[same] = a + np.searchsorted(ids[a:b], id_[same], "right") - 1
        return out

    def count(self, o: int) -> int:
        return len(self.by[o][0])


def _packed(x: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Vectors as bytes, with what to multiply them by, and the length of what that misses."""
    scale = np.maximum(np.abs(x).max(axis=1) / 127, np.finfo(np.float64).tiny)
    small = np.rint(x / scale[:, None]).astype(np.int8)
    return [r.tobytes() for r in small], scale, np.sqrt(((x - small * scale[:, None]) ** 2).sum(axis=1))


def _block_rows(rows: DataFrame, curves: Curves, blocks: Blocks, reach: int) -> DataFrame:
    """(o, block, kind, id, data, scale, miss): each row in its block of each ordering (kind 1), each query in all blocks within reach (kind 0)."""
    sent = rows.sparkSession.sparkContext.broadcast((curves, blocks))
    names = ["o", "block", "kind", "id", "data", "scale", "miss"]

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves, blocks = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, ids = _matrix(b["v"]), b["id"].to_numpy()
            data, scale, miss = _packed(x)
            data = pa.array(data, pa.binary())
            asks = np.nonzero(b["asks"].to_numpy(zero_copy_only=False))[0]
            exact = pa.array([r.tobytes() for r in x[asks]], pa.binary())
            for o in range(len(curves)):
                block = blocks.find(o, curves.keys(x, o), ids)
                n = len(ids)
                cols = [pa.array(np.full(n, o, np.int32)), pa.array(block.astype(np.int64)), pa.array(np.ones(n, np.int32)), b["id"], data, pa.array(scale), pa.array(miss)]
                yield pa.RecordBatch.from_arrays(cols, names)
                for step in range(-reach, reach + 1):
                    to = block[asks] + step
                    inside = np.nonzero((to >= 0) & (to < blocks.count(o)))[0]
                    m = len(inside)
                    cols = [pa.array(np.full(m, o, np.int32)), pa.array(to[inside].astype(np.int64)), pa.array(np.zeros(m, np.int32)), pa.array(ids[asks[inside]]), exact.take(pa.array(inside))]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(np.zeros(m)), pa.array(np.zeros(m))], names)

    return rows.select("id", "v", "asks").mapInArrow(dealt, "o int, block long, kind int, id long, data binary, scale double, miss double")


class _Near:
    """Queries of a block, and the rows met so far that may be among their k nearest."""

    def __init__(self, k: int):
        self.k, self.asked = k, []
        self.q: np.ndarray | None = None
        self.found: list[tuple] = []

    def ask(self, ids: np.ndarray, data: list[bytes]) -> None:
        self.asked.append((ids, np.frombuffer(b"".join(data), np.float64).reshape(len(ids), -1)))

    def meet(self, ids: np.ndarray, data: list[bytes], scale: np.ndarray, miss: np.ndarray) -> None:
        if not self.asked:
            return
        if self.q is None:
            self.ids, self.q = (np.concatenate(x) for x in zip(*self.asked, strict=True))
            self.best = np.full((len(self.ids), self.k), np.inf)
        x = np.frombuffer(b"".join(data), np.int8).reshape(len(ids), -1) * scale[:, None]
        most = max(1, PRODUCT // len(self.ids))
        for at in range(0, len(ids), most):
            part, slack = ids[at : at + most], miss[at : at + most]
            d = _distances(self.q, x[at : at + most])
            slack = slack[None] + 1e-7 * (1 + d)  # and rounding
            d[self.ids[:, None] == part[None]] = np.inf
            self.best = np.partition(np.hstack([self.best, d + slack]), self.k - 1, axis=1)[:, : self.k]
            i, j = np.nonzero(d - slack <= np.minimum(self.best.max(axis=1), np.finfo(float).max)[:, None])
            self.found.append((i, part[j], (d - slack)[i, j], (d + slack)[i, j]))

    def close(self) -> pa.RecordBatch | None:
        if not self.found:
            return None
        i, ids, lower, upper = (np.concatenate(c) for c in zip(*self.found, strict=True))
        keep = lower <= self.best.max(axis=1)[i]
        cols = [pa.array(self.ids[i[keep]], pa.int64()), pa.array(ids[keep], pa.int64()), pa.array(lower[keep]), pa.array(upper[keep])]
        return pa.RecordBatch.from_arrays(cols, ["query", "id", "lower", "upper"])


def _met(sent: DataFrame, k: int) -> DataFrame:
    """(query, id, lower, upper): what each block keeps. Queries of a block come before its rows; rows stream past them."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            o, block, kind = (b[c].to_numpy() for c in ("o", "block", "kind"))
            cuts = np.nonzero((np.diff(o) != 0) | (np.diff(block) != 0) | (np.diff(kind) != 0))[0] + 1 if b.num_rows else []
            for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                if lo == hi:
                    continue
                if now != (o[lo], block[lo]):
                    out = state.close() if state else None
                    if out is not None:
                        yield out
                    now, state = (o[lo], block[lo]), _Near(k)
                part = b.slice(lo, hi - lo)
                ids, data = part["id"].to_numpy(), part["data"].to_pylist()
                if kind[lo]:
                    state.meet(ids, data, part["scale"].to_numpy(), part["miss"].to_numpy())
                else:
                    state.ask(ids, data)
        out = state.close() if state else None
        if out is not None:
            yield out

    dealt = sent.repartition("o", "block").sortWithinPartitions("o", "block", "kind")
    return dealt.mapInArrow(near, "query long, id long, lower double, upper double")


def search(
    vectors: DataFrame,
    asks: Callable[[Column], Column] = lambda id_: id_ % EVERY == 0,
    k: int = K,
    id_column: str = "vec_id",
    column: str = "embedding",
    orderings: int = ORDERINGS,
    target: float = TARGET,
    least_window: int = LEAST_WINDOW,
    least_block: int = LEAST_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row that `asks`, nearest first, ties to the smaller id."""
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_column, column)
    ids = rows.select("id", "k1", "k2")
    copies = ids.groupBy("k1", "k2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"), F.max(asks(F.col("id"))).alias("any"))
    copies = materialize(copies.where("n > 1").select("k1", "k2", "first", "any"), "ann-copies")
    n_copied = copies.count()
    small = F.broadcast(copies) if n_copied <= BROADCAST_KEYS else copies
    known = rows.select("id", "v", asks(F.col("id")).alias("asks"))
    if n_copied:
        known = rows.join(small, ["k1", "k2"], "left").where(F.col("first").isNull() | (F.col("first") == F.col("id"))).select("id", "v", F.coalesce("any", asks(F.col("id"))).alias("asks"))

    n = known.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = max(2 * PROBES, min(SAMPLE_ROWS, SAMPLE_VALUES // dim))
    h = F.pmod(F.xxhash64("id", F.lit(42)), F.lit(1 << 30))
    sample = known.where(h < int(min(1.0, 2 * size / n) * (1 << 30))).select("id", "v").orderBy(h, "id").limit(size).toArrow()
    x, own = np.stack(sample["v"].to_numpy()), sample["id"].to_numpy()
    curves = Curves.fit(x, orderings, DIMS, BITS)
    places = ranked(known, curves)
    w = max(least_window, window(known, places, own[:PROBES], x[:PROBES], k, target))
    rows_in_block = max(least_block, w // 2, -(-n * orderings // MOST_BLOCKS))
    firsts = places.where(F.col("rank") % rows_in_block == 0).select("o", "key", "id").toArrow()
    sent = _block_rows(known, curves, Blocks(firsts), -(-w // rows_in_block))
    met = materialize(_met(sent, k), "ann-met")

    # Windows of all orderings together: what may still be among the k nearest.
    pairs = met.groupBy("query", "id").agg(F.max("lower").alias("lower"), F.min("upper").alias("upper"))
    best = F.row_number().over(Window.partitionBy("query").orderBy("upper", "id"))
    bound = pairs.withColumn("r", best).where(F.col("r") <= k).groupBy("query").agg(F.max("upper").alias("most"), F.count(F.lit(1)).alias("n"))
    open_ = pairs.join(bound, "query").where((F.col("n") < k) | (F.col("lower") <= F.col("most"))).select("query", "id")
    open_ = materialize(open_, "ann-open")
    few = F.broadcast if open_.count() <= BROADCAST_KEYS else lambda d: d
    both = known.select("id", "v").join(few(open_), "id").join(known.where("asks").select(F.col("id").alias("query"), F.col("v").alias("q")), "query")
    score = F.sqrt(F.aggregate(F.zip_with("q", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, e: s + e))
    near = both.select("query", "id", score.alias("score"))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))).where(F.col("r") <= k)

    # Copies under their own ids: at most the k + 1 smallest of each vector matter.
    members = ids.join(small, ["k1", "k2"]).withColumn("r", F.row_number().over(Window.partitionBy("first").orderBy("id"))).where(F.col("r") <= k + 1)
    members = materialize(members.select("first", F.col("id").alias("member"), "any"), "ann-members")
    spread = near.join(members.select(F.col("first").alias("id"), "member"), "id", "left").select("query", F.coalesce("member", "id").alias("vec_id"), "score")
    spread = spread.unionByName(members.where("any").select(F.col("first").alias("query"), F.col("member").alias("vec_id"), F.lit(0.0).alias("score")))
    spread = spread.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    asking = ids.where(asks(F.col("id"))).join(small, ["k1", "k2"], "left").select(F.col("id").alias("query_id"), F.coalesce("first", "id").alias("query"))
    out = asking.join(spread, "query").where("query_id <> vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All distances, summed component by component.
ORACLE = f"""
WITH v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id,
  sqrt(list_reduce(list_concat([0.0::DOUBLE], list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), lambda a, b: a + b)) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id))::INT AS rank FROM d) WHERE rank <= {K}
"""
