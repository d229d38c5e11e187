"""Operators on the grid of units: U-matrix, activation map, smoothing, density mask, connected components.

A grid has at most some thousands of cells, so its tables are broadcast; neighbours are found by exploding offsets into
an equi-join.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.config import CANONICAL, Profile
from gridloom.operators.som import SomModel, bmu

_EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
_FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def _offsets(pairs: list[tuple[int, int]]):
    return F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a, b in pairs]))


def _moved(cells: DataFrame, pairs: list[tuple[int, int]], *keep) -> DataFrame:
    """Each cell under the coordinates of its neighbours (ni, nj)."""
    return cells.select("i", "j", *keep, _offsets(pairs).alias("o")).select((F.col("i") + F.col("o.di")).alias("ni"), (F.col("j") + F.col("o.dj")).alias("nj"), "i", "j", *keep)


def umatrix(codebook: DataFrame, scaling: str = "sum") -> DataFrame:
    """(i, j, u): sum (or mean) of the distances to the neighbours inside the grid, divided by the largest."""
    other = F.broadcast(codebook.select(F.col("i").alias("ni"), F.col("j").alias("nj"), F.col("w").alias("nw")))
    gap = F.sqrt(F.aggregate(F.zip_with("w", "nw", lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2))), F.lit(0.0), lambda s, v: s + v))
    total = (F.sum if scaling == "sum" else F.avg)("gap")
    sums = _moved(codebook, _EIGHT, "w").join(other, ["ni", "nj"]).withColumn("gap", gap).groupBy("i", "j").agg(total.alias("total"))
    return sums.crossJoin(F.broadcast(sums.agg(F.max("total").alias("most")))).select("i", "j", F.coalesce(F.try_divide("total", "most"), F.lit(0.0)).alias("u"))


def grid(spark, x: int, y: int) -> DataFrame:
    return spark.range(x * y).select(F.floor(F.col("id") / y).cast("int").alias("i"), (F.col("id") % y).cast("int").alias("j"))


def activation_map(units: DataFrame, x: int, y: int) -> DataFrame:
    """(i, j, hits) for every cell; rows are counted in their tasks first."""
    counts = units.groupBy("k1").agg(F.count(F.lit(1)).alias("n"))
    cells = grid(units.sparkSession, x, y).withColumn("k", F.col("i") * y + F.col("j"))
    return cells.join(F.broadcast(counts), F.col("k") == F.col("k1"), "left").select("i", "j", F.coalesce("n", F.lit(0)).cast("long").alias("hits"))


def smooth(hits: DataFrame, x: int, y: int, sigma: float = 1.0) -> DataFrame:
    """(i, j, smoothed): Gaussian filter cut at 4 sigma, mirrored at the border, cells on the border doubled."""
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-radius, radius + 1)]
    total = sum(weights)
    rows = [(a, b, weights[a + radius] * weights[b + radius] / total**2) for a in range(-radius, radius + 1) for b in range(-radius, radius + 1)]
    kernel = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(w).alias("w")) for a, b, w in rows]))

    def mirrored(p, n):
        m = F.pmod(p, F.lit(2 * n))
        return F.when(m >= n, 2 * n - 1 - m).otherwise(m).cast("int")

    at = hits.select("i", "j", kernel.alias("k")).select(
        F.col("i").alias("ci"), F.col("j").alias("cj"), mirrored(F.col("i") + F.col("k.a"), x).alias("i"), mirrored(F.col("j") + F.col("k.b"), y).alias("j"), F.col("k.w").alias("weight")
    )
    return at.join(F.broadcast(hits.select("i", "j", "hits")), ["i", "j"]).groupBy(F.col("ci").alias("i"), F.col("cj").alias("j")).agg(F.sum(F.col("weight") * F.col("hits")).alias("smoothed"))


def normalized(hits: DataFrame) -> DataFrame:
    """(i, j, hits, share): hits over the largest; an all-zero map stays 0."""
    most = F.broadcast(hits.agg(F.max("hits").alias("most")))
    return hits.crossJoin(most).select("i", "j", "hits", F.when(F.col("most") > 0, F.col("hits") / F.col("most")).otherwise(F.lit(0.0)).alias("share"))


def dense(hits: DataFrame, threshold: float) -> DataFrame:
    """Cells with a share strictly above the threshold."""
    return normalized(hits).where(F.col("share") > threshold)


def walk(cells: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(i, j, label) of 4-connected cells, numbered from 1 by each component's first cell in raster order."""
    cells = sorted(cells)
    left, rows = set(cells), []
    for n, first in enumerate((c for c in cells if c in left), 1):
        reached = [first]
        left.discard(first)
        for i, j in reached:
            near = [(i + a, j + b) for a, b in _FOUR if (i + a, j + b) in left]
            left.difference_update(near)
            reached += near
        rows += [(i, j, n) for i, j in reached]
    return rows


def components(mask: DataFrame, y: int) -> DataFrame:
    """(i, j, cluster): 4-connected components of the cells, numbered from 1 by their first cell in raster order.

    A grid has some thousands of cells at most, so its cells are walked through on the driver.
    """
    cells = [(r["i"], r["j"]) for r in mask.select("i", "j").collect()]  # bounded by the codebook
    return mask.sparkSession.createDataFrame(walk(cells), "i int, j int, cluster int")


def label_units(hits: np.ndarray, threshold: float) -> np.ndarray:
    """Labels of an (x, y) grid of hits, as `label_lattice` gives them; an all-zero map has none."""
    labels = np.zeros(hits.shape, np.int64)
    if hits.max(initial=0) > 0:
        for i, j, n in walk([(int(i), int(j)) for i, j in np.argwhere(hits / hits.max() > threshold)]):
            labels[i, j] = n
    return labels


def label_lattice(hits: DataFrame, y: int, threshold: float) -> DataFrame:
    """(i, j, cluster) for every cell; 0 where the cell is not dense."""
    found = components(dense(hits, threshold), y)
    return hits.select("i", "j").join(F.broadcast(found), ["i", "j"], "left").select("i", "j", F.coalesce("cluster", F.lit(0)).alias("cluster"))


def centroids(lattice: DataFrame) -> DataFrame:
    return lattice.where("cluster > 0").groupBy("cluster").agg(F.avg("i").alias("row"), F.avg("j").alias("col"))


def text_threshold(hits: DataFrame) -> DataFrame:
    return hits.agg(F.percentile("hits", F.lit(0.7)).alias("p70"))


def contour_levels(cells: DataFrame, column: str, n: int = 10) -> DataFrame:
    """(level, value): n even steps from the smallest to the largest."""
    ends = cells.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return ends.select(F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("level"), "lo", "hi").select("level", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("level") / (n - 1)).alias("value"))


def analyze(model: SomModel | None, df: DataFrame, profile: Profile = CANONICAL) -> dict[str, DataFrame]:
    """U-matrix, activation map and labelled lattice from one pass over the rows (`units`, kept for what follows)."""
    if model is None:
        raise ValueError("train a map first")
    x, y = model.shape
    units = bmu(df, model).persist()
    hits = activation_map(units, x, y).persist()
    return {"units": units, "umatrix": umatrix(model.to_frame(df.sparkSession)), "activation": hits, "lattice": label_lattice(hits, y, profile.density_threshold)}
