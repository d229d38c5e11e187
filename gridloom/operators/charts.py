"""The tables behind the charts; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import clusters, lattice, profile


def data_types(df: DataFrame) -> DataFrame:
    return profile.type_counts(df)


def missing_values(df: DataFrame) -> DataFrame:
    return profile.top_missing(df, 20)


def umatrix(codebook: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = lattice.umatrix(codebook)
    return cells, lattice.contour_levels(cells, "u")


def activation(hits: DataFrame, x: int, y: int) -> DataFrame:
    """(i, j, hits, smoothed, dark_text): text is dark on cells at or below the 70th percentile."""
    level = F.broadcast(lattice.text_threshold(hits))
    return hits.join(lattice.smooth(hits, x, y), ["i", "j"]).crossJoin(level).select("i", "j", "hits", "smoothed", (F.col("hits") <= F.col("p70")).alias("dark_text"))


def natural_clusters(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    return labels.where("cluster > 0"), lattice.centroids(labels)


def cluster_distribution(labels: DataFrame) -> DataFrame:
    """(cluster, n, pct, in_pie); a pie of one slice is not drawn."""
    return clusters.shares(labels)
