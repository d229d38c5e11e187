"""Bounded, seeded samples of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fold_mod5

#: Labelled rows that a classifier is fitted on at most; they come to the driver as small feature rows.
MAX_ROWS = 40_000


def training_ids(labels: DataFrame, label: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and y of at most `max_rows` labelled documents outside the held-out fold, chosen by a hash of the id.

    Null ids and null labels are left out; several labels of one document count as the highest.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold_mod5(F.col("doc_id")) != 0))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_rows)


def training_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id, y, text of the sample; its size is bounded by `training_ids`, so it is broadcast and no text is shuffled."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
