"""Quality classifier: gradient-boosted trees over document statistics.

Statistics come from numpy over whole texts inside tasks; no text is shuffled. Trees are fitted on the driver from a
bounded sample of labelled rows (`labelled.MAX_ROWS`) outside the held-out fold and sent to the tasks as flat arrays.

Null, empty and blank texts: all statistics 0, scored like any other. Null doc_id: scored; held_out is null. No usable
labels: every score is the prior 0.5. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import boosting, textkernel
from gridloom.llm.common import fold_mod5, small_batches
from gridloom.llm.labelled import training_ids, training_texts

THRESHOLD = 0.3

STATISTICS = (
    "log_words", "word_bytes", "lower", "upper", "digit", "space", "newline", "stop_comma", "bang", "symbol", "pipe", "high",
    "distinct_words", "top_word", "distinct_pairs", "same_as_last", "lines", "distinct_lines", "line_words", "bare_words", "longest_word", "log_bytes",
)

_CLASS = np.full(256, 9, np.uint8)
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".,", 5), (b"!?", 6), (b"|", 7)):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_PUNCTUATION = textkernel.separators(bytes(i for i in range(33, 128) if not chr(i).isalnum()))


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of values by document."""
    run = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def _repeats(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of distinct values and count of the commonest, by document."""
    n = len(bounds) - 1
    distinct, top = np.zeros(n), np.zeros(n)
    if len(values):
        doc = np.repeat(np.arange(n), np.diff(bounds))
        order = np.lexsort((values, doc))
        v, d = values[order], doc[order]
        new = np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])])
        at = np.flatnonzero(new)
        count = np.diff(np.concatenate([at, [len(v)]]))
        distinct = np.bincount(d[at], minlength=n).astype(float)
        np.maximum.at(top, d[at], count)
    return distinct, top


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of STATISTICS for each document."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _CLASS[data]
    share = [_per_doc(kind == k, offsets) / size for k in range(10)]
    start, length, bounds, _ = textkernel.spans(data, offsets)
    hashes, _ = textkernel.word_hashes(data, offsets)
    count = np.diff(bounds).astype(float)
    words = np.maximum(count, 1)
    distinct, top = _repeats(hashes, bounds)
    same = np.zeros(len(hashes))
    if len(hashes):
        same[1:] = hashes[1:] == hashes[:-1]
        same[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
    pair_at, pair_doc = textkernel.places(bounds, 2)
    pairs = textkernel.ngrams(hashes, 2)[pair_at] if len(pair_at) else np.zeros(0, np.uint64)
    pair_bounds = np.searchsorted(pair_doc, np.arange(n + 1))
    distinct_pairs, _ = _repeats(pairs, pair_bounds)
    line_hashes, line_bounds = textkernel.word_hashes(data, offsets, sep=textkernel.NEWLINE)
    lines = np.diff(line_bounds).astype(float)
    distinct_lines, _ = _repeats(line_hashes, line_bounds)
    bare = _PUNCTUATION[data[start]].astype(float) if len(start) else np.zeros(0)
    longest = np.zeros(n)
    if len(length):
        np.maximum.at(longest, np.repeat(np.arange(n), np.diff(bounds)), length)
    pair_words = np.maximum(count - 1, 1)
    return np.stack(
        [
            np.log1p(count), _per_doc(length, bounds) / words, share[0], share[1], share[2], share[3], share[4], share[5], share[6], share[9], share[7], share[8],
            distinct / words, top / words, distinct_pairs / pair_words, _per_doc(same, bounds) / words, np.log1p(lines), distinct_lines / np.maximum(lines, 1),
            count / np.maximum(lines, 1), _per_doc(bare, bounds) / words, np.log1p(longest), np.log1p(np.diff(offsets)),
        ],
        axis=1,
    )


def all_statistics(text: pa.Array) -> np.ndarray:
    data, offsets = textkernel.buffers(text)
    parts = [statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in textkernel.slices(offsets)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality") -> boosting.Trees:
    small_batches(docs.sparkSession)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = all_statistics(b["text"])
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["y"], pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), flat)], ["doc_id", "y", "x"])

    texts = training_texts(docs, training_ids(labels, label)).select("doc_id", "y", "text")
    got = texts.mapInArrow(rows, "doc_id long, y int, x array<double>").toArrow().sort_by([("doc_id", "ascending")])
    x = got["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS))
    return boosting.fit(x, got["y"].to_numpy().astype(float))


def score(docs: DataFrame, model: boosting.Trees) -> DataFrame:
    """doc_id and score of every document, in one pass over the texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sent.value.probability(all_statistics(b["text"])))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
