"""Toxicity: a factorization machine over hashed terms.

Terms are lower-cased runs of letters and digits, and their first 4 to 7 bytes, so that inflected forms of an insult
share a term; a document has a term or not. Linear weights alone miss pairs such as an insult with a group mention, so
each term also has a factor vector and every pair of present terms adds the product of its vectors.

The vocabulary is what separates labelled toxic documents from clean ones: Spark counts all terms of a bounded sample of
labelled rows outside the held-out fold and keeps those that LEAST_TOXIC of its toxic documents hold and whose likelihood
ratio is LEAST_RATIO or more; only these reach the driver, where the machine is fitted, and its arrays go to the tasks.
Whole texts are scored where they are read: no text is shuffled.

Null, empty and blank texts: no terms, the score is that of the bias. Null doc_id: scored; held_out is null. No usable
labels: every score is the prior. Empty table: no rows. Extra columns are ignored, and kept by `reject`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkernel
from gridloom.llm.common import fold_mod5, small_batches
from gridloom.llm.labelled import training_ids, training_texts

THRESHOLD = 0.5
PREFIXES = (4, 5, 6, 7)
FACTORS = 6
#: How often a toxic row counts in the fit: a missed one is the worse mistake.
EMPHASIS = 5.0
#: Toxic documents that a term must be in, and least likelihood ratio, to be in the model.
LEAST_TOXIC, LEAST_RATIO = 4, 24.0


def terms(data: np.ndarray, offsets: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, term) pairs, sorted; with `keep` (sorted), only those terms, as their places in it."""
    hashes, bounds, *cut = textkernel.word_hashes(data, offsets, lower=True, sep=textkernel.NOT_TERM, prefixes=PREFIXES)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    all_terms, all_docs = [], []
    if keep is not None:
        known = np.zeros(1 << 16, bool)
        known[(keep >> np.uint64(48)).astype(np.int64)] = True
    for x in (hashes, *cut):
        mask = x != 0
        if keep is not None:
            mask &= known[(x >> np.uint64(48)).astype(np.int64)]
        t, d = x[mask], doc[mask]
        if keep is not None and len(keep):
            at = np.minimum(np.searchsorted(keep, t), len(keep) - 1)
            same = keep[at] == t
            t, d = at[same], d[same]
        all_terms.append(t)
        all_docs.append(d)
    t, d = np.concatenate(all_terms), np.concatenate(all_docs)
    order = np.lexsort((t, d))
    t, d = t[order], d[order]
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (d[1:] != d[:-1])
    return d[new], t[new]


def _sliced(text: pa.Array, keep: np.ndarray | None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = textkernel.buffers(text)
    for a, b in textkernel.slices(offsets):
        yield a, b, *terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], keep)


@dataclass
class Machine:
    """Score: sigmoid(bias + sum of weights + half of (sum of vectors squared - sum of squared vectors))."""

    vocabulary: np.ndarray  # sorted 64-bit terms
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        out = np.full(n, self.bias)
        if len(term):
            out += np.bincount(doc, self.weight[term], n)
            v = self.factor[term]
            for k in range(v.shape[1]):
                out += 0.5 * (np.bincount(doc, v[:, k], n) ** 2 - np.bincount(doc, v[:, k] ** 2, n))
        return out

    def probability(self, text: pa.Array) -> np.ndarray:
        out = np.zeros(len(text))
        for a, b, doc, term in _sliced(text, self.vocabulary):
            out[a:b] = 1 / (1 + np.exp(-np.clip(self.raw(doc, term, b - a), -40, 40)))
        return out


def train(docs: list[np.ndarray], y: np.ndarray, n_terms: int, epochs: int = 30, batch: int = 256, rate: float = 0.1, ridge: float = 1e-4, emphasis: float = 1.0) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss; rows are (sorted) arrays of terms. A toxic row counts `emphasis` times."""
    rng = np.random.default_rng(7)
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    bias += float(np.log(emphasis)) if len(y) and y.min() < y.max() else 0.0
    w, v = np.zeros(n_terms), rng.normal(0, 0.05, (n_terms, FACTORS))
    seen_b, seen_w, seen_v = 1e-6, np.full(n_terms, 1e-6), np.full((n_terms, FACTORS), 1e-6)
    if not n_terms or not len(y) or y.min() == y.max():
        return bias, w, v * 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(y), batch):
            ids = order[s : s + batch]
            rows = [docs[i] for i in ids]
            doc = np.repeat(np.arange(len(ids)), [len(r) for r in rows])
            term = np.concatenate(rows) if len(doc) else np.zeros(0, np.int64)
            total = np.zeros((len(ids), FACTORS))
            np.add.at(total, doc, v[term])
            squares = np.zeros(len(ids))
            np.add.at(squares, doc, (v[term] ** 2).sum(axis=1))
            raw = bias + np.bincount(doc, w[term], len(ids)) + 0.5 * ((total**2).sum(axis=1) - squares)
            slope = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - y[ids]) * np.where(y[ids] > 0, emphasis, 1.0) / len(ids)
            gw = np.bincount(term, slope[doc], n_terms) + ridge * w
            gv = np.zeros_like(v)
            np.add.at(gv, term, slope[doc][:, None] * (total[doc] - v[term]))
            gv += ridge * v
            gb = float(slope.sum())
            seen_b += gb * gb
            seen_w += gw * gw
            seen_v += gv * gv
            bias -= rate * gb / np.sqrt(seen_b)
            w -= rate * gw / np.sqrt(seen_w)
            v -= rate * 0.3 * gv / np.sqrt(seen_v)
    return bias, w, v


def _counted(texts: DataFrame) -> DataFrame:
    """(t, toxic, n): toxic documents, and all, that have each term; the terms of a slice of texts come summed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b["y"].to_numpy()
            for a, stop, doc, term in _sliced(b["text"], None):
                t, at = np.unique(term, return_inverse=True)
                toxic = np.bincount(at, y[a:stop][doc], len(t)).astype(np.int64)
                both = np.bincount(at, minlength=len(t)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.uint64).view(np.int64)), pa.array(toxic), pa.array(both)], ["t", "toxic", "n"])
        textkernel.release()

    return texts.select("y", "text").mapInArrow(rows, "t long, toxic long, n long").groupBy("t").agg(F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))


def separating(counts: DataFrame, toxic: int, total: int) -> DataFrame:
    """(t): terms of at least LEAST_TOXIC toxic documents, commoner there, with a likelihood ratio of LEAST_RATIO or more.

    The ratio is that of the two-by-two table of documents with the term and toxic documents.
    """
    a, n = F.col("toxic"), F.col("n")
    cells = ((a, n * toxic), (n - a, n * (total - toxic)), (toxic - a, (total - n) * toxic), (total - toxic - n + a, (total - n) * (total - toxic)))
    ratio = sum((F.when(x > 0, 2 * x * F.log(x * total / e)).otherwise(0.0) for x, e in cells), F.lit(0.0))
    return counts.where((a >= LEAST_TOXIC) & (a * total > n * toxic) & (ratio >= LEAST_RATIO)).select("t")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Machine:
    small_batches(docs.sparkSession)
    ids = training_ids(labels, label)
    sizes = {r["y"]: r["count"] for r in ids.groupBy("y").count().collect()}
    texts = training_texts(docs, ids)
    toxic, total = sizes.get(1, 0), sum(sizes.values())
    vocabulary = np.zeros(0, np.uint64)
    if toxic and toxic < total:
        vocabulary = np.sort(separating(_counted(texts), toxic, total).toArrow()["t"].to_numpy().view(np.uint64))
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start, stop, doc, term in _sliced(b["text"], sent.value):
                bounds = np.searchsorted(doc, np.arange(stop - start + 1)).astype(np.int32)
                found = pa.ListArray.from_arrays(bounds, pa.array(term.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(start, stop - start), b["y"].slice(start, stop - start), found], ["doc_id", "y", "x"])

    if len(vocabulary):
        got = texts.select("doc_id", "y", "text").mapInArrow(rows, "doc_id long, y int, x array<int>").toArrow().sort_by([("doc_id", "ascending")])
        flat, bounds = got["x"].combine_chunks(), None
        bounds = flat.offsets.to_numpy()
        values = flat.values.to_numpy()
        x = [values[bounds[i] : bounds[i + 1]] for i in range(len(flat))]
        y = got["y"].to_numpy().astype(float)
    else:
        x, y = [np.zeros(0, np.int64)] * total, np.array([1.0] * toxic + [0.0] * (total - toxic))
    return Machine(vocabulary, *train(x, y, len(vocabulary), emphasis=EMPHASIS))


def score(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score of every document, in one pass over the texts."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sent.value.probability(b["text"]))], ["doc_id", "score"])
        textkernel.release()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def reject(docs: DataFrame, model: Machine) -> DataFrame:
    """The documents that are not toxic, all columns kept; rows are dropped where they are read."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(sent.value.probability(b.column(at)) < THRESHOLD))
        textkernel.release()

    return docs.mapInArrow(rows, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
