"""Substring dedup by De Bruijn compaction over token k-mers.

Edges of the graph are the texts' runs of 13 words. They are dealt out by minimizer (the smallest of a window's hashes of
five words), so that all occurrences of an edge meet in one bucket, and a run of windows with one minimizer travels as
one packed record. Within a bucket an edge seen in a document and in one with a smaller id is a repeat; repeats that
continue each other in the document and in the source without branching compact into paths. Spark then puts the paths of
all buckets together end to start (`glue`): one continues another where it begins at the other's end both in the document
and in the source, so a long span stands only as far as its source's coordinates advance with the document's. That is one
window over the pieces of a document and source in order of place, in the stead of joins repeated until nothing grows;
coordinates are compared there, not words. Every word covered by a path is removed from the later document, in the join
of the spans with the texts.

Windows are equal when minimizer (47 bits or more with the bucket) and window hash (8 * WINDOW_BYTES bits) are equal, two
independent hashes; a corpus of many terabytes should set WINDOW_BYTES to 8. The words of sources are not read again:
that would shuffle all texts once more. A minimizer that very many different windows share is not split: its bucket's
records, one for each different run a task has met, meet in one task.

Copies do not pile up: of equal runs in one task only that of the smallest id is sent on (the others are settled there),
so a passage that a third of all documents share costs one record a task. Documents are shuffled once, to meet their
spans; blobs are a few bytes a word.

Null text: no words. Texts under 13 words: nothing removed. Null doc_id: neither changed nor a source. Rows that repeat a
doc_id: each cleaned by itself; equal ids are no repeats of each other. Very long texts: whole; the unit of work is a
document. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import textkernel
from gridloom.llm.common import small_batches

WINDOW, SEED = 13, 5
#: Bytes kept of a window's hash and of a minimizer.
WINDOW_BYTES, MINIMIZER_BYTES = 6, 5
#: Bytes of text a task gathers before it settles and sends its records, and bytes of text to a bucket.
GATHER_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20
LEAST_BUCKETS = 64


def _cut(values: np.ndarray, width: int) -> bytes:
    """The low bytes of 64-bit values."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _uncut(blob: bytes, width: int, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(-1, width)
    return out.view("<u8").ravel()


class Records:
    """Runs of windows with one minimizer: minimizer, document key (id, tie), start, and a hash for each window."""

    def __init__(self, m, doc, tie, start, count, window):
        self.m, self.doc, self.tie, self.start, self.count, self.window = m, doc, tie, start, count, window

    def take(self, at: np.ndarray) -> Records:
        first = np.cumsum(self.count) - self.count
        return Records(self.m[at], self.doc[at], self.tie[at], self.start[at], self.count[at], self.window[_ranges(first[at], self.count[at])])

    def pack(self) -> bytes:
        """Hashes as they are; coordinates as differences, compressed."""
        n = len(self.m)
        steps = [np.diff(x, prepend=0).astype("<i8") for x in (self.doc, self.tie, self.start)]
        places = zstandard.ZstdCompressor(1).compress(b"".join(x.view(np.uint8).reshape(-1, 8).T.tobytes() for x in steps) + self.count.astype("u1").tobytes())
        head = np.asarray([n, len(self.window), len(places)], "<i8").tobytes()
        return head + places + _cut(self.m, MINIMIZER_BYTES) + _cut(self.window, WINDOW_BYTES)

    @classmethod
    def unpack(cls, blob: bytes) -> Records:
        n, k, size = (int(x) for x in np.frombuffer(blob, "<i8", 3))
        raw = zstandard.ZstdDecompressor().decompress(blob[24 : 24 + size])
        places = [np.cumsum(np.frombuffer(raw, np.uint8, 8 * n, 8 * n * i).reshape(8, -1).T.copy().view("<i8").ravel()) for i in range(3)]
        count = np.frombuffer(raw, "u1", n, 24 * n).astype(np.int64)
        m = _uncut(blob, MINIMIZER_BYTES, n, 24 + size)
        return cls(m, *places, count, _uncut(blob, WINDOW_BYTES, k, 24 + size + n * MINIMIZER_BYTES))

    @classmethod
    def join(cls, parts: list[Records]) -> Records:
        return cls(*[np.concatenate([getattr(p, f) for p in parts]) for f in ("m", "doc", "tie", "start", "count", "window")])


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ..., count[0] of them, then those of the next."""
    if not len(count):
        return np.zeros(0, np.int64)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def records(data: np.ndarray, offsets: np.ndarray, doc: np.ndarray, tie: np.ndarray) -> Records:
    """Records of all documents of a slice."""
    words, bounds = textkernel.word_hashes(data, offsets)
    at, d = textkernel.places(bounds, WINDOW)
    if not len(at):
        e = np.zeros(0, np.int64)
        return Records(e.astype(np.uint64), e, e, e, e, e.astype(np.uint64))
    seeds = textkernel.ngrams(words, SEED)
    best, where = seeds[at], at.copy()
    for j in range(1, WINDOW - SEED + 1):
        other = seeds[at + j]
        less = other < best
        best[less] = other[less]
        where[less] = at[less] + j
    window = textkernel.ngrams(words, WINDOW)[at] & np.uint64((1 << 8 * WINDOW_BYTES) - 1)
    new = np.ones(len(at), bool)
    new[1:] = (where[1:] != where[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(at)]]))
    return Records(best[first], doc[d[first]], tie[d[first]], at[first] - bounds[d[first]], count, window)


def settle(r: Records) -> tuple[Records, np.ndarray]:
    """Records to send on, and the paths settled here: runs equal to one of a smaller id in the same task."""
    if not len(r.m):
        return r, np.zeros((0, 6), "<i8")
    first = np.cumsum(r.count) - r.count
    key = textkernel.mix(np.add.reduceat(r.window * _odd(_ranges(np.zeros(len(first), np.int64), r.count)), first) + r.m + r.count.astype(np.uint64))
    order = np.lexsort((r.doc, key))
    k, d = key[order], r.doc[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = d > d[head]
    later, source = order[late], order[head[late]]
    keep = np.ones(len(key), bool)
    keep[later] = False
    found = np.column_stack([r.doc[later], r.tie[later], r.start[later], r.count[later], r.doc[source], r.start[source]]).astype("<i8")
    return r.take(np.flatnonzero(keep)), found


def _odd(place: np.ndarray) -> np.ndarray:
    return textkernel.mix(place.astype(np.uint64) + np.uint64(99)) | np.uint64(1)


def repeated(r: Records) -> pd.DataFrame:
    """Paths of a bucket: doc, tie, start, length (in windows) of repeats, with their source's id and start."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("doc", "tie", "start", "length", "source", "source_start")})
    if not len(r.m):
        return empty
    order = np.argsort(r.m, kind="stable")
    m, doc = r.m[order], r.doc[order]
    new = np.concatenate([[True], m[1:] != m[:-1]])
    first = np.flatnonzero(new)
    shared = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    r = r.take(np.sort(order[shared[np.cumsum(new) - 1]]))
    if not len(r.m):
        return empty
    run = np.repeat(np.arange(len(r.m)), r.count)
    start = _ranges(r.start, r.count)
    doc = r.doc[run]
    order = np.lexsort((start, doc, r.window, r.m[run]))
    m, w, d, s = r.m[run][order], r.window[order], doc[order], start[order]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (w[1:] != w[:-1])])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = d > d[head]
    at, source, source_start = order[late], d[head][late], s[head][late]
    back = np.argsort(at, kind="stable")
    at, source, source_start = at[back], source[back], source_start[back]
    rows = run[at]
    return compact(r.doc[rows], r.tie[rows], start[at], np.ones(len(at), np.int64), source, source_start)


def compact(doc, tie, start, length, source, source_start) -> pd.DataFrame:
    """Join rows that continue each other in the document and in the source: nonbranching paths."""
    order = np.lexsort((start, source, tie, doc))
    doc, tie, start, length, source, source_start = (x[order] for x in (doc, tie, start, length, source, source_start))
    new = np.ones(len(doc), bool)
    end = start + length
    new[1:] = (
        (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (source[1:] != source[:-1]) | (start[1:] != end[:-1]) | (source_start[1:] != source_start[:-1] + length[:-1])
    )
    first = np.flatnonzero(new)
    total = np.add.reduceat(length, first) if len(first) else length
    return pd.DataFrame({"doc": doc[first], "tie": tie[first], "start": start[first], "length": total, "source": source[first], "source_start": source_start[first]})


PATH = "doc long, tie long, start long, length long, source long, source_start long"


def paths(docs: DataFrame, buckets: int) -> DataFrame:
    """Repeated paths of all documents (doc_id, text, tie), one row for each stretch that one bucket or task has found."""

    def sent(r: Records) -> Iterator[pa.RecordBatch]:
        keep, found = settle(r)
        ids, kinds, blobs = [], [], []
        for kind, bucket, take in ((0, (keep.m % np.uint64(buckets)).astype(np.int64), lambda at: keep.take(at).pack()), (1, (found[:, 2] + found[:, 0]) % buckets, lambda at: found[at].tobytes())):
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]):
                ids.append(int(b))
                kinds.append(kind)
                blobs.append(take(order[cuts[b] : cuts[b + 1]]))
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "body"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            data, offsets = textkernel.buffers(b["text"])
            doc, tie = b["doc_id"].to_numpy(), b["tie"].to_numpy()
            for i, j in textkernel.slices(offsets):
                held.append(records(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], doc[i:j], tie[i:j]))
                size += int(offsets[j] - offsets[i])
                if size >= GATHER_BYTES:
                    yield from sent(Records.join(held))
                    held, size = [], 0
        if held:
            yield from sent(Records.join(held))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        packed = [Records.unpack(b) for b in pdf["body"][pdf["kind"] == 0]]
        own = [np.frombuffer(b, "<i8").reshape(-1, 6) for b in pdf["body"][pdf["kind"] == 1]]
        out = [repeated(Records.join(packed))] if packed else []
        if own:
            out.append(compact(*np.concatenate(own).T))
        return pd.concat(out)

    return docs.mapInArrow(rows, "bucket int, kind int, body binary").groupBy("bucket").applyInPandas(meet, PATH)


def glue(found: DataFrame) -> DataFrame:
    """(doc, tie, source, start, length, source_start): maximal paths, from the pieces that buckets and tasks have found.

    A piece whose end is another's start, in the document and in the source, is joined with it; chains of any length are
    followed in one pass over each document's pieces, in order of place.
    """
    chain = Window.partitionBy("doc", "tie", "source", F.col("start") - F.col("source_start")).orderBy("start")
    ends = F.max(F.col("start") + F.col("length")).over(chain.rowsBetween(Window.unboundedPreceding, -1))
    parts = found.withColumn("first", (F.col("start") > F.coalesce(ends, F.lit(-1))).cast("int"))
    parts = parts.withColumn("path", F.sum("first").over(chain.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    paths = parts.groupBy("doc", "tie", "source", (F.col("start") - F.col("source_start")).alias("ahead"), "path")
    paths = paths.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("length")).alias("stop"))
    return paths.select("doc", "tie", "source", "start", (F.col("stop") - F.col("start")).alias("length"), (F.col("start") - F.col("ahead")).alias("source_start"))


def spans(paths: DataFrame) -> DataFrame:
    """One row for each document: its paths as word spans (start, words)."""
    span = F.struct(F.col("start").cast("int").alias("start"), (F.col("length") + WINDOW - 1).cast("int").alias("words"))
    return paths.groupBy("doc", "tie").agg(F.collect_list(span).alias("spans"))


def covered(n: int, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which of n words some span covers."""
    change = np.zeros(n + 1, np.int64)
    for start, words in spans:
        change[start] += 1
        change[start + words] -= 1
    return np.cumsum(change[:-1]) > 0


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the kept text (words joined by one space) of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_bytes, n, n_ids = rows.agg(F.sum(F.octet_length("text")), F.count("doc_id"), F.countDistinct("doc_id")).first()
    tie = F.lit(0).cast("long") if n == n_ids else F.coalesce(F.xxhash64("text"), F.lit(0))  # tells rows with one id apart
    rows = rows.withColumn("tie", tie)
    found = paths(rows.where("doc_id IS NOT NULL AND text IS NOT NULL"), max(LEAST_BUCKETS, -(-(n_bytes or 0) // BUCKET_BYTES)))
    own = spans(glue(found))
    met = rows.join(own, (F.col("doc_id") == F.col("doc")) & (rows["tie"] == own["tie"]), "left").select("doc_id", "text", "spans")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_words, n_removed, kept = [], [], []
            for text, spans in zip(b["text"].cast(pa.large_binary()), b["spans"], strict=True):
                words = (text.as_py() or b"").split()
                n_words.append(len(words))
                if spans.is_valid:
                    gone = covered(len(words), [(s["start"], s["words"]) for s in spans.as_py()])
                    words = [w for w, g in zip(words, gone, strict=True) if not g]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept string")


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS source FROM g GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM g JOIN f USING (k) WHERE source < doc_id),
x AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS i FROM d),
r AS (SELECT x.doc_id, count(c.i) AS n_removed, string_agg(CASE WHEN c.i IS NULL THEN t END, ' ' ORDER BY x.i) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.i = x.i GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)
"""
