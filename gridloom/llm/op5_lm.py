"""LM scoring: a causal self-attention model over subword ids, mixed word by word with corpus word counts.

A word's probability under the attention model is the product over its subword ids, each scored once in overlapping
context windows, batched and masked. The smoothed unigram of the whole training corpus has the rest of the mass; the
share of each is the one of highest likelihood on training texts that the weights were not fitted on, so the attention
model carries the score as far as it predicts better, whatever the size of the corpus.

Weights are fitted in rounds: in each, tasks take groups of training texts not used before, follow the gradient over all
their windows from the current weights on, and Spark averages what they found. Every training text is fitted on: one chunk in
TUNE_EVERY is kept until the share is set by it, and then fitted on in a round of its own. Groups, and with them the steps,
grow with the corpus; a group is of fixed size, and only sums of weights leave the executors. Words, subword ids and pairs of
neighbouring ids are counted over all training texts, ids and pairs where the tokenized texts lie, without a shuffle.
The model has vectors of its own for the most frequent ids (`attention.OWN_IDS`); all others share one and are told
apart by their counts.

Counts of distinct words grow with the corpus, so they are neither broadcast nor collected: each chunk of documents asks
buckets of word hashes for the counts of its own words, and the answers meet the chunk's texts in one co-grouping. A
task holds one chunk (CHUNK_BYTES) or one bucket's share of the questions; hot words come summed. Messages hold fewer
words as the corpus grows; at worst one, which is the plain shuffle by word.

Null, empty and blank texts: the end alone. Null doc_id: scored, not learnt from, held_out null. No training texts:
every token has the probability 0.5 / (0.5 * 1) by counts. Repeated rows: each scored, each learnt from. Very long texts:
whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import attention, textkernel
from gridloom.llm.common import ByteBuckets, fold_mod5, materialize, small_batches
from gridloom.llm.op3_tokens import bounds_of, encoder, split, text_slices, tokenizer_path

HELD_OUT = 1
#: Rounds of fitting, and bytes of text that a group fits on in all rounds together.
ROUNDS, GROUP_BYTES = 4, 12 << 20
#: One chunk in so many is kept for the last round of the fit: before it its training texts set the share of the attention model.
TUNE_EVERY, TUNE = 32, 5
#: Candidates for that share.
SHARES = 1 / (1 + np.exp(-np.linspace(-6, 6, 41)))
#: Rows whose arrays are added up by one task, or by the driver.
FAN_IN = 16
#: Bytes of a chunk of consecutive documents, but for its last one; chunks at least.
CHUNK_BYTES, LEAST_CHUNKS = 5 << 20, 64
GATHER_BYTES = 8 << 20
#: Subword ids of the tokenizer, and the end of a text, which is the model's last id.
SUBWORDS = 49408
END = SUBWORDS


def _pack(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    tail = zstandard.ZstdCompressor(1).compress(counts.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())
    return np.asarray([len(hashes)], "<i8").tobytes() + hashes.astype("<u8").tobytes() + tail


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    tail = zstandard.ZstdDecompressor().decompress(blob[8 + 8 * n :])
    return np.frombuffer(blob, "<u8", n, 8), np.frombuffer(tail, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _rows(buckets: list[int], chunks: list[int], bodies: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(chunks, pa.int32()), pa.array(bodies, pa.binary())], ["bucket", "chunk", "body"])


def lower_hashes(words: pa.Array) -> np.ndarray:
    """Hash of each of some words, A-Z in lower case."""
    return textkernel.word_hashes(*textkernel.buffers(words), lower=True)[0]


#: Chunk number of rows that are no answers: a bucket's totals.
TOTALS = -1


def answers(rows: DataFrame, buckets: int) -> DataFrame:
    """(chunk, body, total, kinds): for each chunk the training counts of all its words, from all buckets.

    Also TOTALS rows (tokens and distinct words of a bucket). rows: text, chunk, train.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def asked() -> pa.RecordBatch:
            h, c, t = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((h, c))
            h, c, t = h[order], c[order], t[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])]))
            h, c, t = h[first], c[first], np.add.reduceat(t, first)
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((bucket, c))
            h, c, t, bucket = h[order], c[order], t[order], bucket[order]
            cut = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (bucket[1:] != bucket[:-1])]))
            stop = np.append(cut[1:], len(h))
            return _rows(bucket[cut].tolist(), c[cut].tolist(), [_pack(h[a:z], t[a:z]) for a, z in zip(cut, stop, strict=True)])

        for b in batches:
            chunk, train = b["chunk"].to_numpy(), b["train"].to_numpy(zero_copy_only=False)
            for at, texts in text_slices(b["text"]):
                n, code, distinct = split(texts)
                if not len(code):
                    continue
                own, place = np.unique(chunk[at : at + len(texts)], return_inverse=True)
                learnt = np.repeat(train[at : at + len(texts)], n)
                key, times = np.unique(np.repeat(place, n) * len(distinct) + code, return_inverse=True)
                times = np.bincount(times, learnt, len(key)).astype(np.int64)
                held.append((lower_hashes(distinct)[key % len(distinct)], own[key // len(distinct)], times))
                size += texts.nbytes
                if size >= GATHER_BYTES:
                    yield asked()
                    held, size = [], 0
        if held:
            yield asked()
        textkernel.release(keep=True)

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_unpack(b) for b in pdf["body"]]
        h = np.concatenate([p[0] for p in parts])
        known, at = np.unique(h, return_inverse=True)
        total = np.bincount(at, np.concatenate([p[1] for p in parts]), len(known)).astype(np.int64)
        out, place = [(TOTALS, b"", int(total.sum()), int((total > 0).sum()))], 0
        for chunk, (own, _) in zip(pdf["chunk"], parts, strict=True):
            out.append((int(chunk), _pack(own, total[at[place : place + len(own)]]), 0, 0))
            place += len(own)
        return pd.DataFrame(out, columns=["chunk", "body", "total", "kinds"])

    asked = rows.select("text", "chunk", "train").mapInArrow(ask, "bucket int, chunk int, body binary")
    return asked.groupBy("bucket").applyInPandas(answer, "chunk int, body binary, total long, kinds long")


def added(arrays: DataFrame, n: int) -> np.ndarray:
    """Sum of arrays of float64 (k: 0 to n - 1, body), FAN_IN at a time."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(b) for b in pdf["body"])
        return pd.DataFrame({"k": [int(pdf["k"].iloc[0]) // FAN_IN], "body": [total.tobytes()]})

    arrays = materialize(arrays, "sums")  # by all tasks at once: the iterator below would run one partition after another
    while n > FAN_IN:
        arrays = materialize(arrays.groupBy(F.floor(F.col("k") / FAN_IN)).applyInPandas(add, "k long, body binary"), "sums")
        n = -(-n // FAN_IN)
    return sum((np.frombuffer(r["body"]) for r in arrays.select("body").toLocalIterator()), np.zeros(1))


class Fit:
    """The attention model and its fitting. rows: doc_id, text, chunk, train; all that are to be learnt from take part in one round."""

    def __init__(self, rows: DataFrame, n_bytes: int, n_train: int, id_counts: np.ndarray | None, path: str):
        """id_counts: of the subword ids in all that are to be learnt from; None: they are counted."""
        self.groups = max(1, -(-int(n_bytes * 0.8) // GROUP_BYTES))
        self.last = max(1, -(-self.groups * ROUNDS // TUNE_EVERY))
        kept = F.col("chunk") % TUNE_EVERY == TUNE
        h = F.xxhash64("doc_id", F.lit(29))
        part = F.when(kept, F.pmod(h, F.lit(self.last)) + self.groups * ROUNDS).otherwise(F.pmod(h, F.lit(self.groups * ROUNDS))).cast("int")

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at, texts in text_slices(b["text"]):
                    found = encoder(path, 2).batch(texts)
                    raw, cut = found.flat().tobytes(), (2 * found.text_bounds()).tolist()
                    ids = pa.array([raw[a:z] for a, z in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([b["part"].slice(at, len(texts)), ids], ["part", "ids"])

        self.texts = materialize(rows.where("train").select(part.alias("part"), "text").mapInArrow(tokens, "part int, ids binary"), "lm-texts")
        if id_counts is None:
            id_counts = self.summed(np.zeros(SUBWORDS, np.int64), lambda ids, _: np.bincount(ids, minlength=SUBWORDS))
        counts = np.append(id_counts, n_train).astype(float)
        own = attention.own_ids(counts)

        def company(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
            return attention.pairs(np.insert(ids.astype(np.int64), np.cumsum(lengths), END), lengths + 1, own, len(counts))

        around = self.summed(np.zeros((len(own), 2 * attention.SKETCH)), company, lambda total: attention.projected(total, own, counts))
        self.model = attention.start(counts, around)
        for r in range(ROUNDS):
            self.round(self.texts.where((F.col("part") < self.groups * ROUNDS) & (F.col("part") % ROUNDS == r)), self.groups, r / ROUNDS, 1 / ROUNDS, 150)

    def summed(self, none: np.ndarray, of: Callable, last: Callable = lambda total: total) -> np.ndarray:
        """Sum of last(sum of of(ids, lengths of texts) in a task) over all tasks, which take the texts where they lie."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = 0
            for b in batches:
                data, bounds = textkernel.buffers(b["ids"])
                if len(bounds) > 1:
                    total = total + of(data.view("<u2"), np.diff(bounds) // 2)
            if np.ndim(total):
                body = last(total).astype(float).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([body], pa.binary())], ["k", "body"])

        ids = self.texts.select("ids")
        found = added(ids.mapInArrow(task, "k long, body binary"), ids.rdd.getNumPartitions())
        return found.reshape(none.shape) if len(found) == none.size > 1 else none

    def kept(self) -> None:
        """The round over the texts that were kept: each of them once, by steps as small as the last ones."""
        self.round(self.texts.where(F.col("part") >= self.groups * ROUNDS), self.last, 1.0, 0.0, 1)

    def round(self, texts: DataFrame, groups: int, done: float, share: float, least: int) -> None:
        sent, first = texts.sparkSession.sparkContext.broadcast(self.model), self.groups * ROUNDS

        def learn(pdf: pd.DataFrame) -> pd.DataFrame:
            own, m, k = _ids(pdf), sent.value, int(pdf["part"].iloc[0])
            m = m.with_weights(m.weights())
            attention.train(m, own, done, share, least=least, seed=k)
            n = sum(map(len, own))
            textkernel.release(keep=True)
            return pd.DataFrame({"k": [k // ROUNDS if k < first else k - first], "body": [np.append(m.weights().astype(float) * n, n).tobytes()]})

        total = added(_spread(texts, groups).applyInPandas(learn, "k long, body binary"), groups)
        if total[-1]:
            self.model = self.model.with_weights(total[:-1] / total[-1])


def _ids(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.append(np.frombuffer(t, "<u2").astype(np.int64), END) for t in sorted(pdf["ids"])]


def _spread(texts: DataFrame, n: int):
    """As many partitions as tasks are wanted, which are not put together again for being small: a group is work, not bytes."""
    return texts.repartition(2 * n, "part").groupBy("part")


class Scorer:
    """What is the same for all chunks: the totals of the corpus, the model, and its share (see `tuned`)."""

    def __init__(self, total: int, kinds: int, n_ends: int, model: attention.Model, path: str, share: float = 0.5):
        self.total, self.kinds, self.n_ends, self.model, self.path, self.share = total, kinds, n_ends, model, path, share

    def base(self, count):
        return np.log10((count + 0.5) / (self.total + 0.5 * (self.kinds + 1)))

    def tokens(self, texts: pa.Array, known: np.ndarray, times: np.ndarray, apart: bool = False) -> tuple[np.ndarray, ...]:
        """Bounds of the texts among all tokens (words and ends); each token's count and log10 probability by counts and by
        the model. `apart`: counts are without the text's own words, as they would be had it not been learnt from."""
        found = encoder(self.path, 2).batch(texts)
        n, n_texts = found.n_words, len(texts)
        bounds = bounds_of(n + 1)
        is_end = np.zeros(bounds[-1], bool)
        is_end[bounds[1:] - 1] = True
        count = np.full(bounds[-1], self.n_ends, np.int64)
        if len(found.code):
            count[~is_end] = times[np.searchsorted(known, lower_hashes(found.distinct))][found.code]
        if apart and len(found.code):
            hashes = np.unique(lower_hashes(found.distinct), return_inverse=True)[1]
            _, place, own = np.unique(np.repeat(np.arange(n_texts), n) * (hashes.max() + 1) + hashes[found.code], return_inverse=True, return_counts=True)
            count[~is_end] -= own[place]
            count[is_end] -= 1
        length = np.ones(len(is_end), np.int64)
        length[~is_end] = found.word_sizes()
        stop = np.cumsum(length)
        targets = np.full(int(stop[-1]) if len(stop) else 0, END, np.int32)
        inside = np.ones(len(targets), bool)
        inside[stop[is_end] - 1] = False
        targets[inside] = found.flat()
        per_text = np.diff(np.concatenate([[0], stop[is_end]]))
        log_p = np.concatenate([[0.0], np.cumsum(attention.log10_probabilities(self.model, targets, per_text), dtype=np.float64)])
        return bounds, count, self.base(count), log_p[stop] - log_p[stop - length]

    def mixed(self, by_count: np.ndarray, by_model: np.ndarray, share: float) -> np.ndarray:
        top = np.maximum(by_model, by_count)
        return top + np.log10(share * 10 ** (by_model - top) + (1 - share) * 10 ** (by_count - top))

    def score(self, texts: pa.Array, known: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base and score of each text."""
        bounds, count, by_count, by_model = self.tokens(texts, known, times)
        sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
        return np.diff(bounds), sums(count > 0), sums(by_count), sums(self.mixed(by_count, by_model, self.share))

    def likelihoods(self, texts: pa.Array, known: np.ndarray, times: np.ndarray) -> np.ndarray:
        """log10 likelihood of the texts for each of SHARES."""
        _, _, by_count, by_model = self.tokens(texts, known, times, apart=True)
        return np.array([self.mixed(by_count, by_model, s).sum() for s in SHARES])


def _known(counts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a chunk, sorted, and their training counts."""
    parts = [_unpack(b) for b in counts["body"].to_pylist()]
    h = np.concatenate([p[0] for p in parts] or [np.zeros(0, np.uint64)])
    known, first = np.unique(h, return_index=True)
    return known, np.concatenate([p[1] for p in parts] or [np.zeros(0, np.int64)])[first]


def tuned(rows: DataFrame, asked: DataFrame, scorer: Scorer) -> float:
    """The share of highest likelihood on the training texts of the chunks that weights were not fitted on yet."""
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(scorer)

    def tried(own: pa.Table, counts: pa.Table) -> pa.Table:
        known, times = _known(counts)
        out = np.zeros(len(SHARES))
        for _, texts in text_slices(own["text"].combine_chunks()):
            out += sent.value.likelihoods(texts, known, times)
        return pa.table({"at": pa.array(np.arange(len(SHARES))), "value": pa.array(out)})

    kept = F.col("chunk") % TUNE_EVERY == TUNE
    texts = rows.where(kept & F.col("train")).select("text", "chunk").groupBy("chunk")
    got = texts.cogroup(asked.where(F.col("of") % TUNE_EVERY == TUNE).groupBy("of")).applyInArrow(tried, "at long, value double")
    values = {r["at"]: r["v"] for r in got.groupBy("at").agg(F.sum("value").alias("v")).collect()}
    return float(SHARES[max(values, key=values.get)]) if any(values.values()) else 0.5


def score(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, model_share of every document."""
    path = path or tokenizer_path()
    spark = docs.sparkSession
    small_batches(spark)
    fold = fold_mod5(F.col("doc_id"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (fold == HELD_OUT).alias("held_out"), F.coalesce(fold != HELD_OUT, F.lit(False)).alias("train"))
    rows = rows.withColumn("d", F.coalesce("doc_id", F.lit(-(2**63)).cast("long")))
    n_bytes, n_train = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    tie = F.xxhash64("text")
    cut = ByteBuckets(rows.select("d", tie.alias("tie"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")), CHUNK_BYTES, LEAST_CHUNKS)
    rows = rows.withColumn("chunk", cut.of(F.col("d"), tie)).drop("d")
    got = materialize(answers(rows, max(LEAST_CHUNKS, -(-n_bytes // CHUNK_BYTES))), "word-counts")
    total, kinds = got.where(F.col("chunk") == TOTALS).agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    total += n_train
    fit = Fit(rows, n_bytes, n_train, None, path)
    scorer = Scorer(total, kinds + (n_train > 0), n_train, fit.model, path)
    asked = got.where(F.col("chunk") >= 0).select(F.col("chunk").alias("of"), "body")
    scorer.share = tuned(rows, asked, scorer)
    fit.kept()
    scorer.model = fit.model
    sent = spark.sparkContext.broadcast(scorer)

    def scored(own: pa.Table, counts: pa.Table) -> pa.Table:
        known, times = _known(counts)
        parts = [sent.value.score(texts, known, times) for _, texts in text_slices(own["text"].combine_chunks())]
        n = own.num_rows
        values = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
        arrays = [own["doc_id"].combine_chunks(), own["held_out"].combine_chunks(), *map(pa.array, (*values[:2], np.full(n, total), *values[2:], np.full(n, sent.value.share)))]
        textkernel.release(keep=True)
        return pa.Table.from_arrays(arrays, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "model_share"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, model_share double"
    return rows.select("doc_id", "text", "held_out", "chunk").groupBy("chunk").cogroup(asked.groupBy("of")).applyInArrow(scored, schema)


def query(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
