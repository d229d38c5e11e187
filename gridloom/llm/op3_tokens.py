"""Token-ID output: one concatenated id array in ascending doc_id order with Elias-Fano coded document boundaries.

Format: a Parquet data set, one row a segment of consecutive documents: `first_doc`, `seq`, `n_docs`, `n_ids`, `ids`
(little-endian uint16, or uint32 for larger vocabularies, every document closed by the end id), the Elias-Fano structure
of the documents' end offsets (`universe`, `low_bits`, `low`, `high`, `samples`) and one of their doc_ids, as distances
from `first_doc` (`doc_...`; the segment's first `n_null` documents have none). Parquet carries the bytes, so that any
store Spark can write to takes them; a segment is a few MB, read independently.

Documents are range-partitioned by doc_id (their one shuffle), tokenized where they land and written. A document's
global start is its segment's start (a running sum over segments) plus a select in the segment: `read` selects the ends
and ids of SAMPLE documents at a time and never unpacks a whole structure.

Null or empty text: only the end id. Null doc_id: sorts first. Repeated rows: each encoded. Empty table: no segments.
Very long texts: encoded whole, a segment of their own. Extra columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import textkernel
from gridloom.llm.common import BROADCAST_KEYS, scratch, small_batches
from gridloom.llm.eliasfano import SAMPLE, EliasFano

END_ID = 1
#: Ids in a segment before it is closed.
SEGMENT_IDS = 1 << 20
#: Pieces of words that a worker remembers (about 200 bytes each); beyond it those not met of late are forgotten.
MEMO_WORDS = 500_000

#: Distance between a segment's doc_ids at most.
MOST_SPAN = 1 << 62
#: Columns of an Elias-Fano structure.
CODED = "universe long, low_bits int, low binary, high binary, samples binary"
SCHEMA = f"first_doc long, seq int, n_docs int, n_null int, n_ids long, width int, ids binary, {CODED}, doc_{CODED.replace(', ', ', doc_')}"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE's letters: printable Latin-1 stands for itself, other bytes for letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(256 + i) for i, b in enumerate(others) if b != 32}  # a space stands between pieces


#: Kinds of bytes in a word: 0 letters (A-Z, a-z and those led by C3), 1 digits, 2 punctuation, 3 for the tokenizer itself.
_KIND = np.full(256, 3, np.uint8)
_KIND[33:127] = 2
_KIND[48:58] = 1
_KIND[[*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)]] = 0
_KIND[0x27] = 3  # an apostrophe may start a piece that holds letters
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Pieces that go to the tokenizer as one text.
TOGETHER = 256


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ..., count[0] of them, then those of the next."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def bounds_of(count: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(count, dtype=np.int64)])


@dataclass
class Encoded:
    """Ids of a batch of texts by distinct word: `code` of each word in text order, and the ids of each distinct word."""

    n_words: np.ndarray  # by text
    code: np.ndarray
    distinct: pa.Array  # binary
    ids: np.ndarray  # of the distinct words, one after another
    bounds: np.ndarray  # of the distinct words in `ids`

    def word_sizes(self) -> np.ndarray:
        """Ids of each word of the texts."""
        return np.diff(self.bounds)[self.code]

    def flat(self) -> np.ndarray:
        """Ids of all texts, one after another."""
        return self.ids[ranges(self.bounds[:-1][self.code], self.word_sizes())]

    def text_bounds(self) -> np.ndarray:
        """Bounds of the texts in `flat`."""
        return bounds_of(self.word_sizes())[bounds_of(self.n_words)]


class WordEncoder:
    """Encodes texts by their distinct words with the tokenizer, and remembers the pieces that words are made of.

    The tokenizer drops white space and never joins pieces across it, so a text's ids are those of its words in order.
    In words of ASCII and Latin-1 letters, digits and punctuation other than apostrophes, its pieces are runs of letters,
    single digits and runs of punctuation; they are cut and lower-cased here and go to its model many at a time. Any
    other word goes to the tokenizer as it is.
    """

    def __init__(self, path: str, width: int = 2):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = Tokenizer(self.tokenizer.model)  # the same merges in the same place, without normalization
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        if hasattr(self.pieces.model, "_resize_cache"):
            self.pieces.model._resize_cache(0)  # what is asked was just found to be new
        self.type = np.dtype(f"<u{width}")
        vocabulary, suffix = self.pieces.get_vocab(), self.pieces.model.end_of_word_suffix
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a piece
        self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.letters = _byte_letters()
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _ask(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces that the model takes as they are."""
        place = sorted(range(len(pieces)), key=lambda i: not pieces[i].isascii())  # translation is for few texts
        texts = [b" ".join([pieces[i] for i in place[k : k + TOGETHER]]).decode("latin-1") for k in range(0, len(pieces), TOGETHER)]
        texts = [t if t.isascii() else t.translate(self.letters) for t in texts]
        found = []
        for e in self.pieces.encode_batch_fast(texts, add_special_tokens=False):
            ids = np.asarray(e.ids, self.type)
            raw, stop = ids.tobytes(), ((np.flatnonzero(self.ends[ids]) + 1) * self.type.itemsize).tolist()
            found += [raw[a:z] for a, z in zip([0, *stop[:-1]], stop, strict=True)]
        out = [b""] * len(pieces)
        for i, ids in zip(place, found, strict=True):
            out[i] = ids
        return out

    def _ask_whole(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)
        return [np.asarray(e.ids, self.type).tobytes() for e in found]

    def _lookup(self, keys: list[bytes], ask: Callable[[list[bytes]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct keys, one after another, and their bounds."""
        young, old = self.young, self.old
        found = list(map(young.get, keys))
        missing = []
        for i, ids in enumerate(found):
            if ids is None:
                ids = old.get(keys[i])
                if ids is None:
                    missing.append(i)
                else:
                    found[i] = young[keys[i]] = ids
        if missing:
            for i, ids in zip(missing, ask([keys[i] for i in missing]), strict=True):
                found[i] = young[keys[i]] = ids
        if len(young) > MEMO_WORDS // 2:  # those not met again until this happens once more are forgotten
            self.young, self.old = {}, young
        size = np.fromiter(map(len, found), np.int64, len(found)) // self.type.itemsize
        return np.frombuffer(b"".join(found), self.type), bounds_of(size)

    def distinct_ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, one after another, and their bounds."""
        data, bounds = textkernel.buffers(words)
        n = len(words)
        kind = _KIND[data]
        bad = kind == 3
        lead = data == 0xC3
        bad[1:] |= lead[:-1] & ((data[1:] == 0x97) | (data[1:] == 0xB7))  # no letters
        bad[1:] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # special tokens start so
        follows = (data & 0xC0) == 0x80
        bad[1:] |= follows[1:] != lead[:-1]
        size = np.diff(bounds)
        first = bounds[:-1][size > 0]
        other = np.zeros(n, bool)
        other[size > 0] = np.logical_or.reduceat(bad, first) if len(first) else False
        low = data.copy()
        low[_UPPER[data]] += 32
        high = np.zeros(len(data), bool)
        high[1:] = lead[:-1] & (data[1:] < 0x9F)
        low[high] += 32
        new = np.ones(len(data), bool)
        new[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 1)
        new[first] = True
        keep = np.repeat(~other, size)
        start = np.flatnonzero(new & keep)
        stop = np.flatnonzero(np.append((new | ~keep)[1:], True) & keep) + 1
        parts = pa.Array.from_buffers(pa.large_binary(), int(keep.sum() > 0) * len(start), [None, pa.py_buffer(bounds_of(stop - start)), pa.py_buffer(low[keep])])
        parts = parts.dictionary_encode()
        ids, cut = self._lookup(parts.dictionary.to_pylist(), self._ask)
        piece = parts.indices.to_numpy()
        part_size = np.diff(cut)[piece]
        per_word = np.bincount(np.repeat(np.arange(n), size)[start], part_size, n).astype(np.int64)
        ids = ids[ranges(cut[:-1][piece], part_size)]
        if other.any():
            at = np.flatnonzero(other)
            whole, cut = self._lookup(words.take(pa.array(at)).to_pylist(), self._ask_whole)
            per_word[at] = np.diff(cut)
            out = np.empty(int(per_word.sum()), self.type)
            from_whole = np.repeat(other, per_word)
            out[from_whole], out[~from_whole] = whole, ids
            ids = out
        return ids, bounds_of(per_word)

    def batch(self, text: pa.Array) -> Encoded:
        """Ids of the texts (null: empty), without an end id."""
        n_words, code, distinct = split(text)
        return Encoded(n_words, code, distinct, *self.distinct_ids(distinct))


def split(text: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Number of words of each text, the code of each word, and the distinct words (binary) by code."""
    lists = pc.ascii_split_whitespace(text.fill_null(""))
    words = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py()).dictionary_encode()
    code, n_words = words.indices.to_numpy(), np.diff(lists.offsets.to_numpy()).astype(np.int64)
    distinct = words.dictionary.cast(pa.binary() if pa.types.is_string(text.type) else pa.large_binary())
    blank = pc.index(distinct, pa.scalar(b"", distinct.type)).as_py()
    if blank >= 0:
        solid = code != blank
        n_words = np.diff(bounds_of(solid)[bounds_of(n_words)])
        code = code[solid] - (code[solid] > blank)
        distinct = pa.concat_arrays([distinct.slice(0, blank), distinct.slice(blank + 1)])
    return n_words, code, distinct


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


textkernel.MEMORIES.append(_ENCODERS.clear)


def encoder(path: str, width: int) -> WordEncoder:
    """The process's encoder, kept until `textkernel.release`."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
    if (path, width) not in _ENCODERS:
        _ENCODERS[path, width] = WordEncoder(path, width)
    return _ENCODERS[path, width]


#: Bytes of text encoded at once.
ENCODE_BYTES = 4 << 20


def text_slices(column: pa.Array, most: int = ENCODE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """The column in stretches of about `most` bytes, with the place of each one's first text; a longer text stands alone."""
    offsets = bounds_of(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    for a, z in textkernel.slices(offsets, most):
        yield a, column.slice(a, z - a)


def segments(docs: DataFrame, path: str | None = None, end_id: int = END_ID, width: int = 2) -> DataFrame:
    """Segment rows of all documents."""
    small_batches(docs.sparkSession)
    path = path or tokenizer_path()
    end = np.asarray([end_id], f"<u{width}").tobytes()

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in SCHEMA.split(", ")]

    def close(ids: list[int | None], bodies: list[bytes], seq: int) -> pa.RecordBatch:
        some = [i for i in ids if i is not None]
        ends = EliasFano.encode(np.cumsum([len(b) // width for b in bodies]))
        places = EliasFano.encode(np.asarray(some, np.int64) - some[0] if some else np.zeros(0, np.int64))
        coded = [getattr(x, c.split()[0]) for x in (ends, places) for c in CODED.split(", ")]
        row = (some[0] if some else None, seq, len(ids), len(ids) - len(some), ends.universe, width, b"".join(bodies), *coded)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, ids, bodies, held, seq, first = encoder(path, width), [], [], 0, 0, None
        for b in batches:
            doc_ids = b["doc_id"].to_pylist()
            for at, texts in text_slices(b["text"]):
                found = words.batch(texts)
                raw, cut = found.flat().tobytes(), (found.text_bounds() * width).tolist()
                for i, a, z in zip(doc_ids[at : at + len(texts)], cut[:-1], cut[1:], strict=True):
                    if first is not None and i - first >= MOST_SPAN or held >= SEGMENT_IDS:
                        yield close(ids, bodies, seq)
                        ids, bodies, held, seq, first = [], [], 0, seq + 1, None
                    first = i if first is None else first
                    ids.append(i)
                    bodies.append(raw[a:z] + end)
                    held += len(bodies[-1]) // width
        if ids:
            yield close(ids, bodies, seq)
        del words
        textkernel.release()  # a worker waits for its next task without what it learnt

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return rows_in.mapInArrow(rows, SCHEMA)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID) -> None:
    segments(docs, tokenizer, end_id).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    Files are in order of doc_id: their sums (a row a file) are ordered first, then the segments within each file; ids
    are not shuffled.
    """
    table = spark.read.schema(SCHEMA).parquet(path)
    named = table.withColumn("part", F.col("_metadata.file_name"))
    heads = named.select("part", "seq", F.when(F.col("n_null") == 0, F.col("first_doc")).alias("first_doc"), "n_ids")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = heads.groupBy("part").agg(F.min_by("first_doc", "seq").alias("first_doc"), F.sum("n_ids").alias("n_ids"))
    files = files.select(F.col("part").alias("f_part"), before(Window.orderBy(F.asc_nulls_first("first_doc"), "part")).alias("f_start"))
    starts = heads.withColumn("start", before(Window.partitionBy("part").orderBy("seq"))).join(files, F.col("part") == F.col("f_part"))
    n_segments = heads.count()
    small = starts.select(F.col("part").alias("s_part"), F.col("seq").alias("s_seq"), (F.col("start") + F.col("f_start")).alias("start"))
    small = F.broadcast(small) if n_segments <= BROADCAST_KEYS else small
    joined = named.join(small, (F.col("part") == F.col("s_part")) & (F.col("seq") == F.col("s_seq")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, n_null = r["n_docs"], r["n_null"]
                ends, places = (EliasFano(k, *[r[p + c.split()[0]] for c in CODED.split(", ")]) for p, k in (("", n), ("doc_", n - n_null)))
                ids = np.frombuffer(r["ids"], f"<u{r['width']}")
                last = 0
                for a in range(0, n, SAMPLE):
                    z = min(a + SAMPLE, n)
                    stop = ends.select(a, z)
                    begin = np.concatenate([[last], stop[:-1]])
                    last = stop[-1]
                    crc = [zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(begin, stop, strict=True)]
                    none = np.arange(a, z) < n_null
                    doc_id = np.zeros(z - a, np.int64)
                    doc_id[~none] = places.select(max(a - n_null, 0), max(z - n_null, 0)) + (r["first_doc"] or 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_id, mask=none), pa.array(begin + r["start"]), pa.array(stop - begin), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    columns = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] not in ("seq", "n_ids")]
    return joined.select("start", *columns).mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def write_and_read(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    spark = docs.sparkSession
    path = scratch(spark, "token-ids")
    write(docs, path, tokenizer, end_id)
    return read(spark, path)


def query(spark, sf_dir: str) -> DataFrame:
    return write_and_read(spark.read.parquet(f"{sf_dir}/documents.parquet"))
