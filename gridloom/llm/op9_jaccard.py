"""N-gram Jaccard join: size-aware heavy-light set join, and the components of its links.

A document's set holds its distinct shingles of `shingle` words. Two sets link when 100 * intersection >= `percent` *
union. Both are arguments; the query takes 4 words and 85.

Documents with equal sets collapse to the smallest id first. Light sets (small ones) list all their subsets that a
linked partner could share, by hash: linked light sets have their intersection in common. Heavy sets list the rarest of
their shingles, enough of them that linked sets share one (an inverted list for each shingle is then scanned). Where
light ends is chosen by cost from the histogram of set sizes. Rarity comes from counts over all documents: a bounded
table of shingles that are frequent somewhere, and counters of all shingles by hash, which show those that are rare in
every stretch of text but frequent in all. Any order of shingles gives the same links; this one keeps lists short.

Candidates are never all pairs of a list: in each list all members meet the list's smallest set; what that leaves in
one component is done, and only members of different components still meet. So a group of thousands of near copies
costs about as many checks as it has members, and no link between different components is missed. Members of the longest
lists are not shuffled by the list, and where such a list still has to be met, it is met in parts. Parity sketches rule
out, without error, most candidates that share rare shingles and don't link. The rest are verified on the texts.

Null text and texts without words: empty set, linked with nothing. Under `shingle` words: the whole sequence is the one shingle.
Null doc_id: set size, no component. Rows that repeat a doc_id count as one document with the larger set. Very long
texts: whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm import textkernel
from gridloom.llm.common import BROADCAST_KEYS, materialize, semi_join_ids, small_batches
from gridloom.llm.components import components

#: The query's shingle length and percentage, and the defaults.
SHINGLE, PERCENT = 4, 85
#: Entries in the table of frequent shingles at most, and documents from which on a shingle is frequent.
FREQUENT_TABLE, FREQUENT = 500_000, 16
#: Bytes of text over which a task counts shingles before it sends those met twice.
COUNT_BYTES = 8 << 20
#: Counters of all shingles by hash.
COUNTERS = 1 << 18
#: Rows of counters that are added up at once, about.
FAN_IN = 16
#: Rows of one key (equal sets) are met in so many parts.
SALTS = 64
#: Lists from so many members on are long, if no more than BROADCAST_KEYS are; the pairs of one are met in so many parts.
LONG_LIST, PARTS = 128, 16
#: What a scanned list entry costs, with the verification it may lead to, against a hashed subset.
SCAN_COST = 8
LARGEST_LIGHT = 20
#: Words of 64 bits in a set's parity sketch.
SKETCH = 8


def need(n: int, percent: int = PERCENT) -> int:
    """Fewest elements that a set of n shares with a linked set."""
    return -(-percent * n // 100)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, shingle) pairs sorted by document and shingle: shingles, and each document's bounds."""
    words, bounds = textkernel.word_hashes(data, offsets, lower=True)
    at, doc = textkernel.places(bounds, k)
    grams = textkernel.ngrams(words, k)[at] if len(at) else np.zeros(0, np.uint64)
    count = np.diff(bounds)
    for n in range(1, k):
        short = np.flatnonzero(count == n)
        if len(short):
            grams = np.concatenate([grams, textkernel.ngrams(words, n)[bounds[short]]])
            doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    return grams[new], np.searchsorted(doc[new], np.arange(len(offsets)))


def _sliced(text: pa.Array, shingle: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, offsets = textkernel.buffers(text)
    for a, b in textkernel.slices(offsets):
        yield a, b, *shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], shingle)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return run[bounds[1:]] - run[bounds[:-1]]


def parities(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of SKETCH 64-bit words a document: for each of 512 hash buckets, whether its count of shingles is odd.

    Two sets differ in at least as many shingles as their sketches differ in bits: an exact bound on what they share.
    """
    n, width = len(bounds) - 1, 64 * SKETCH
    at = np.repeat(np.arange(n), np.diff(bounds)) * width + (grams >> np.uint64(64 - (width - 1).bit_length())).astype(np.int64)
    odd = (np.bincount(at, minlength=n * width) & 1).astype(np.uint8).reshape(n, width)
    return np.packbits(odd, axis=1).view(np.int64)


def heads(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (k1, k2) and its sketch."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, grams, bounds in _sliced(b["text"], shingle):
                k1, k2 = (_sums(textkernel.mix(grams + np.uint64(c)), bounds).view(np.int64) for c in (11, 12))
                sketch = pa.ListArray.from_arrays(np.arange(0, (j - i) * SKETCH + 1, SKETCH, dtype=np.int32), pa.array(parities(grams, bounds).ravel()))
                yield pa.RecordBatch.from_arrays([b["doc_id"].slice(i, j - i), pa.array(np.diff(bounds)), pa.array(k1), pa.array(k2), sketch], ["doc_id", "n", "k1", "k2", "sketch"])
        textkernel.release()

    return docs.mapInArrow(rows, "doc_id long, n long, k1 long, k2 long, sketch array<long>")


def near_enough(n: Column, s: Column, other_n: Column, other_s: Column, percent: int) -> Column:
    """False where the sketches prove that two sets don't link."""
    differ = sum(F.bit_count(F.get(s, k).bitwiseXOR(F.get(other_s, k))) for k in range(SKETCH))
    return differ * (100 + percent) <= (n + other_n) * (100 - percent)


def frequent(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequent shingles (sorted) and their counts, and for each of COUNTERS hash values by how much the count of all its
    shingles exceeds twice the mean; from all documents, in arrays of bounded size.

    A task counts over stretches of text and sends shingles that it met in two documents or more; each task sends one row
    of counters.
    """

    def counted(grams: np.ndarray, into: np.ndarray) -> pa.RecordBatch:
        into += np.bincount((grams >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64), minlength=COUNTERS)
        t, n = np.unique(grams, return_counts=True)
        t, n = t[n > 1], n[n > 1]
        return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(n.astype(np.int32)), pa.nulls(len(t), pa.binary())], ["t", "c", "counters"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, into = [], 0, np.zeros(COUNTERS, np.int64)
        for b in batches:
            for _, _, grams, _ in _sliced(b["text"], shingle):
                held.append(grams)
                size += len(grams) * 6
                if size >= COUNT_BYTES:
                    yield counted(np.concatenate(held), into)
                    held, size = [], 0
        if held:
            yield counted(np.concatenate(held), into)
        if into.any():
            body = zstandard.ZstdCompressor(1).compress(into.view(np.uint8).reshape(-1, 8).T.tobytes())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([body], pa.binary())], ["t", "c", "counters"])
        textkernel.release()

    got = materialize(docs.select("text").mapInArrow(rows, "t long, c int, counters binary"), "shingle-counts")
    counts = got.where("t IS NOT NULL").groupBy("t").agg(F.sum("c").alias("c")).where(F.col("c") >= FREQUENT)
    table = counts.orderBy(F.desc("c"), "t").limit(FREQUENT_TABLE).toArrow()
    t, c = table["t"].to_numpy().view(np.uint64), table["c"].to_numpy()
    order = np.argsort(t)
    total = _added(got.where("counters IS NOT NULL").select("counters"))
    return t[order], c[order], np.maximum(total - 2 * int(total.mean()), 0)


def _added(blobs: DataFrame) -> np.ndarray:
    """Sum of rows of counters, a few at a time in tasks before the driver adds up what is left."""

    def unpacked(body: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(unpacked(b) for b in pdf["counters"])
        return pd.DataFrame({"counters": [zstandard.ZstdCompressor(1).compress(total.view(np.uint8).reshape(-1, 8).T.tobytes())]})

    n = blobs.count()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        blobs = materialize(blobs.groupBy(F.pmod(F.xxhash64("counters"), F.lit(n))).applyInPandas(add, "counters binary"), "shingle-counters")
    return sum((unpacked(r["counters"]) for r in blobs.collect()), np.zeros(COUNTERS, np.int64))


def light_boundary(histogram: dict[int, int], shingle: int, percent: int) -> int:
    """Largest light set size: the one at which hashed subsets plus scanned list entries cost least."""

    def subsets(n: int) -> int:
        return sum(comb(n, r) for r in range(n - need(n, percent) + 1))

    def cost(light: int) -> float:
        hashed = sum(c * subsets(n) for n, c in histogram.items() if n <= light * 100 // percent)
        return hashed + sum(SCAN_COST * c * (n - need(n, percent) + 1) for n, c in histogram.items() if n > light)

    return min(range(shingle, LARGEST_LIGHT + 1), key=cost)


def listed(docs: DataFrame, light: int, table: tuple[np.ndarray, np.ndarray, np.ndarray], shingle: int, percent: int) -> DataFrame:
    """token, doc, n, small: entries of subsets and inverted lists. `small`: may be the smaller set of a pair."""
    sent = docs.sparkSession.sparkContext.broadcast(table)
    hashed = light * 100 // percent  # the largest set that a light one can link with

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, counters = sent.value
        for b in batches:
            ids = b["doc_id"].to_numpy()
            for i, _, grams, bounds in _sliced(b["text"], shingle):
                n = np.diff(bounds)
                doc = np.repeat(np.arange(len(n)), n)
                rank = counters[(grams >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)]
                if len(terms) and len(grams):
                    at = np.minimum(np.searchsorted(terms, grams), len(terms) - 1)
                    known = terms[at] == grams
                    rank[known] = np.maximum(rank[known], counts[at[known]])
                order = np.lexsort((grams, rank, doc))
                place = np.arange(len(grams)) - np.repeat(bounds[:-1], n)
                size = n[doc]
                probe = place <= size - -(-percent * size // 100)
                index = place <= size - -(-2 * percent * size // (100 + percent))
                heavy = (size > light) & probe
                token, owner, small = [grams[order][heavy]], [doc[heavy]], [index[heavy]]
                few = np.flatnonzero((n * (100 - percent) >= percent) & (n <= hashed))  # smaller sets link with equal ones only
                mixed = textkernel.mix(grams + np.uint64(13))
                for d in few:
                    own = mixed[bounds[d] : bounds[d + 1]]
                    whole = own.sum(dtype=np.uint64)
                    with np.errstate(over="ignore"):  # hashes wrap
                        keys = [whole - own[list(gone)].sum(dtype=np.uint64) for r in range(len(own) - need(len(own), percent) + 1) for gone in combinations(range(len(own)), r)]
                    token.append(textkernel.mix(np.asarray(keys, np.uint64)))
                    owner.append(np.full(len(keys), d))
                    small.append(np.ones(len(keys), bool))
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(token).view(np.int64)), pa.array(ids[i + owner]), pa.array(n[owner].astype(np.int32)), pa.array(np.concatenate(small))],
                    ["token", "doc", "n", "small"],
                )
        textkernel.release()

    return docs.mapInArrow(rows, "token long, doc long, n int, small boolean")


def _shingles(text: bytes | None, shingle: int) -> frozenset:
    words = (text or b"").lower().split()
    return frozenset(tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))) if words else frozenset()


def verify(pairs: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by their texts. Only the texts of candidates are shuffled."""
    ids = pairs.select(F.col("a").alias("doc_id")).distinct().union(pairs.select(F.col("b").alias("doc_id")).distinct()).distinct()
    ids = materialize(ids, "candidates")
    texts = semi_join_ids(docs, ids, "doc_id", ids.count())
    left, right = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "ta", "tb")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, frozenset()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            ta, tb = batch["ta"].cast(pa.large_binary()), batch["tb"].cast(pa.large_binary())
            for i, b in enumerate(batch["b"].to_pylist()):
                if b != last:
                    last, own = b, _shingles(tb[i].as_py(), shingle)
                other = _shingles(ta[i].as_py(), shingle)
                both = len(own & other)
                keep[i] = both > 0 and 100 * both >= percent * (len(own) + len(other) - both)
            yield batch.select(["a", "b"]).filter(pa.array(keep))
        last, own = None, frozenset()
        textkernel.release()

    return met.mapInArrow(rows, "a long, b long")


def _labelled(rows: DataFrame, labels: DataFrame, key: str, name: str) -> DataFrame:
    """`rows` with the component of `key` (itself where it has no link yet)."""
    out = rows.join(labels.select(F.col("node").alias(key), F.col("label").alias("__l")), key, "left")
    return out.withColumn(name, F.coalesce("__l", key)).drop("__l")


def long_lists(lists: DataFrame) -> DataFrame:
    """The tokens of the longest lists, BROADCAST_KEYS at most, largest first by powers of two.

    Any other list has under LONG_LIST members, or under two in BROADCAST_KEYS of all entries.
    """
    sizes = lists.where(F.col("members") >= LONG_LIST).groupBy(F.length(F.bin("members")).alias("bits")).count().collect()
    least, n = LONG_LIST, 0
    for r in sorted(sizes, key=lambda r: -r["bits"]):
        n += r["count"]
        if n > BROADCAST_KEYS:
            least = max(LONG_LIST, 1 << r["bits"])
            break
    return lists.where(F.col("members") >= least).select("token")


def by_token(rows: DataFrame, table: DataFrame, longest: DataFrame) -> DataFrame:
    """`rows` joined with `table` (one row a token). Rows of the longest lists stay where they are, the others are shuffled."""
    hot = table.join(F.broadcast(longest), "token", "left_semi")
    cold = table.join(F.broadcast(longest), "token", "left_anti")
    return rows.join(F.broadcast(hot), "token").union(rows.join(F.broadcast(longest), "token", "left_anti").join(cold, "token"))


def links(docs: DataFrame, entries: DataFrame, sketches: DataFrame, shingle: int, percent: int) -> DataFrame:
    """node, label for every document with a link; `entries`: token lists of documents with different sets."""
    first_sketch = sketches.select(F.col("doc").alias("a"), F.col("sketch").alias("sa"))
    second_sketch = sketches.select(F.col("doc").alias("b"), F.col("sketch").alias("sb"))
    first = F.min(F.when(F.col("small"), F.struct("n", "doc")))
    lists = entries.groupBy("token").agg(first.alias("hub"), F.count(F.lit(1)).alias("members")).where("members > 1 AND hub IS NOT NULL")
    lists = materialize(lists.select("token", F.col("hub.n").alias("hub_n"), F.col("hub.doc").alias("hub"), "members"), "lists")
    longest = long_lists(lists)
    members = materialize(by_token(entries, lists.drop("members"), longest).where("doc <> hub"), "members")
    fits = F.col("hub_n") * 100 >= F.col("n") * percent
    meets = members.where(fits & (F.col("hub_n") <= F.col("n"))).groupBy(F.col("doc").alias("a"), F.col("hub").alias("b")).agg(F.first("n").alias("na"), F.first("hub_n").alias("nb"))
    meets = meets.join(first_sketch, "a").join(second_sketch, "b").where(near_enough(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"), percent)).select("a", "b")
    meets = materialize(meets, "meets")
    found = materialize(verify(meets.groupBy("a").agg(F.min("b").alias("b")), docs, shingle, percent), "links")
    labels = components(found)
    more = _labelled(_labelled(meets, labels, "a", "la"), labels, "b", "lb").where("la <> lb")
    tried = meets.groupBy("a").agg(F.min("b").alias("b"))
    more = materialize(more.join(tried, ["a", "b"], "left_anti").select("a", "b"), "meets-2")
    found = found.union(materialize(verify(more, docs, shingle, percent), "links"))
    labels = components(found)
    # What is left: members of one list, none of them its hub, that are still in different components.
    left = _labelled(members, labels, "doc", "label")
    mixed = materialize(left.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("token"), "mixed")
    left = left.join(F.broadcast(mixed), "token") if mixed.count() <= BROADCAST_KEYS else by_token(left, mixed, longest)
    left = _labelled(left, labels, "hub", "hub_label").join(sketches, "doc")
    left = materialize(left.join(F.broadcast(longest.withColumn("long", F.lit(True))), "token", "left"), "left")
    out = left.where("label <> hub_label").select("token", "long", *[F.col(c).alias(f"{c}_o") for c in ("doc", "n", "small", "label", "sketch")])
    # A long list is met in parts: each member in one of them, those outside the hub's component in all.
    left = left.withColumn("part", F.when(F.col("long"), F.pmod(F.xxhash64("doc"), F.lit(PARTS)).cast("int")).otherwise(0)).drop("long")
    out = out.withColumn("part", F.explode(F.when(F.col("long"), F.array(*map(F.lit, range(PARTS)))).otherwise(F.array(F.lit(0))))).drop("long")
    smaller = F.struct("n", "doc") < F.struct(F.col("n_o").alias("n"), F.col("doc_o").alias("doc"))
    may = (F.col("label") != F.col("label_o")) & (F.least("n", "n_o") * 100 >= F.greatest("n", "n_o") * percent) & F.when(smaller, F.col("small")).otherwise(F.col("small_o"))
    may = may & near_enough(F.col("n"), F.col("sketch"), F.col("n_o"), F.col("sketch_o"), percent)
    rest = left.join(out, ["token", "part"]).where(may).select(F.greatest("doc", "doc_o").alias("a"), F.least("doc", "doc_o").alias("b")).distinct()
    turned = meets.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = materialize(rest.join(turned, ["a", "b"], "left_anti"), "meets-3")
    found = found.union(materialize(verify(rest, docs, shingle, percent), "links"))
    return components(found)


def with_smallest(known: DataFrame) -> DataFrame:
    """`known` with the smallest doc_id of its set (`rep`). Copies are met in SALTS parts, so that no task gets a whole group."""
    salted = known.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    parts = salted.groupBy("n", "k1", "k2", "salt").agg(F.min("doc_id").alias("rep"))
    whole = parts.groupBy("n", "k1", "k2").agg(F.min("rep").alias("rep"), F.collect_list("salt").alias("salts"))  # SALTS at most
    return salted.join(whole.withColumn("salt", F.explode("salts")).drop("salts"), ["n", "k1", "k2", "salt"])


def join(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = materialize(heads(rows, shingle), "heads")
    known = head.where("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.max(F.struct("n", "k1", "k2", "sketch")).alias("s")).select("doc_id", "s.*")
    same = materialize(with_smallest(known).select("doc_id", "rep", "n", "sketch"), "same-sets")
    copies = same.where("doc_id <> rep").select("doc_id")
    n_copies = copies.count()
    own = rows.where("doc_id IS NOT NULL AND text IS NOT NULL")
    own = semi_join_ids(own, copies, "doc_id", n_copies, "left_anti")
    histogram = {r["n"]: r["count"] for r in same.where("doc_id = rep").groupBy(F.least("n", F.lit(1000)).alias("n")).count().collect()}
    entries = materialize(listed(own, light_boundary(histogram, shingle, percent), frequent(rows, shingle), shingle, percent), "entries")
    sketches = same.where("doc_id = rep").select(F.col("doc_id").alias("doc"), "sketch")
    labels = links(rows.where("doc_id IS NOT NULL"), entries, sketches, shingle, percent)
    classes = _labelled(same, labels, "rep", "component_id").select("doc_id", "component_id")
    out = head.join(classes, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The documents with the smallest id of their component, all columns kept; rows without an id are kept."""
    gone = materialize(join(docs, shingle, percent).where("component_id <> doc_id").select(F.col("doc_id").alias("__id")).distinct(), "copies")
    n = gone.count()
    return docs.join(F.broadcast(gone) if n <= BROADCAST_KEYS else gone, docs["doc_id"] == gone["__id"], "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHINGLE, PERCENT)


ORACLE = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[p : p + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * i >= 85 * (nx.n + ny.n - i)),
both_ways AS MATERIALIZED (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT b.y, reach.r FROM reach JOIN both_ways b ON b.x = reach.v)
SELECT v AS doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM reach LEFT JOIN n ON n.doc_id = v GROUP BY v
"""
