"""Benchmark decontamination by spaced-seed hashing. DataFrame functions only.

A seed hashes the words at the ones of a fixed mask, so words at its zeros may differ. Seeds of the benchmark's items
join those of every place of every document; for each diagonal with a hit document and item are compared word by word,
and the hit stands if some window of 13 words (the whole item where shorter) agrees in at least 10 (`need`). The masks
leave no allowed pattern of changed words without a seed, so all that the rule accepts is found; the SQL states the rule
without seeds.

Words: the lower-cased text, cut at white space and ASCII punctuation. Items of 4 to 7 words match where all their words
follow each other in a document; items of fewer words match documents that have just these words.

The benchmark's seeds are broadcast while there are at most BLOCK_SEEDS, so the search shuffles no document; a larger
benchmark's seeds are joined by a shuffle, in the same one pass. A passage that a third of all documents share costs no
more than its hits, which are counted by diagonal in their task before they are shuffled. Only texts of documents with
hits are read again, and hashed once each.

Null or empty texts: no words, no hits. Repeated rows share a doc_id and are reported once. Null doc_id or item_id:
reported as null. Very long texts: whole, place by place. Empty tables: no rows. Extra columns are ignored, and kept by
`decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import BROADCAST_KEYS, let, materialize

#: Masks of two runs of two ones, by the second run's place: 1111, 11011 and 1100011. Whatever words `need` lets differ, one fits between them.
RUN, MASKS = 2, (2, 3, 5)
#: Words of the window that is verified, and how many of them must agree.
WINDOW, AGREE = 13, 10
#: Items of fewer words must agree in all of them.
EXACT_BELOW = 8
#: Items and documents of fewer words have one seed, of all their words.
LEAST_SEEDED = 4
#: Seeds in a broadcast at most (some tens of MB); those of a larger benchmark are shuffled.
BLOCK_SEEDS = 500_000

#: White space and ASCII punctuation: what separates words here.
_GAP = r"[\x20\x09-\x0D!-/:-@\[-`{-~]+"


def word_hashes(text: Column) -> Column:
    return F.transform(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _GAP), ""), lambda w: F.xxhash64(w))


def _span(mask: int, run: int) -> int:
    return mask + run


def _with_later(x: Column, y: Column, gap: int) -> Column:
    """Hash of each element of x with the element of y `gap` places on, as far as there is one."""
    n = F.greatest(F.size(y) - gap, F.lit(0))
    return F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(gap + 1), n), lambda a, b: F.xxhash64(a, b))


def seeds(w: Column, run: int = RUN, masks: tuple[int, ...] = MASKS) -> Column:
    """Seeds of all masks, one mask after another, at all their places; see `place_of`."""
    none = F.array().cast("array<bigint>")
    runs = _with_later(w, w, 1)
    for k in range(2, run):
        runs = let(runs, lambda r, k=k: _with_later(r, w, k))
    spaced = let(runs, lambda r: F.concat(*[_with_later(r, r, m) for m in masks]))
    return F.when(F.size(w) == 0, none).when(F.size(w) < LEAST_SEEDED, F.array(F.xxhash64(w))).otherwise(spaced)


def need(n: Column) -> Column:
    """Words of an item of n words that must agree in a window of it."""
    return F.when(n < EXACT_BELOW, n).otherwise(F.least(F.lit(AGREE), F.ceil(n * AGREE / WINDOW))).cast("int")


def place_of(index: Column, n_words: Column, run: int = RUN, masks: tuple[int, ...] = MASKS) -> Column:
    """The place in the text of the seed at `index` of `seeds`."""
    out, before = index, F.lit(0)
    for m in masks[:-1]:
        before = before + F.greatest(n_words - _span(m, run) + 1, F.lit(0))
        out = F.when(index >= before, index - before).otherwise(out)
    return out


def agreement(item: Column, doc: Column, shift: Column) -> Column:
    """Most words that agree in a window of the item laid over the document from `shift` on."""
    width = F.least(F.size(item), F.lit(WINDOW))
    same = F.transform(item, lambda v, k: F.coalesce((F.get(doc, shift + k) == v).cast("int"), F.lit(0)))
    return F.array_max(
        F.transform(
            F.transform(F.array(same), lambda s: F.transform(F.sequence(F.lit(0), F.size(item) - width), lambda a: F.aggregate(F.slice(s, a + 1, width), F.lit(0), lambda x, y: x + y))),
            lambda x: F.array_max(x),
        )
    )


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, agree (most words in a window), place (of the item's first word in the document; the smallest)."""
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("item")).where(F.size("item") > 0)
    n_seeds = (items.agg(F.sum(F.size("item"))).first()[0] or 0) * len(MASKS)
    places = docs.select("doc_id", word_hashes(F.col("text")).alias("doc")).select("doc_id", F.size("doc").alias("n"), seeds(F.col("doc")).alias("seeds"))
    # The outer form: for the inner one the planner adds a filter on the size, which computes all seeds once more.
    places = places.select("doc_id", "n", F.posexplode_outer("seeds").alias("at", "seed"))
    probe = items.select("item_id", F.size("item").alias("m"), F.posexplode(seeds(F.col("item"))).alias("item_at", "seed"))
    hits = places.join(F.broadcast(probe) if n_seeds <= BLOCK_SEEDS else probe, "seed")
    shift = place_of(F.col("at"), F.col("n")) - place_of(F.col("item_at"), F.col("m"))
    hits = materialize(hits.select("doc_id", "item_id", shift.alias("shift")).distinct(), "seed-hits")
    few = hits.count() <= BROADCAST_KEYS
    small = F.broadcast if few else lambda x: x
    ids = hits.select(F.col("doc_id").alias("h_id")).distinct()
    hashed = docs.select("doc_id", "text").join(small(ids), F.col("doc_id").eqNullSafe(F.col("h_id")), "left_semi").select("doc_id", word_hashes(F.col("text")).alias("doc"))
    met = hashed.join(small(hits.withColumnsRenamed({"doc_id": "h_doc", "item_id": "h_item"})), F.col("doc_id").eqNullSafe(F.col("h_doc")))
    met = met.join(F.broadcast(items) if n_seeds <= BLOCK_SEEDS else items, F.col("h_item").eqNullSafe(F.col("item_id")))
    met = met.select("doc_id", "item_id", "shift", F.size("item").alias("m"), agreement(F.col("item"), F.col("doc"), F.col("shift")).alias("agree"))
    return met.where(F.col("agree") >= need(F.col("m"))).groupBy("doc_id", "item_id").agg(F.max("agree").alias("agree"), F.min("shift").alias("place"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a leak, all columns kept; rows without an id are kept unless some such row leaks."""
    ids = materialize(leaks(docs, benchmark).select(F.col("doc_id").alias("__id")).distinct(), "leaks")
    n = ids.count()
    same = docs["doc_id"].eqNullSafe(ids["__id"])
    return docs.join(F.broadcast(ids) if n <= BROADCAST_KEYS else ids, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return leaks(*(spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")))


_CUT = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D!-/:-@\[-`{-~]+'), lambda x: x <> '')"

#: The rule by itself: every diagonal on which enough words are equal, then its best window.
ORACLE = f"""
WITH dw AS MATERIALIZED (SELECT doc_id, {_CUT} AS w FROM documents),
iw AS MATERIALIZED (SELECT item_id, w, len(w) AS m, CASE WHEN len(w) < {EXACT_BELOW} THEN len(w) ELSE least({AGREE}, ceil(len(w) * {AGREE} / {WINDOW})) END AS need
  FROM (SELECT item_id, {_CUT} AS w FROM benchmark) WHERE len(w) > 0),
dp AS (SELECT doc_id, len(w) AS n, unnest(w) AS t, generate_subscripts(w, 1) AS p FROM dw),
ip AS (SELECT item_id, need, m, unnest(w) AS t, generate_subscripts(w, 1) AS q FROM iw),
h AS MATERIALIZED (SELECT doc_id, item_id, p - q AS shift FROM dp JOIN ip USING (t) WHERE m >= {LEAST_SEEDED} OR n = m GROUP BY 1, 2, 3 HAVING count(*) >= max(need)),
a AS (SELECT doc_id, item_id, shift, need, least(m, {WINDOW}) AS width, m,
  list_transform(range(1, m + 1), lambda k: CASE WHEN k + shift >= 1 AND dw.w[k + shift] = iw.w[k] THEN 1 ELSE 0 END) AS same FROM h JOIN iw USING (item_id) JOIN dw USING (doc_id)),
b AS (SELECT *, list_max(list_transform(range(1, m - width + 2), lambda s: list_sum(same[s : s + width - 1]))) AS agree FROM a)
SELECT doc_id, item_id, max(agree)::INT AS agree, min(shift)::INT AS place FROM b WHERE agree >= need GROUP BY 1, 2
"""
