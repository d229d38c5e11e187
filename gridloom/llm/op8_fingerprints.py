"""Document fingerprints by order MinHash. DataFrame functions only.

A text's k-mers are its runs of five words, numbered by occurrence, so that repeats count. For each of 64 points on the
ring of 64-bit hashes the two next k-mers are taken, put back into text order, and hashed as a pair: two texts agree at
a point only if they share the k-mers and their order, which is what makes the share of equal points follow edit
distance. One hash of each k-mer and one sort serve all 64 points; a point with no k-mer before the next uses the next,
so short texts have full signatures too.

Null and empty texts (and blank ones): all points 0, alike only to each other. Texts under five words: one k-mer, the
whole word sequence. Very long texts: time grows as n log n. Equal texts have equal fingerprints. Rows that repeat a
doc_id follow each other by text hash. Null doc_id: first in order. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import ByteBuckets, let, words

WORDS = 5
#: Points on the ring: 2 ** POINT_BITS values in a signature.
POINT_BITS = 6
POINTS = 1 << POINT_BITS
#: Bytes in a bucket of consecutive ids, about; what a row counts beside its text; buckets at least.
BUCKET_BYTES, ROW_BYTES, LEAST_BUCKETS = 8 << 20, 500, 64


def _kmers(w: Column) -> Column:
    """(hash, place) of each k-mer, sorted by hash, then place."""
    empty = F.array().cast("array<struct<h: bigint, p: int>>")
    whole = F.array(F.struct(F.xxhash64(w).alias("h"), F.lit(0).alias("p")))

    def runs(x: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(*[F.get(x, i + j) for j in range(WORDS)]).alias("h"), i.alias("p"))
        return F.transform(F.sequence(F.lit(0), F.size(x) - WORDS), at)

    return F.when(F.size(w) == 0, empty).when(F.size(w) < WORDS, whole).otherwise(let(F.transform(w, lambda v: F.xxhash64(v)), lambda x: F.sort_array(runs(x))))


def _starts(a: Column, key) -> Column:
    """Places of a sorted array at which `key` changes."""
    places = F.sequence(F.lit(0), F.size(a) - 1)
    return F.filter(places, lambda j: (j == 0) | (key(F.get(a, j)) != key(F.get(a, j - 1))))


def _numbered(a: Column) -> Column:
    """K-mers that occur again get a hash of (hash, occurrence); the first occurrence keeps its own."""

    def again(starts: Column) -> Column:
        def occurrences(s: Column, i: Column) -> Column:
            last = F.coalesce(F.get(starts, i + 1), F.size(a)) - 1
            element = lambda j: F.struct(
                F.when(j == s, F.get(a, j)["h"]).otherwise(F.xxhash64(F.get(a, j)["h"], j - s)).alias("h"), F.get(a, j)["p"].alias("p")
            )
            return F.transform(F.sequence(s, last), element)

        return F.when(F.size(starts) == F.size(a), a).otherwise(F.sort_array(F.flatten(F.transform(starts, occurrences))))

    return let(_starts(a, lambda e: e["h"]), again)


def _point(e: Column) -> Column:
    """The point that a k-mer lies before: the leading bits of its hash, in the order of the sorted array."""
    return F.shiftright(e["h"], 64 - POINT_BITS).cast("int") + POINTS // 2


def _points(b: Column) -> Column:
    """One 32-bit value for each point: its two next k-mers around the ring, in text order, hashed."""

    def pair(j: Column) -> Column:
        x, y = F.get(b, j), F.get(b, (j + 1) % F.size(b))
        both = F.when(F.size(b) == 1, F.xxhash64(x["h"])).when(x["p"] < y["p"], F.xxhash64(x["h"], y["h"])).otherwise(F.xxhash64(y["h"], x["h"]))
        return F.shiftright(both, 32).cast("int")

    def spread(firsts: Column) -> Column:
        before = lambda i: F.when(i == 0, F.lit(-1)).otherwise(_point(F.get(b, F.get(firsts, i - 1))))
        some = F.flatten(F.transform(firsts, lambda j, i: F.array_repeat(pair(j), _point(F.get(b, j)) - before(i))))
        wrap = F.array_repeat(pair(F.lit(0)), F.lit(POINTS - 1) - _point(F.get(b, F.size(b) - 1)))
        return F.concat(some, wrap)

    return let(_starts(b, _point), spread)


def signature(text: Column) -> Column:
    """array<int> of POINTS values."""
    blank = F.array_repeat(F.lit(0), POINTS)
    return let(let(words(text), _kmers), lambda a: F.when(F.size(a) == 0, blank).otherwise(let(_numbered(a), _points)))


def fingerprint(signature_: Column) -> Column:
    """The signature as text: 8 hexadecimal digits a point."""
    return F.array_join(F.transform(signature_, lambda v: F.lpad(F.hex(v.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of points at which two signatures agree."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(POINTS - 1)), lambda i: F.get(a, i) == F.get(b, i))) / F.lit(float(POINTS))


def with_next(docs: DataFrame) -> DataFrame:
    """Each document with the text and signature of the next by doc_id (`next_text`, `next_sig`); the last has the first.

    Documents are cut into runs of consecutive ids of about BUCKET_BYTES, by exact sums of their bytes; a bucket also gets
    the first document of the next one, so one shuffle by bucket is enough and no task holds more than a bucket. Rows
    that share one doc_id, or have none, are cut by their texts' hashes.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")).alias("d"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    buckets = ByteBuckets(rows.select("d", "tie", (F.octet_length("text") + ROW_BYTES).cast("long").alias("size")), BUCKET_BYTES, LEAST_BUCKETS)
    keyed = rows.withColumn("own", buckets.of(F.col("d"), F.col("tie")))
    own = F.struct(F.col("own").alias("b"), F.lit(0).alias("guest"))
    guest = F.struct(F.pmod(F.col("own") - 1, F.lit(len(buckets))).alias("b"), F.lit(1).alias("guest"))
    sent = (
        keyed.withColumn("sig", signature(F.col("text")))
        .withColumn("to", F.explode(F.when(buckets.is_first(F.col("own"), F.col("d"), F.col("tie")), F.array(own, guest)).otherwise(F.array(own))))
        .select("doc_id", "d", "tie", "text", "sig", F.col("to.b").alias("b"), F.col("to.guest").alias("guest"))
    )
    w = Window.partitionBy("b").orderBy("guest", "d", "tie")
    return (
        sent.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sig", F.lead("sig").over(w)).where("guest = 0").select("doc_id", "text", "sig", "next_text", "next_sig")
    )


def edited(text: Column, n_chars: Column, next_text: Column) -> Column:
    """The last floor(n/2) code points give way to the first as many (or all) of the next text."""
    half = F.floor(n_chars / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n_chars - half), F.substring(next_text, F.lit(1), half))


def query(spark, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.char_length("text")
    rows = rows.withColumn("edited", edited(F.col("text"), n, F.col("next_text")))
    rows = rows.withColumn("edited_sig", signature(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"),
        fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
