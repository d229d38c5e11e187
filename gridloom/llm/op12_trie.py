"""Conversation prefix trie by level-synchronous construction.

A node is a distinct sequence of first turns; at each depth its smallest member names it. Per depth, live conversations
are grouped by (parent node, next turn), and the least conv_id of a group becomes the node of its members. A group of one
is the top of a chain that no other conversation shares, so only members of larger groups stay live; levels end with the
last shared turn, and chains are laid out at once. Then level by level upwards, nodes join the sums of their children.

A turn is known by the SHA-256 of role and text, so texts are read once and never shuffled. Repeated rows of a turn are
counted before they are numbered, and numbers run on over range partitions, so a conversation of any length is dealt to
many tasks. A group of any size is aggregated in its tasks first; the join that names its members' node is broadcast
while there are few shared nodes, and else a sort-merge join whose large partitions Spark splits. The ids that end at a
node are joined to text in blocks of 4,096 possible ids, and the blocks stream through one hash: SHA-256 has no parts
that could be put together.

Null conv_id: left out. Null role or text: empty. Null turns come first; rows of one conversation with equal turns follow
in the order of their hashes; rows equal in all are turns of their own. Empty and turnless conversations end at the root.
Very long texts: whole. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import materialize, words

#: Turns that a live conversation carries at once.
CHUNK = 16
#: Shared nodes of a level that are broadcast at most (about 100 bytes each).
BROADCAST_NODES = 200_000
#: Bits of the ids in a block of ends.
BLOCK_BITS = 12
#: What the query's conversations share: h turns (hash mod HEADS) of the first conversation of each STRIDE ids.
STRIDE, HEADS = 20, 4
#: Equal rows laid out by one step.
REPEATS = 4096


def turn_key(role: Column, text: Column) -> Column:
    """SHA-256 of role and text; the role's length keeps the two apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, key, words): the turns of each conversation from 1 on, written once.

    Rows are dealt by range, so that a long conversation lies in several tasks; its ranks in a task follow those before.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", turn_key(F.col("role"), F.col("text")).alias("key"), F.size(words(F.col("text"))).cast("long").alias("words")
    )
    rows = materialize(rows.groupBy("conv_id", "turn", "key").agg(F.max("words").alias("words"), F.count(F.lit(1)).alias("m")), "trie-turns")
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "key", "words", "m", F.monotonically_increasing_id().alias("at"))
    dealt = materialize(dealt.withColumn("part", F.shiftright("at", 33)), "trie-dealt")
    inside = F.sum("m").over(Window.partitionBy("part", "conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # Only conversations that lie in several parts have an offset: fewer rows than parts.
    sums = dealt.groupBy("conv_id", "part").agg(F.sum("m").alias("turns"))
    before = F.sum("turns").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.withColumn("before", before).where("before > 0").select("conv_id", "part", "before")
    last = dealt.withColumn("inside", inside).join(F.broadcast(offsets), ["conv_id", "part"], "left").withColumn("last", F.col("inside") + F.coalesce("before", F.lit(0)))
    first = F.col("last") - F.col("m") + 1
    steps = last.select("conv_id", "key", "words", "last", F.explode(F.sequence(first, F.col("last"), F.lit(REPEATS))).alias("lo"))
    each = F.explode(F.sequence(F.col("lo"), F.least(F.col("lo") + REPEATS - 1, F.col("last"))))
    return materialize(steps.select("conv_id", each.alias("rank"), "key", "words"), "trie-numbered")


def plain(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spine, lengths) of the conversations as they are."""
    return turns.select("conv_id", F.col("rank").alias("pos"), "key", "words"), turns.groupBy("conv_id").agg(F.max("rank").alias("len"))


def rebuilt(turns: DataFrame, stride: int = STRIDE, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(spine, lengths) where each conversation c starts with the first h turns of c - c % stride in place of its own; h = crc32(c) % heads."""
    c = F.col("conv_id")
    head = (F.crc32(c.cast("string").cast("binary")) % heads).cast("long")
    lengths = turns.groupBy("conv_id").agg(F.max("rank").alias("n"))
    lengths = lengths.withColumns({"h": head, "base": c - c % stride})
    bases = lengths.where(c == F.col("base")).select("base", F.least("n", F.lit(heads - 1)).alias("base_n"))
    lengths = lengths.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
    lengths = materialize(lengths.select("conv_id", "base", "h", "given", (F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "trie-lengths")
    given = turns.where((F.col("rank") < heads) & (c % stride == 0)).select(c.alias("base"), F.col("rank").alias("pos"), "key", "words")
    starts = lengths.where("given > 0").select("conv_id", "base", "given").join(given, "base").where("pos <= given").select("conv_id", "pos", "key", "words")
    own = turns.where(F.col("rank") > head).join(lengths.select("conv_id", "h", "given"), "conv_id")
    own = own.select("conv_id", (F.col("rank") - F.col("h") + F.col("given")).alias("pos"), "key", "words")
    return starts.unionByName(own), lengths.select("conv_id", "len")


def ends_digest(ended: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of (depth, node, conv_id): hash of the ids in ascending order, with commas between."""
    block = F.shiftright("conv_id", BLOCK_BITS).alias("block")
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")  # one block has 4,096 different ids at most
    parts = ended.groupBy("depth", "node", block).agg(ids.alias("ids")).repartition("depth", "node").sortWithinPartitions("depth", "node", "block")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, h = None, None
        for b in batches:
            out = []
            for depth, node, ids in zip(b["depth"].to_pylist(), b["node"].to_pylist(), b["ids"].to_pylist(), strict=True):
                if at != (depth, node):
                    out += [(*at, h.hexdigest())] if at else []
                    at, h = (depth, node), hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            yield _digests(out)
        yield _digests([(*at, h.hexdigest())] if at else [])

    return parts.select("depth", "node", "ids").mapInArrow(hashed, "depth long, node long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    depth, node, sha = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(depth, pa.int64()), pa.array(node, pa.int64()), pa.array(sha, pa.string())], ["depth", "node", "ends_sha256"])


def trie(spine: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node (see `query`). spine: (conv_id, pos, key, words), pos from 1; lengths: (conv_id, len), every conversation."""
    spark = spine.sparkSession
    turn = F.struct("pos", "key", "words")
    chunk = F.floor((F.col("pos") - 1) / CHUNK).cast("long")
    chunks = spine.groupBy("conv_id", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    chunks = materialize(chunks.withColumn("n_turns", F.size("turns")), "trie-chunks")
    root, n = lengths.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    levels = [spark.createDataFrame([(0, None, root, n, 0)] if n else [], "depth long, parent long, node long, n long, words long")]
    lives = [lengths.select(F.lit(0).cast("long").alias("depth"), "conv_id", "len", F.lit(root).cast("long").alias("node"))]
    live, depth = lives[0], 0
    while True:
        depth += 1
        if (depth - 1) % CHUNK == 0:
            live = live.select("conv_id", "len", "node").join(chunks.where(F.col("chunk") == (depth - 1) // CHUNK).select("conv_id", "turns"), "conv_id")
        step = live.where(F.col("len") >= depth).select("conv_id", "len", F.col("node").alias("parent"), F.get("turns", F.lit(0)).alias("turn"), F.slice("turns", 2, CHUNK).alias("turns"))
        step = step.select("conv_id", "len", "parent", F.col("turn.key").alias("key"), F.col("turn.words").alias("words"), "turns")
        groups = step.groupBy("parent", "key").agg(F.min("conv_id").alias("node"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"))
        groups = materialize(groups.select(F.lit(depth).cast("long").alias("depth"), "parent", "key", "node", "n", "words"), f"trie-level-{depth}")
        levels.append(groups.drop("key"))
        shared = groups.where("n > 1").select("parent", "key", "node")
        n_shared = shared.count()
        if not n_shared:
            break
        met = step.join(F.broadcast(shared) if n_shared <= BROADCAST_NODES else shared, ["parent", "key"])
        live = materialize(met.select(F.lit(depth).cast("long").alias("depth"), "conv_id", "len", "node", "turns"), f"trie-live-{depth}")
        lives.append(live.select("depth", "conv_id", "len", "node"))

    done: list[DataFrame] = []
    for level, below in zip(reversed(levels[:-1]), reversed(levels[1:]), strict=True):
        single = below.where("n = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        kids = single.unionByName(done[-1].select("parent", "n_leaves", "saved_tokens")) if done else single
        kids = kids.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved"))
        up = level.where("n > 1 OR depth = 0").join(kids, "node", "left")
        up = up.select(
            "depth", "parent", "node", "n", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"),
            ((F.col("n") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved_tokens"),
        )
        done.append(materialize(up, "trie-up"))

    ended = _all(lives).where("len = depth").select("depth", "node", "conv_id")
    shared = _all(done).join(ends_digest(ended), ["depth", "node"], "left")
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    shared = shared.select(
        F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")
    )
    # Chains: from the first turn that a conversation shares with none to its last, chunk by chunk.
    tops = _all(levels[1:]).where("n = 1").select(F.col("node").alias("conv_id"), F.col("depth").alias("top"), F.col("parent").alias("above")).join(lengths, "conv_id")
    laid = chunks.select("conv_id", "chunk", "n_turns").join(tops, "conv_id").withColumn("lo", F.greatest("top", F.col("chunk") * CHUNK + 1)).withColumn("hi", F.col("chunk") * CHUNK + F.col("n_turns"))
    laid = laid.where("lo <= hi").select("conv_id", "top", "above", "len", F.explode(F.sequence("lo", "hi")).alias("depth"))
    last = F.col("depth") == F.col("len")
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    chains = laid.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"), one.alias("n_convs"),
        F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return shared.unionByName(chains)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of every node."""
    return trie(*rebuilt(numbered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


_CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ord(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda r, b: list_reduce(list_concat([xor(r, b)], range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))))"""

#: Nodes as distinct lists of turns; ancestors by prefix.
ORACLE = f"""
WITH o AS (SELECT conv_id AS c, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, role, text) AS w FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, w, ({_CRC} % {HEADS})::INT AS h, c - c % {STRIDE} AS base FROM o),
b AS MATERIALIZED (SELECT h.c, list_concat(coalesce(o.w, [])[1:h.h], h.w[h.h + 1:]) AS w FROM h LEFT JOIN o ON o.c = h.base),
m AS (SELECT c, w, unnest(range(len(w) + 1)) AS d FROM b),
n AS MATERIALIZED (SELECT w[1:d] AS p, d, min(c) AS node, count(*) AS n, string_agg(CASE WHEN d = len(w) THEN c::VARCHAR END, ',' ORDER BY c) AS ends FROM m GROUP BY ALL),
k AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS kids FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT n.*, coalesce(kids, 0) AS kids, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * len(list_filter(regexp_split_to_array(n.p[n.d].t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) END AS own
  FROM n LEFT JOIN k ON k.p = n.p AND k.d = n.d),
a AS (SELECT p[1:e] AS p, e AS d, own, kids FROM (SELECT *, unnest(range(d + 1)) AS e FROM s)),
t AS (SELECT p, d, sum(own) AS saved, sum((kids = 0)::INT) AS leaves FROM a GROUP BY ALL)
SELECT s.node AS conv_id, s.d AS depth, q.node AS parent_conv_id, s.n AS n_convs, s.kids AS n_children, t.leaves::BIGINT AS n_leaves, t.saved::BIGINT AS saved_tokens, sha256(coalesce(s.ends, '')) AS ends_sha256
FROM s JOIN t ON t.p = s.p AND t.d = s.d LEFT JOIN n q ON q.d = s.d - 1 AND q.p = s.p[1:s.d - 1]
"""
