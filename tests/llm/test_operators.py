"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridloom.llm import attention, boosting, components, op1_sharding, op2_substrings, op3_tokens, op4_mixing, op5_lm, op6_quality, op7_toxicity, op8_fingerprints, op9_jaccard, op10_decontam
from gridloom.llm.eliasfano import EliasFano
from tests.llm.conftest import frame, passage

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, lower=False):
    text = (text or "").translate(LOWER) if lower else text or ""
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


# 1 ---------------------------------------------------------------------------------------------------------------------


def shards_hold(rows):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_sharding(spark, sf_dir, texts):
    rows = op1_sharding.query(spark, sf_dir).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    shards_hold(rows)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
    total = sum(r["size"] for r in rows)
    sums = collections.Counter()
    for r in rows:
        sums[r["shard"]] += r["size"]
    largest = max(r["size"] for r in rows)
    assert len(sums) == 16 and max(abs(v - total / 16) for v in sums.values()) <= largest


def test_sharding_cuts_a_group_of_copies(spark):
    df = frame(spark, [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)])
    sums = {r["shard"]: r["s"] for r in op1_sharding.assign(df).groupBy("shard").agg(F.sum("size").alias("s")).collect()}
    assert max(sums.values()) - min(sums.values()) <= 40


def test_sharding_odd_rows(odd, none, odd_rows):
    rows = op1_sharding.assign(odd).collect()
    assert len(rows) == len(odd_rows)
    shards_hold(rows)
    assert op1_sharding.assign(none).count() == 0


def test_write_shards(spark, odd, none, odd_rows, tmp_path):
    """Columns of the same names as those used inside stay as they are."""
    clash = odd.withColumn("key", F.lit("k")).withColumn("__id", F.lit("i")).withColumn("__crc", F.lit(7)).withColumn("slot", F.lit(8))
    op1_sharding.write_shards(clash, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.columns == [*clash.columns, "shard_"]
    plain = lambda df: sorted((tuple(r[c] for c in clash.columns) for r in df.collect()), key=repr)
    assert plain(back) == plain(clash) and len(plain(clash)) == len(odd_rows)
    want = {(r["doc_id"], r["text_crc32"]): r["shard"] for r in op1_sharding.assign(odd, 4).orderBy(F.desc("shard")).collect()}
    assert all(want[r["doc_id"], None if r["text"] is None else zlib.crc32(r["text"].encode())] == r["shard_"] for r in back.collect())
    op1_sharding.write_shards(none, str(tmp_path / "none"))


# 2 ---------------------------------------------------------------------------------------------------------------------


def cleaned(rows):
    first = {}
    for d, t in rows:
        if d is not None:
            w = words(t)
            for k in range(len(w) - 12):
                first[tuple(w[k : k + 13])] = min(d, first.get(tuple(w[k : k + 13]), d))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - 12) if d is not None else ():
            if first[tuple(w[k : k + 13])] < d:
                gone[k : k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), kept))
    return sorted(out, key=repr)


def test_substrings(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in op2_substrings.query(spark, sf_dir).collect()}
    for d, n, gone, kept in cleaned(texts.items()):
        assert (got[d]["n_words"], got[d]["n_removed"], got[d]["kept_sha256"]) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())


def test_substrings_overlapping_passages(spark):
    rng = random.Random(5)
    parts = [passage(rng, n) for n in (13, 14, 20, 40, 55)]
    rows = [(i, " ".join(rng.choice([passage(rng, rng.randrange(1, 9)), rng.choice(parts)]) for _ in range(8))) for i in range(120)]
    got = op2_substrings.dedup(frame(spark, rows)).collect()
    assert sorted(map(tuple, got), key=repr) == cleaned(rows)


def test_paths_are_maximal_and_follow_their_source(spark):
    """Pieces of one long repeat become one path; where source and document part, another begins."""
    rng = random.Random(15)
    long, other = passage(rng, 120, 10**6), passage(rng, 40, 10**6)
    rows = [(1, long), (2, f"{other} {long} tail"), (3, f"x {' '.join(long.split()[:50])} {' '.join(long.split()[60:])}"), (4, f"y {other} z")]
    df = frame(spark, rows).select("doc_id", "text", F.lit(0).cast("long").alias("tie"))
    found = op2_substrings.paths(df, 64)
    got = {(r["doc"], r["source"], r["start"], r["length"], r["source_start"]) for r in op2_substrings.glue(found).collect()}
    assert got == {(2, 1, 40, 108, 0), (3, 1, 1, 38, 0), (3, 1, 51, 48, 60), (4, 2, 1, 28, 0)} and found.count() > 4


def test_substrings_odd_rows(odd, none, odd_rows):
    assert sorted(map(tuple, op2_substrings.dedup(odd).collect()), key=repr) == cleaned([r[:2] for r in odd_rows])
    assert op2_substrings.dedup(none).count() == 0


# 3 ---------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 5000])
def test_elias_fano(n):
    v = np.sort(np.random.default_rng(n).integers(0, 40 * n + 1, n))
    e = EliasFano.encode(v)
    assert e.select(0, n).tolist() == v.tolist()
    for first, last in [(0, n // 2), (n // 3, n), (n // 2, n // 2), (max(n - 1, 0), n), (min(255, n), min(257, n))]:
        assert e.select(first, last).tolist() == v[first:last].tolist()
    assert n < 1000 or 8 * (len(e.low) + len(e.high)) / n < 2 + math.log2(40) + 1
    with pytest.raises(IndexError):
        e.select(0, n + 1)


def test_elias_fano_of_far_values():
    v = np.array([0, 0, 5, 2**61, 2**61 + 1, 2**62 - 1])
    assert EliasFano.encode(v).select(0, 6).tolist() == v.tolist()
    assert EliasFano.encode(v[5:]).select(0, 1).tolist() == v[5:].tolist()


def encoded(rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op3_tokens.tokenizer_path())
    out, start = [], 0
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_tokens(spark, sf_dir, texts):
    assert sorted(map(tuple, op3_tokens.query(spark, sf_dir).collect())) == encoded(sorted(texts.items()))


def test_tokens_odd_rows(odd, none, odd_rows):
    got = sorted(map(tuple, op3_tokens.write_and_read(odd).collect()), key=lambda r: r[1])
    order = sorted(odd_rows, key=lambda r: -1 if r[0] is None else r[0])
    assert [r[0] for r in got] == [r[0] for r in order]
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    assert collections.Counter((r[0], *r[2:]) for r in got) == collections.Counter((r[0], *r[2:]) for r in encoded([r[:2] for r in order]))
    assert op3_tokens.write_and_read(none).count() == 0


def check_encoder(e, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op3_tokens.tokenizer_path())
    found = e.batch(pa.array(texts, pa.string()))
    ids, bounds = found.flat(), found.text_bounds()
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == t.encode(text or "", add_special_tokens=False).ids
        assert found.n_words[i] == len(words(text))


def test_word_encoder_equals_the_tokenizer():
    rng = random.Random(3)
    letters = "aAbB.,'!?sStTé́Σσ  \n\t\x0b\x1c\x1f\x85\xa01２3<|endoftext|>…​日本Éß×÷ÿñÃ"
    tails = ["", "", "<|endoftext|>", " don't,", " I'LL.", " ́x", "***", ".%%%", " ___ a_b 1a2"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(tails) for _ in range(6000)]
    check_encoder(op3_tokens.WordEncoder(op3_tokens.tokenizer_path()), [*texts, None, ""])
    check_encoder(op3_tokens.WordEncoder(op3_tokens.tokenizer_path()), [None, "", "  "])


def test_word_encoder_forgets(monkeypatch):
    monkeypatch.setattr(op3_tokens, "MEMO_WORDS", 10)
    e = op3_tokens.WordEncoder(op3_tokens.tokenizer_path())
    for k in (0, 13, 5):
        check_encoder(e, [f"word{chr(97 + i)} again" for i in range(k, 26)])
    assert len(e.young) + len(e.old) < 40


def test_workers_keep_no_words_between_tasks(spark, texts):
    """CHECK_r04, pipeline: workers that wrote token ids hold no tokenizer and no words when their task is over."""
    assert op3_tokens.segments(frame(spark, list(texts.items()))).count() > 0

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(op3_tokens._ENCODERS)])], ["n"])

    assert spark.range(0, 64, 1, 32).mapInArrow(held, "n long").agg(F.max("n")).first()[0] == 0


def test_token_files_select_ends_and_ids(spark, tmp_path, monkeypatch):
    """Null ids, far ids and more documents than a sample; every offset comes from a select."""
    rows = [(None, "null id"), (None, ""), (-(2**62), "far"), (2**62, "far off"), *[(5 * i, f"text {i}") for i in range(700)]]
    df = frame(spark, rows).coalesce(1)
    op3_tokens.write(df, str(tmp_path / "ids"))
    got = op3_tokens.read(spark, str(tmp_path / "ids")).collect()
    want = encoded(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])))
    same = lambda x: sorted((tuple(r) for r in x if r[0] is not None), key=repr)
    assert same(got) == same(want)
    assert sorted(r["n_tokens"] for r in got if r["doc_id"] is None) == sorted(r[2] for r in want if r[0] is None)
    assert not hasattr(EliasFano, "decode")


# 4 ---------------------------------------------------------------------------------------------------------------------


def test_mixing(spark, sf_dir, same):
    same(op4_mixing.query(spark, sf_dir), op4_mixing.ORACLE)


def test_targets():
    from fractions import Fraction

    got = op4_mixing.targets([10, 100, 0, 40], [3, 1, 2, 3], Fraction(3, 2), 2)
    assert got[0] == 20 and got[2] == 0 and sum(got) == 225 and got[3] == 80


def test_mix_repeats_rows(spark, sf_dir, docs):
    plan = {r["doc_id"]: r["times"] for r in op4_mixing.plan_mix(docs).collect()}
    mixed = op4_mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r["doc_id"] for r in mixed.collect()) == {d: n for d, n in plan.items() if n}


def test_mixing_odd_rows(odd, none, odd_rows):
    rows = op4_mixing.plan_mix(odd).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
    assert op4_mixing.plan_mix(none).count() == 0 == op4_mixing.mix(none).count()
    clash = odd.withColumn("__copy", F.lit("c")).withColumn("plan", F.lit("p")).withColumn("__source", F.lit("s"))
    mixed = op4_mixing.mix(clash)
    assert mixed.columns == clash.columns and {(r["__copy"], r["plan"], r["__source"]) for r in mixed.collect()} == {("c", "p", "s")}
    assert mixed.count() == sum(r["times"] for r in rows)


# 5 ---------------------------------------------------------------------------------------------------------------------


def base_scores(rows):
    train = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 != 1
    count = collections.Counter()
    for d, t in rows:
        if train(d):
            count.update([*words(t, True), None])
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        w = [*words(t, True), None]
        out.append((d, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    return sorted(out, key=repr)


def check_base(got, rows):
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=repr)
    for a, b in zip(got, base_scores(rows), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4])


def plain_log10(m, targets):
    """The attention model place by place, with plain loops; one text."""
    first, end, read = attention.windows(np.array([len(targets)]))
    mark, out = m.row[-1], np.zeros(len(targets))
    w, h = attention.WIDTH, attention.HIDDEN
    row = lambda p: m.table[m.row[targets[p - 1]] if p > 0 else mark].astype(float)
    for f, e, r in zip(first, end, read):
        for i in range(r, attention.WINDOW):
            if f + i >= e:
                break
            q = row(f + i)[:w] + m.place_q[i]
            a = np.array([math.exp(q @ (row(f + j)[w : 2 * w] + m.place_k[j])) for j in range(i + 1)])
            c = sum(x * row(f + j)[2 * w : 3 * w] for j, x in enumerate(a / a.sum()))
            u = np.maximum(c @ m.w1 + m.b1 + row(f + i)[3 * w : 3 * w + h] + row(f + i - 1)[3 * w + h :], 0)
            z, t = u @ m.w2 + m.b2, targets[f + i]
            out[f + i] = (z[m.group[t]] - math.log(np.exp(z).sum())) / math.log(10) + m.within[t]
            k = m.group[t] - attention.SINGLES
            if 0 <= k < len(m.w3):
                y = u @ m.w3[k] + m.b3[k]
                out[f + i] += (y[m.slot[t]] - math.log(np.exp(y).sum())) / math.log(10)
    return out


def test_lm(spark, sf_dir, texts):
    got = op5_lm.query(spark, sf_dir).collect()
    check_base(got, texts.items())
    held = [r for r in got if r["held_out"]]
    assert len(held) == sum(zlib.crc32(str(d).encode()) % 5 == 1 for d in texts)
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.1 and all(r["model_share"] > 0.3 for r in got)


def test_lm_score_by_plain_loops(spark):
    """Mixture, counts and attention of a scorer against loops over tokens."""
    rng = random.Random(9)
    m, _ = tiny_model()
    m.row, m.group, m.slot, m.within = (np.append(np.resize(x[:-1], op5_lm.END + 1), x[-1]) for x in (m.row, m.group, m.slot, m.within))
    own = ["The CAT sat", None, "", " ".join(rng.choice(["the", "cat", "dog's", "x1"]) for _ in range(50))]
    count = {"the": 5, "cat": 2, "sat": 1, "dog's": 0, "x1": 0}
    hashes = op5_lm.lower_hashes(pa.array([w.encode() for w in count]))
    order = np.argsort(hashes)
    s = op5_lm.Scorer(12, 4, 4, m, op3_tokens.tokenizer_path(), 0.3)
    got = s.score(pa.array(own), hashes[order], np.array(list(count.values()))[order])
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op3_tokens.tokenizer_path())
    for i, text in enumerate(own):
        tokens = [(w, t.encode(w, add_special_tokens=False).ids) for w in words(text)] + [(None, [op5_lm.END])]
        logs = list(plain_log10(m, np.array([x for _, ids in tokens for x in ids])))
        base = score = 0
        for w, ids in tokens:
            by_model, logs = sum(logs[: len(ids)]), logs[len(ids) :]
            by_count = math.log10((count.get((w or "").lower(), 4) + 0.5) / (12 + 0.5 * 5))
            base += by_count
            score += math.log10(0.3 * 10**by_model + 0.7 * 10**by_count)
        assert (got[0][i], got[2][i], got[3][i]) == (len(tokens), pytest.approx(base), pytest.approx(score, rel=1e-5))


def test_lm_odd_rows(odd, none, odd_rows):
    got = op5_lm.score(odd).collect()
    check_base(got, [r[:2] for r in odd_rows])
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert op5_lm.score(none).count() == 0


def test_lm_sums_arrays_by_tree(spark):
    rows = [(k, np.array([k, 1.0]).tobytes()) for k in range(300)]
    assert op5_lm.added(spark.createDataFrame(rows, "k long, body binary"), 300).tolist() == [sum(range(300)), 300]


def test_windows_score_each_place_once():
    lengths = np.array([1, 5, 31, 32, 33, 56, 57, 100, 1000])
    first, end, read = attention.windows(lengths)
    seen = np.zeros(lengths.sum(), int)
    for f, e, r in zip(first, end, read):
        seen[min(f + r, e) : min(f + attention.WINDOW, e)] += 1
    assert (seen == 1).all()


def tiny_model(n=60, seen=50):
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, seen, k) for k in (3, 40, 200)]
    counts = np.bincount(np.concatenate(texts), minlength=n).astype(float)
    return attention.start(counts, attention.neighbours(texts, attention.own_ids(counts), counts)), texts


def test_attention_is_causal_and_sums_to_one():
    m, texts = tiny_model()
    t = texts[1]
    whole = attention.log10_probabilities(m, t, np.array([len(t)]))
    assert whole == pytest.approx(plain_log10(m, t), rel=1e-4)
    other = t.copy()
    other[20] = (t[20] + 1) % 50
    changed = attention.log10_probabilities(m, other, np.array([len(t)]))
    assert np.array_equal(whole[:20], changed[:20]) and not np.array_equal(whole[21:], changed[21:])
    total = sum(10 ** float(attention.log10_probabilities(m, np.array([i]), np.array([1]))[0]) for i in range(60))
    assert total == pytest.approx(1, abs=1e-4)


def test_attention_gradients_and_learning():
    m, texts = tiny_model()
    for n in attention.Model.NAMES:
        setattr(m, n, getattr(m, n).astype(np.float64))
    n = 2 * attention.WINDOW
    rows, earlier, goal = (x.reshape(2, -1) for x in (m.row[texts[2][1 : n + 1]], m.row[texts[2][:n]], texts[2][2 : n + 2]))
    loss, g = attention.gradients(m, rows, earlier, goal)
    for n in attention.Model.NAMES:
        w = getattr(m, n)
        at = np.unravel_index(np.abs(g[n]).argmax(), w.shape)
        w[at] += 1e-5
        assert (attention.gradients(m, rows, earlier, goal)[0] - loss) / 1e-5 == pytest.approx(g[n][at], rel=1e-2, abs=1e-5)
        w[at] -= 1e-5
    losses = attention.train(tiny_model()[0], [np.tile(np.arange(10), 30)] * 200, batch=16)
    assert np.mean(losses[-10:]) < 0.2 * losses[0]


# 6, 7 ------------------------------------------------------------------------------------------------------------------


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    p = int(y.sum())
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


@pytest.mark.parametrize(("module", "label", "least", "recall"), [(op6_quality, "quality", 0.99, 0.97), (op7_toxicity, "toxic", 0.95, 0.9)])
def test_classifiers(spark, module, label, least, recall):
    """Held-out labels: how scores rank, and what the thresholds catch and leave alone."""
    path = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in module.query(spark, path).collect()}
    labels = [r for r in spark.read.parquet(f"{path}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    y, s, p = np.array([r[label] for r in labels]), *(np.array([got[r["doc_id"]][c] for r in labels]) for c in ("score", "predicted"))
    assert len(got) == 10000 and auc(s, y) >= least and all(0 <= r["score"] <= 1 for r in got.values())
    assert (p == (s >= module.THRESHOLD)).all() and p[y == 1].mean() >= recall and 1 - p[y == 0].mean() >= 0.97
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) for d, r in got.items())


@pytest.mark.parametrize(("module", "label"), [(op6_quality, "quality"), (op7_toxicity, "toxic")])
def test_classifiers_odd_rows(spark, odd, none, odd_rows, module, label):
    labels = spark.createDataFrame([(7, 1, 1), (7, 1, 1), (12, 0, 0), (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert module.score(odd, module.fit(odd, labels)).count() == len(odd_rows)
    untaught = module.fit(odd, labels.limit(0))
    assert {round(r["score"], 6) for r in module.score(odd, untaught).collect()} == {0.5}
    assert module.score(none, untaught).count() == 0


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    trees = boosting.fit(x[:2000], y[:2000])
    assert ((trees.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.9


def test_machine_learns_a_pair():
    """Exclusive or of two terms, which no sum of weights separates."""
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(3000)]
    y = np.array([float((0 in r) != (1 in r)) for r in rows])
    bias, w, v = op7_toxicity.train(rows, y, 6, epochs=60)
    m = op7_toxicity.Machine(np.arange(6, dtype=np.uint64), bias, w, v)
    doc, term = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    raw = m.raw(doc, term, len(rows))
    assert ((raw > 0) == (y == 1)).mean() > 0.97
    m.factor = v * 0
    assert ((m.raw(doc, term, len(rows)) > 0) == (y == 1)).mean() < 0.8  # three of the four cases
    plain = [bias + sum(w[i] for i in r) + sum(float(v[i] @ v[j]) for i, j in itertools.combinations(r, 2)) for r in rows[:50]]
    assert raw[:50] == pytest.approx(plain)


def test_trees_and_statistics_by_plain_loops():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 4))
    t = boosting.fit(x, (x[:, 0] * x[:, 1] > 0).astype(float), trees=10)

    def walk(row):
        total = t.bias
        for f, b, leaf in zip(t.feature, t.bound, t.leaf):
            i = 0
            while i < len(f):
                i = 2 * i + 1 + int(row[f[i]] > b[i])
            total += leaf[i - len(f)]
        return 1 / (1 + math.exp(-total))

    assert t.probability(x) == pytest.approx([walk(r) for r in x])
    text = "One two, two three.\nFour | four four!\nOne two, two three.\n"
    got = dict(zip(op6_quality.STATISTICS, op6_quality.all_statistics(pa.array([text, None, "a"]))[0]))
    w, lines, n = words(text), text.split("\n")[:-1], len(text)
    want = {
        "log_words": math.log1p(len(w)), "word_bytes": sum(map(len, w)) / len(w), "lower": sum(c.islower() for c in text) / n, "upper": sum(c.isupper() for c in text) / n,
        "space": text.count(" ") / n, "newline": 3 / n, "bang": 1 / n, "pipe": 1 / n, "distinct_words": len(set(w)) / len(w), "top_word": max(collections.Counter(w).values()) / len(w),
        "distinct_pairs": len(set(zip(w, w[1:]))) / (len(w) - 1), "same_as_last": sum(a == b for a, b in zip(w, w[1:])) / len(w), "lines": math.log1p(len(lines)),
        "distinct_lines": len(set(lines)) / len(lines), "line_words": len(w) / len(lines), "bare_words": 1 / len(w), "longest_word": math.log1p(6), "log_bytes": math.log1p(n),
    }
    assert {k: got[k] for k in want} == pytest.approx(want)


def test_reject_keeps_columns(spark, odd):
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int").limit(0)
    kept = op7_toxicity.reject(odd, op7_toxicity.fit(odd, labels))
    assert kept.columns == odd.columns


# 8 ---------------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, sf_dir, texts):
    got = {r["doc_id"]: r for r in op8_fingerprints.query(spark, sf_dir).collect()}
    order = sorted(texts)
    for d, nxt in zip(order, [*order[1:], order[0]]):
        a, b = texts[d], texts[nxt]
        half = len(a) // 2
        want = a[: len(a) - half] + b[:half]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(a), hashlib.sha256(want.encode()).hexdigest())
        assert 0 <= got[d]["near_edited"] <= 1 and len(got[d]["fingerprint"]) == 8 * 64
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.05 > np.mean([r["near_next"] for r in got.values()])


def test_fingerprints_by_brute_force(spark):
    """Signatures from their definition, with loops; only the hash function is Spark's."""
    rng = random.Random(4)
    own = ["", "one two", passage(rng, 5), passage(rng, 9), "the cat " * 30, passage(rng, 40, 12), passage(rng, 300), passage(rng, 700, 30)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(own)], "i int, t string")
    got = {r[0]: r[1] for r in df.select("i", op8_fingerprints.signature(F.col("t"))).collect()}
    hashed = lambda *x: spark.range(1).select(F.xxhash64(*[F.lit(v).cast("bigint") if isinstance(v, int) else F.lit(v) for v in x])).first()[0]
    pairs_of = {}
    for i, t in enumerate(own):
        w = words(t)
        if not w:
            assert got[i] == [0] * 64
            continue
        rows = spark.createDataFrame([(k, w[k : k + 5]) for k in range(max(1, len(w) - 4))], "k int, w array<string>")
        whole = len(w) < 5
        key = F.xxhash64("w") if whole else F.xxhash64(*[F.xxhash64(F.get("w", F.lit(j))) for j in range(5)])
        grams = sorted((r[1], r[0]) for r in rows.select("k", key).collect())
        seen, numbered = collections.Counter(), []
        again = [(h, seen[h], seen.update([h])) for h, _ in grams]
        later = [(h, n) for h, n, _ in again if n]
        table = {}
        if later:
            df2 = spark.createDataFrame(later, "h long, n int")
            table = {(r[0], r[1]): r[2] for r in df2.select("h", "n", F.xxhash64("h", "n")).collect()}
        numbered = sorted((table.get((h, n), h), p) for (h, p), (_, n, _) in zip(grams, again))
        chosen = []
        for point in range(64):
            start = next((j for j, (h, _) in enumerate(numbered) if (h >> 58) + 32 >= point), 0)
            x, y = numbered[start], numbered[(start + 1) % len(numbered)]
            chosen.append((x[0],) if len(numbered) == 1 else (x[0], y[0]) if x[1] < y[1] else (y[0], x[0]))
        for c in set(chosen):
            pairs_of.setdefault(c, hashed(*c))
        assert got[i] == [pairs_of[c] >> 32 for c in chosen], i


def likeness(spark, a, b):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    return df.select(op8_fingerprints.likeness(op8_fingerprints.signature(F.col("a")), op8_fingerprints.signature(F.col("b")))).first()[0]


def test_fingerprints_follow_order_and_edits(spark):
    rng = random.Random(2)
    a = passage(rng, 400).split()
    one = [*a[:200], "changed", *a[201:]]
    assert likeness(spark, " ".join(a), " ".join(a)) == 1
    assert likeness(spark, " ".join(a), " ".join(one)) > 0.85
    swapped = " ".join(a[200:] + a[:200])  # the same k-mers but for four, half of all pairs in another order
    assert likeness(spark, " ".join(a), swapped) < 0.75 < likeness(spark, " ".join(a), " ".join(one))
    assert likeness(spark, "the " * 100, "the " * 300) < 1
    assert likeness(spark, "", None) == 1 and likeness(spark, "", "one") == 0 and likeness(spark, "one two", "one two") == 1


def test_fingerprints_odd_rows(odd, none, odd_rows):
    rows = op8_fingerprints.with_next(odd).collect()
    assert len(rows) == len(odd_rows) and all(r["next_text"] is not None for r in rows)
    assert op8_fingerprints.with_next(none).count() == 0
    one = odd.where("doc_id = 4")
    assert op8_fingerprints.with_next(one).first()["next_text"] == "one"


# 9 ---------------------------------------------------------------------------------------------------------------------


def shingles(text):
    w = [x.encode().lower() for x in words(text)]
    return frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()


def linked(rows):
    sets = {}
    for d, t in rows:
        if d is not None:
            sets[d] = max(sets.get(d, frozenset()), shingles(t), key=len)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            both = len(x & y)
            if both and 100 * both >= 85 * (len(x) + len(y) - both):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


def test_jaccard(spark, sf_dir, texts):
    want = linked(texts.items())
    for r in op9_jaccard.query(spark, sf_dir).collect():
        assert (r["n_shingles"], r["component_id"]) == (len(shingles(texts[r["doc_id"]])), want[r["doc_id"]])


@pytest.mark.parametrize(("long_list", "most"), [(op9_jaccard.LONG_LIST, op9_jaccard.BROADCAST_KEYS), (2, 10)])
def test_jaccard_near_the_limit(spark, monkeypatch, long_list, most):
    """Chains of edits, small sets that contain each other, groups with every likeness about the limit; long lists too."""
    monkeypatch.setattr(op9_jaccard, "LONG_LIST", long_list)
    monkeypatch.setattr(op9_jaccard, "BROADCAST_KEYS", most)
    rng = random.Random(11)
    rows = []
    for group in range(6):
        base = passage(rng, rng.choice([8, 10, 13, 16, 18, 40, 120])).split()
        for _ in range(25):
            if rng.random() < 0.5:
                base = list(base)
            own = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = [f"z{rng.randrange(10**6)}"] if rng.random() < 0.8 else []
            if rng.random() < 0.3:
                base = own
            rows.append((len(rows), " ".join(own)))
    want = linked(rows)
    got = {r["doc_id"]: r["component_id"] for r in op9_jaccard.join(frame(spark, rows)).collect()}
    assert got == want and 1 < len(set(want.values())) < len(rows)


def test_jaccard_odd_rows(odd, none, odd_rows):
    want = linked([r[:2] for r in odd_rows])
    for r in op9_jaccard.join(odd).collect():
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
    assert op9_jaccard.join(none).count() == 0 == op9_jaccard.keep_one(none).count()
    kept = op9_jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {None} | {d for d, c in want.items() if d == c}


def test_components_of_a_chain(spark):
    n = 60
    order = random.Random(4).sample(range(n), n)
    pairs = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(100, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.components(pairs).collect()}
    assert set(got.values()) == {0, 100} and len(got) == n + 2


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(0)
    a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    b = np.unique(np.concatenate([a[30:], rng.integers(0, 2**63, 20, dtype=np.uint64)]))
    s = op9_jaccard.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])).view(np.uint8)
    assert int(np.unpackbits(s[0] ^ s[1]).sum()) <= len(set(a) ^ set(b))


# 10 --------------------------------------------------------------------------------------------------------------------


def cut_words(t):
    return [w for w in re.split(r"[\x20\x09-\x0D!-/:-@\[-`{-~]+", (t or "").lower()) if w]


def agreements(rows, items):
    """(doc, item, most equal words in a window, first shift) of all pairs that leak: every diagonal, no seeds."""
    out = set()
    for i, t in items:
        w = cut_words(t)
        m, width = len(w), min(13, len(w))
        least = m if m < 8 else min(10, math.ceil(m * 10 / 13))
        for d, text in rows:
            g = cut_words(text)
            found = []
            for shift in range(1 - m, len(g)) if m and (m >= 4 or m == len(g)) else ():
                same = [0 <= k + shift < len(g) and g[k + shift] == w[k] for k in range(m)]
                agree = max(sum(same[a : a + width]) for a in range(m - width + 1)) if sum(same) >= least else 0
                if agree >= least:
                    found.append((agree, shift))
            if found:
                out.add((d, i, max(a for a, _ in found), min(s for _, s in found)))
    return out


def test_decontamination(spark, sf_dir, same):
    same(op10_decontam.query(spark, sf_dir), op10_decontam.ORACLE)
    assert op10_decontam.query(spark, sf_dir).count()


def test_decontamination_by_brute_force(spark):
    """Items of 1 to 30 words, whole and with words changed, dropped and moved, against all diagonals."""
    rng = random.Random(12)
    items = [(m, passage(rng, m, 60)) for m in [*range(1, 16), 20, 30]]
    rows = []
    for m, t in items:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(5)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([["changed"], [], [w[k], "more"]]) or w[k : k + 1] if len(w) > 1 else ["changed"]
            rows.append((len(rows), " ".join([passage(rng, rng.randrange(6), 60), *w, passage(rng, rng.randrange(6), 60)])))
        rows.append((len(rows), t))
    got = {tuple(r) for r in op10_decontam.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == agreements(rows, items) and {i for _, i, _, _ in got} == {m for m, _ in items}


def test_decontamination_finds_substitutions(spark):
    rng = random.Random(6)
    items = [(i, passage(rng, 25)) for i in range(20)]
    rows = []
    for i, t in items:
        w = t.split()
        for k in range(0, 25, 9):
            w[k] = "changed"
        rows.append((i, f"{passage(rng, 30)} {' '.join(w)} {passage(rng, 30)}"))
    rows += [(100 + i, passage(rng, 200)) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in op10_decontam.leaks(frame(spark, rows), bench).collect()}
    assert got == {(i, i) for i in range(20)}


def test_decontamination_finds_every_allowed_pattern(spark):
    """All ways to change as many words as the rule lets differ, in items of 8 to 13 words: brute force by construction."""
    rng = random.Random(8)
    items, rows = [], []
    for m in range(8, 14):
        items.append((m, passage(rng, m, 10**6)))
        for gone in itertools.combinations(range(m), m - math.ceil(m * 10 / 13)):
            w = items[-1][1].split()
            for k in gone:
                w[k] = "changed"
            rows.append((m * 1000 + len(rows), f"{passage(rng, 5, 10**6)} {' '.join(w)} {passage(rng, 5, 10**6)}"))
        one_more = items[-1][1].split()
        one_more[: m - math.ceil(m * 10 / 13) + 1] = ["changed"] * (m - math.ceil(m * 10 / 13) + 1)
        rows.append((-m, " ".join(one_more)))
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), frame(spark, rows)
    want = {(d, d // 1000) for d, _ in rows if d > 0}
    assert {(r["doc_id"], r["item_id"]) for r in op10_decontam.leaks(docs, bench).collect()} == want
    assert {r["doc_id"] for r in op10_decontam.decontaminate(docs, bench).collect()} == {-m for m in range(8, 14)}


def test_decontamination_beyond_the_broadcast(spark, monkeypatch):
    rng = random.Random(7)
    items = [(i, passage(rng, 20)) for i in range(12)]
    df, bench = frame(spark, [(i, t) for i, t in items]), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(op10_decontam, "BLOCK_SEEDS", 100)  # beyond it seeds are shuffled
    assert {(r["doc_id"], r["item_id"]) for r in op10_decontam.leaks(df, bench).collect()} == {(i, i) for i in range(12)}


def test_decontamination_odd_rows(spark, odd, none, odd_rows):
    base = next(r[1] for r in odd_rows if r[0] == 7)
    bench = spark.createDataFrame([(1, base), (1, base), (2, None), (3, ""), (4, "one"), (None, "the " * 20)], "item_id long, text string")
    got = {r["doc_id"] for r in op10_decontam.leaks(odd, bench).collect()}
    assert got == {None, 4, 7, 8, 9, 13, 15, 12}  # 4 is just the item "one"; 5 only holds it
    kept = op10_decontam.decontaminate(odd, bench)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 5, 10, 11, 14}
    assert op10_decontam.leaks(none, bench).count() == 0 == op10_decontam.leaks(odd, bench.limit(0)).count()


def test_lm_is_fitted_on_every_training_text(spark):
    """no sample; the texts that set the share are fitted on after it, so each training text is in one round."""
    texts = [f"word{i % 7} text {i} end" for i in range(2600)]
    rows = spark.createDataFrame([(i, t, i % 64, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk int, train boolean")
    n_train, counts = sum(i % 5 != 1 for i in range(2600)), np.zeros(op5_lm.SUBWORDS, np.int64)
    path = op3_tokens.tokenizer_path()
    for t in (x.ids for x in __import__("tokenizers").Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)):
        np.add.at(counts, t, 1)
    fit = op5_lm.Fit(rows, sum(map(len, texts)), n_train, counts, path)
    last = F.col("part") >= fit.groups * op5_lm.ROUNDS
    kept = sum(i % 64 % op5_lm.TUNE_EVERY == op5_lm.TUNE and i % 5 != 1 for i in range(2600))
    assert fit.texts.count() == n_train and fit.texts.where(last).count() == kept > 0
    before = fit.model.weights()
    fit.kept()
    assert not np.array_equal(before, fit.model.weights())


def test_gradients_do_not_depend_on_blocks(monkeypatch):
    """what is worked on at once is for the cache alone; classes longer and shorter than a block, places without a loss."""
    m, _ = tiny_model()
    rng = np.random.default_rng(4)
    ids = np.concatenate([np.full(100, 30), rng.integers(0, 60, 19 * attention.WINDOW - 99)])
    rows, goal = (m.row[ids[:-1]].reshape(19, -1), ids[1:].reshape(19, -1).copy())
    earlier = np.concatenate([m.row[-1:], m.row[ids[:-2]]]).reshape(19, -1)
    goal[3, 5:] = goal[18, 1:] = -1
    found = []
    for windows, places in ((100, 10_000), (32, 1024), (2, 7)):
        monkeypatch.setattr(attention, "AT_ONCE", windows)
        monkeypatch.setattr(attention, "ROWS_AT_ONCE", places)
        found.append(attention.gradients(m, rows, earlier, goal))
    for loss, g in found[1:]:
        assert loss == pytest.approx(found[0][0], rel=1e-5)
        for n in attention.Model.NAMES:
            assert np.allclose(g[n], found[0][1][n], rtol=1e-3, atol=1e-6)


def test_rows_add_up_and_far_scores_stay_finite():
    rng = np.random.default_rng(6)
    rows, d = np.concatenate([np.full(50, 3), np.full(9, 4), rng.integers(5, 40, 60)]), rng.normal(size=(119, 5))
    out, plain = np.ones((50, 5)), np.ones((50, 5))
    attention._add_rows(out, rows, d)
    np.add.at(plain, rows, d)
    assert np.allclose(out, plain)
    for far in (-300, 300):
        z = np.full((2, 4), far, np.float32)
        assert attention._softmax(z, np.array([0, 3]), 1.0) == pytest.approx(2 * math.log(4), rel=1e-5)
        assert np.allclose(z[0], [-0.75, 0.25, 0.25, 0.25])


def test_pairs_by_plain_loops():
    texts = [np.array(t, np.int64) for t in ([5, 2, 2, 9], [7], [2, 5, 1])]
    own, plain = np.array([2, 5]), np.zeros((3, 3), int)
    place = {2: 0, 5: 1}
    for t in texts:
        for a, b in zip(t[:-1].tolist(), t[1:].tolist()):
            plain[place.get(a, 2), place.get(b, 2)] += 1
    assert attention.pairs(np.concatenate(texts), np.array([4, 1, 3]), own, 10).tolist() == plain.tolist()


def test_lm_counts_ids_where_the_texts_lie(spark):
    """ids are counted over the tokenized training texts; no text is tokenized again for it."""
    texts = [None if i == 3 else f"word{i % 7} text {i} end" for i in range(40)]
    rows = spark.createDataFrame([(i, t, i % 64, i % 5 != 1) for i, t in enumerate(texts)], "doc_id long, text string, chunk int, train boolean")
    path, n_train, plain = op3_tokens.tokenizer_path(), sum(i % 5 != 1 for i in range(40)), np.zeros(op5_lm.SUBWORDS, np.int64)
    learnt = [t for i, t in enumerate(texts) if t and i % 5 != 1]
    for x in __import__("tokenizers").Tokenizer.from_file(path).encode_batch(learnt, add_special_tokens=False):
        np.add.at(plain, x.ids, 1)
    fit = op5_lm.Fit(rows, 1000, n_train, None, path)
    assert fit.summed(plain * 0, lambda ids, lengths: np.bincount(ids, minlength=op5_lm.SUBWORDS)).tolist() == plain.tolist()
    own = attention.own_ids(np.append(plain, n_train).astype(float))
    assert fit.model.row[own].tolist() == list(range(len(own)))
    assert fit.summed(np.zeros(2), lambda ids, lengths: np.array([len(lengths), len(ids)])).tolist() == [n_train, plain.sum()]
