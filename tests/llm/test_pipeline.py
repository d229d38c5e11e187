import random

import corpus_pipeline
from gridloom.llm import op3_tokens, op4_mixing, op7_toxicity, op9_jaccard, op10_decontam
from tests.llm.conftest import frame, passage


def test_stages(spark, tmp_path):
    """Every stage takes effect on what its predecessor kept and keeps the columns; run() gives the last one's rows."""
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, labels, bench = docs.columns, spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    seen = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf_dir).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    assert all(d.columns == columns for d in seen[:-1])
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").collect()) for d in seen]

    scores = op7_toxicity.score(docs, op7_toxicity.fit(docs, labels)).collect()
    assert ids[1] == sorted(r["doc_id"] for r in scores if r["score"] < 0.5) != ids[0]
    classes = op9_jaccard.join(seen[1], 5, 80).collect()
    assert ids[2] == sorted(r["doc_id"] for r in classes if r["component_id"] == r["doc_id"]) != ids[1]
    leaked = {r["doc_id"] for r in op10_decontam.leaks(seen[2], bench).collect()}
    assert ids[3] == [i for i in ids[2] if i not in leaked] != ids[2]
    times = {r["doc_id"]: r["times"] for r in op4_mixing.plan_mix(seen[3]).collect()}
    assert ids[4] == sorted(i for i, n in times.items() for _ in range(n))
    want = sorted(map(tuple, op3_tokens.write_and_read(seen[4]).collect()))
    assert sorted(map(tuple, seen[5].collect())) == want == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0


def near_pairs(texts, k, percent):
    """Pairs of ids, the larger first, whose k-word shingle sets have at least percent / 100 in common."""
    cut = {d: t.split() for d, t in texts}
    sets = {d: {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} for d, w in cut.items()}
    return {(a, b) for a in sets for b in sets if a > b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])}


def test_near_duplicates_by_five_words_and_four_fifths(spark, sf_dir):
    """Texts of 8 words up, each beside one copy with up to six words replaced: every likeness about the limit."""
    rng = random.Random(3)
    rows = []
    for n in [8, 8, 9, 9, 10, 12, 14, 16, 20, 24, 28, 34, 40, 60, 80, 100, 100, 150]:
        for changed in range(7):
            base = passage(rng, n, 10**6).split()
            at = rng.choice([0, n - changed, rng.randrange(n - changed + 1)])
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[:at] + [f"z{i}" for i in range(changed)] + base[at + changed :]))]
    words = passage(rng, 100, 10**6).split()
    rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words[:40] + ["new"] * 6 + words[46:]))]
    found = near_pairs(rows, 5, 80)
    assert found - near_pairs(rows, 4, 85)
    kept = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), sf_dir).collect()}
    assert kept == {d for d, _ in rows} - {a for a, _ in found}


def test_chain_on_odd_rows(spark, sf_dir, odd, none, tmp_path):
    """All stages one after another, each on what the one before wrote: nulls, copies, long texts, clashing names; an empty table."""
    for name, start in (("odd", odd), ("none", none)):
        df = start
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, df, sf_dir).write.parquet(f"{tmp_path}/{name}-{k}")
            after = spark.read.parquet(f"{tmp_path}/{name}-{k}")
            if k < len(corpus_pipeline.STAGES) - 1:
                assert after.columns == start.columns
                assert {(r["doc_id"], r["text"]) for r in after.collect()} <= {(r["doc_id"], r["text"]) for r in df.collect()}
            df = after
        kept = spark.read.parquet(f"{tmp_path}/{name}-{len(corpus_pipeline.STAGES) - 2}")
        assert df.count() == kept.count() and sorted(r["doc_id"] or 0 for r in df.collect()) == sorted(r["doc_id"] or 0 for r in kept.collect())
        if name == "odd":
            texts = [r["text"] for r in spark.read.parquet(f"{tmp_path}/odd-1").where("doc_id IS NOT NULL").collect() if r["text"] and len(r["text"].split()) > 20]
            assert len(texts) == len(set(texts)) > 3
        else:
            assert df.count() == 0
