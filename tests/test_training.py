"""Batch training, the shared search and the silhouette of several labellings, against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import quantiles
from gridloom.functions.sampling import seeded_hash
from gridloom.operators import clusters, encode, lattice, metrics, profile, som, tune
from gridloom.plans import pipeline
from gridloom.sources import writers


def vectors(spark, n=60, d=4, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "_row_id long, features array<double>")


def one_epoch(x, w, sigma):
    flat, y = w.reshape(-1, w.shape[2]), w.shape[1]
    k = ((x[:, None] - flat[None]) ** 2).sum(axis=2).argmin(axis=1)
    out = flat.copy()
    for u in range(len(flat)):
        h = np.array([math.exp(-((u // y - c // y) ** 2 + (u % y - c % y) ** 2) / (2 * sigma**2)) for c in k])
        out[u] = (h[:, None] * x).sum(axis=0) / h.sum()
    return out.reshape(w.shape)


def test_batch_training(spark, tmp_path):
    x, df = vectors(spark, 200)
    w = som.initial_weights(3, 4, 4)
    for e in range(6):
        w = one_epoch(x, w, max(1.5 * som.SHRINK**e, som.LEAST_SIGMA))
    whole = som.train(df.repartition(7), 3, 4, 1.5, 0.5, 1, method="batch", epochs=6)
    assert np.allclose(whole.weights, w, atol=1e-6)
    path = str(tmp_path / "epochs")
    som.train(df, 3, 4, 1.5, 0.5, 1, method="batch", epochs=2, path=path)
    (tmp_path / "epochs/epoch-00002").mkdir()  # an epoch that was not written whole
    again = som.train(df, 3, 4, 1.5, 0.5, 1, method="batch", epochs=6, path=path)
    assert np.allclose(again.weights, whole.weights, atol=1e-6) and again.params["epoch"] == 5
    with pytest.raises(ValueError, match="other parameters"):
        som.train(df, 3, 4, 1.0, 0.5, 1, method="batch", epochs=6, path=path)
    with pytest.raises(ValueError):
        som.train(df.limit(0), 3, 4, 1.5, 0.5, 1, method="batch")


def test_batch_training_stops_where_nothing_moves(spark):
    x = np.repeat(np.eye(4), 10, axis=0)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_row_id long, features array<double>")
    model = som.train(df, 2, 2, 0.6, 0.5, 1, method="batch", epochs=100)
    assert model.params["epoch"] < 50 and model.params["moved"] < 1e-4
    got = som.batch_sums(df, model).collect()
    assert sum(r["n"] for r in got) == 40 and all(len(r["total"]) == 4 for r in got) and len(got) <= 4


def test_decay_and_samples_per_step(spark):
    x, df = vectors(spark, 30)
    order = [r["_row_id"] for s in (42, 43, 44) for r in df.orderBy(seeded_hash(F.col("_row_id"), s), "_row_id").collect()]
    assert np.allclose(som.schedule(df, 80), x[order[:80]]) and np.allclose(som.schedule(df, 20), x[order[:20]])
    w = som.initial_weights(2, 3, 4)
    for t in range(40):
        for i in order[2 * t : 2 * t + 2]:
            som.step(w, x[i], 0.5 / (1 + t / 20), 1.0 / (1 + t / 20))
    got = som.train(df, 2, 3, 1.0, 0.5, 40, decay="asymptotic", samples_per_step=2)
    assert np.allclose(got.weights, w, atol=1e-6)
    assert som.decayed(2.0, 5, 10, "linear") == 1.0 and som.decayed(2.0, 5, 10) == 2.0
    assert not np.allclose(som.train(df, 2, 3, 1.0, 0.5, 40).weights, got.weights)


def slow_silhouettes(x, c):
    keep = c != 0
    x, c = x[keep], c[keep]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i in range(len(x)):
        own, others = (c == c[i]).sum(), [d[i, c == k].mean() for k in set(c.tolist()) - {c[i]}]
        if own == 1 or not others:
            out.append(0.0)
        else:
            a, b = d[i, c == c[i]].sum() / (own - 1), min(others)
            out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def test_silhouettes_over_pairs_of_blocks(spark, monkeypatch):
    """Many blocks, several labellings at once: noise, a cluster of one row, one cluster alone, repeated vectors, no label at all."""
    monkeypatch.setattr(metrics, "BLOCK_BYTES", 1)  # the least block
    monkeypatch.setattr(metrics, "TILE_ROWS", 100)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 5))
    x[100:140] = x[100]
    labels = np.stack([rng.integers(0, 4, 900), np.where(np.arange(900) == 7, 9, rng.integers(1, 3, 900)), np.full(900, 5), np.zeros(900, int)], axis=1)
    df = spark.createDataFrame([(i, v.tolist(), c.tolist()) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "_row_id long, features array<double>, cluster array<int>")
    got = metrics.silhouette(df).first()[0]
    assert np.allclose(got[:3], [slow_silhouettes(x, labels[:, m]).mean() for m in range(3)], atol=1e-7) and got[3] is None
    one = df.withColumn("cluster", F.get("cluster", F.lit(0)))
    rows = sorted((r["_row_id"], r["cluster"], r["s"]) for r in metrics.silhouette_rows(one).collect())
    assert [r[0] for r in rows] == np.nonzero(labels[:, 0])[0].tolist() and np.allclose([r[2] for r in rows], slow_silhouettes(x, labels[:, 0]), atol=1e-7)
    assert metrics.silhouette_rows(one, 50).count() == 50
    assert metrics.silhouette(one.where("cluster = 0")).first()[0] is None and metrics.silhouette(df.limit(0)).first()[0] is None


def test_silhouette_work_follows_different_vectors(spark, monkeypatch):
    """copies stand in one block as one vector with a count, and pairs of blocks meet without a shuffle of vectors."""
    monkeypatch.setattr(metrics, "BLOCK_BYTES", 1)  # the least block
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(600, 4)), 2, axis=0)
    labels = np.repeat(rng.integers(0, 4, 600), 2)
    labels[::30] = 1  # some copies have labels of their own
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels, strict=True))], "_row_id long, features array<double>, cluster int")
    assert np.isclose(metrics.silhouette(df).first()[0], slow_silhouettes(x, labels).mean(), atol=1e-7)
    different = len({(*v, c) for v, c in zip(x.tolist(), labels.tolist(), strict=True) if c})
    points = metrics._points(metrics._labellings(df), 4, 3, different)
    assert points.agg(F.sum("size")).first()[0] == different < (labels != 0).sum() and points.count() > 1
    plan = metrics._distance_sums(spark.createDataFrame(points.toArrow()), 4, [{1: 0, 2: 1, 3: 2}])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not any(x in plan for x in ("Repartition", "Aggregate", "Generate", "FlatMap"))


def test_scan_equals_one_by_one(spark):
    """Errors, labels and silhouettes of several maps by the shared passes are those of each map's own tables."""
    _, df = vectors(spark, 150)
    asked = [{"som_x": x, "som_y": y, "sigma": s, "learning_rate": 0.4, "iterations": 120} for x, y, s in ((2, 3, 0.7), (4, 4, 1.0), (1, 1, 1.0), (5, 2, 0.8))]
    for c, got in zip(asked, tune.scan(df, asked), strict=True):
        model = som.train(df, **c)
        x, y = model.shape
        units = som.bmu(df, model)
        labels = clusters.assign(units, lattice.label_lattice(lattice.activation_map(units, x, y), y, 0.7), y)
        several = labels.where("cluster <> 0").select("cluster").distinct().count() > 1
        s = metrics.silhouette(df.join(labels, "_row_id")).first()[0] if several else 0.0
        assert np.allclose([got["q_error"], got["t_error"], got["silhouette"]], [model.quantization_error, model.topographic_error, s])


def test_jobs_do_not_grow_with_the_budget(spark):
    _, df = vectors(spark)
    df = df.persist()
    df.count()
    jobs = []
    for n in (2, 8):
        params = {"som_x": [3], "som_y": [3, 4], "sigma": [0.8, 0.9, 1.0, 1.1], "learning_rate": [0.3], "iterations": [50]}
        spark.sparkContext.setJobGroup(f"search-{n}", "")
        assert len(tune.search(df, params, n)[1]) == n
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"search-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
    assert df.storageLevel.useMemory  # the caller's cache is still there
    df.unpersist()
    tune.search(df, {"som_x": [2], "som_y": [2], "sigma": [0.8], "learning_rate": [0.3], "iterations": [20]}, 1)
    assert not df.storageLevel.useMemory


def test_search_goes_on_after_its_history(spark, tmp_path, monkeypatch):
    _, df = vectors(spark)
    params = {"som_x": [2], "som_y": [2, 3], "sigma": [0.8, 1.0], "learning_rate": [0.3], "iterations": [30]}
    whole = tune.search(df, params, 4)
    path, asked, scan = str(tmp_path / "history"), [], tune.scan
    tune.search(df, params, 1, history_path=path)
    monkeypatch.setattr(tune, "scan", lambda df, combinations, *a: asked.extend(combinations) or scan(df, combinations, *a))
    assert tune.search(df, params, 4, history_path=path) == whole and len(asked) == 3
    assert tune.search(df, params, 4, history_path=path) == whole and len(asked) == 3


def test_a_training_without_memory_falls_back_within_the_search(spark, monkeypatch):
    _, df = vectors(spark)
    good = {"som_x": 2, "som_y": 2, "sigma": 0.8, "learning_rate": 0.3, "iterations": 20}
    small = som.train(df, **good)
    assert isinstance(tune.scan(df, [good, good | {"sigma": "wide"}])[1], RuntimeError)
    monkeypatch.setattr(som, "train_fallback", lambda df, seed: small)
    monkeypatch.setattr(som, "out_of_memory", lambda e: "TypeError" in str(e))
    first, second = tune.scan(df, [good, good | {"sigma": "wide"}])
    assert first == second


def test_medians_of_many_columns(spark):
    """Against numpy: even and odd counts, nulls, infinities, both zeros, huge and tiny values, one value, none."""
    rng = np.random.default_rng(5)
    n = 2001
    columns = {
        "normal": rng.normal(size=n), "scales": 10.0 ** rng.uniform(-300, 300, n) * rng.choice([-1, 1], n), "few": rng.integers(0, 3, n).astype(float), "constant": np.full(n, 7.5),
        "ids": np.arange(n) + 1e15, "ends": np.where(np.arange(n) % 2, np.inf, -np.inf), "zeros": np.where(np.arange(n) % 2, 0.0, -0.0), "close": 1 + np.arange(n) * 2.0**-52,
    }
    rows = [tuple(None if name != "normal" and (i + k) % 7 == 0 else float(v[i]) for k, (name, v) in enumerate(columns.items())) + (None, i) for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns) + ", none double, whole int").repartition(5)
    got = quantiles.medians(df, [*columns, "none", "whole"])
    for k, (name, v) in enumerate(columns.items()):
        kept = sorted(v[i] for i in range(n) if name == "normal" or (i + k) % 7)
        lo, hi = kept[(len(kept) - 1) // 2], kept[len(kept) // 2]
        assert got[name] == 0.5 * lo + 0.5 * hi, name
    assert got["none"] is None and got["whole"] == 1000.0 and quantiles.medians(df.limit(0), ["normal"]) == {"normal": None}
    u = quantiles.to_ordered(np.array([-np.inf, -1.0, -1e-320, 0.0, -0.0, 1e-320, 1.0, np.inf, np.nan]))
    assert u[3] == u[4] and (np.diff(u[[0, 1, 2, 3, 5, 6, 7, 8]].astype(object)) > 0).all() and [quantiles.from_ordered(int(x)) for x in u[[0, 1, 3, 6]]] == [-np.inf, -1.0, 0.0, 1.0]


def mixed(spark, n=300):
    rows = [(i, None if i % 11 == 0 else float(i % 5), float(i * i % 97), None if i % 7 == 0 else f"v{i % 23:02d}", "AB"[i % 2], "same") for i in range(n)]
    return spark.createDataFrame(rows, "_row_id long, a double, b double, c string, d string, e string")


def test_sparse_rows_equal_dense_ones(spark):
    df = mixed(spark)
    e = encode.fit(df)
    full, thin = encode.transform(df, e), encode.transform_sparse(df, e)
    want = {r["_row_id"]: r["features"] for r in full.collect()}
    assert {r["_row_id"]: r["features"] for r in encode.dense(thin, len(e.names)).collect()} == want
    for r in thin.collect():
        f = r["features"]
        assert f["size"] == len(e.names) and list(f["at"]) == sorted(f["at"]) and 0.0 not in f["value"] and len(f["at"]) <= 5
    model = som.train(full, 3, 3, 1.0, 0.5, 60)
    assert np.array_equal(som.train(thin, 3, 3, 1.0, 0.5, 60).weights, model.weights)
    close = lambda a, b: [(r["_row_id"], r["k1"], r["k2"]) for r in a] == [(r["_row_id"], r["k1"], r["k2"]) for r in b] and np.allclose([r["d1"] for r in a], [r["d1"] for r in b], atol=1e-9)
    assert close(som.bmu(full, model).orderBy("_row_id").collect(), som.bmu(thin, model).orderBy("_row_id").collect())
    assert np.allclose(som.next_weights(thin, model, 1.0), som.next_weights(full, model, 1.0))
    got = [tune.scan(x, [{"som_x": 3, "som_y": 3, "sigma": 1.0, "learning_rate": 0.5, "iterations": 60}])[0] for x in (full, thin)]
    assert np.allclose(list(got[0].values()), list(got[1].values()))
    nothing = df.select("_row_id")
    assert encode.transform_sparse(nothing, encode.fit(nothing)).first()["features"]["at"] == []


def test_labels_without_a_join(spark):
    """Units, labels and pruning by look-up equal those by joins, and no row is exchanged."""
    _, df = vectors(spark, 300)
    raw = df.withColumn("note", F.concat(F.lit("n"), "_row_id"))
    model = som.train(df, 3, 4, 0.8, 0.5, 200)
    units = som.bmu(df, model)
    hits = lattice.activation_map(units, 3, 4)
    cells = lattice.label_lattice(hits, 4, 0.3)
    for limit in (1, 2, 15):
        want, _ = clusters.analyze(units, cells, raw.drop("features"), 4, limit, 0.05, config.LEGACY)
        of_unit = clusters.unit_labels(hits, cells, 4, limit, 0.05, config.LEGACY)
        got = clusters.label_rows(raw, model, of_unit)
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
        assert sorted((r["note"], r["cluster"]) for r in got.collect()) == sorted((r["note"], r[clusters.LABEL]) for r in want.collect())
        assert sorted((r["_row_id"], r["k1"], r["k2"]) for r in got.collect()) == sorted((r["_row_id"], r["k1"], r["k2"]) for r in units.collect())


def test_the_analysis_with_sparse_rows(spark):
    df = mixed(spark).withColumnsRenamed({"a": "IDADE_PESSOA", "c": "CIDADE", "d": "UF"})
    got = [pipeline.cluster_rows(df, config.LEGACY, map_size=3, iterations=80, sparse=s) for s in (False, True)]
    rows = [sorted((r["_row_id"], r["b"], r[clusters.LABEL]) for r in g["rows"].collect()) for g in got]
    assert rows[0] == rows[1] and len(rows[0]) == 300
    assert "Exchange" not in got[0]["rows"]._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")
    assert got[0]["metrics"].keys() == got[1]["metrics"].keys() and np.allclose(list(got[0]["metrics"].values()), list(got[1]["metrics"].values()), atol=1e-6)
    for g in got:
        assert {(r["_row_id"], r["cluster"]) for r in g["labels"].collect()} == {(i, c) for i, _, c in rows[0]}
        pipeline.release(g)


def test_dominant_values_of_a_column_of_free_text(spark):
    """Ties go to the smaller value, nulls count in the size alone, a column of as many values as rows has none."""
    rows = [(1, f"text {i}", "b" if i % 2 else "a", "x" if i < 20 else None) for i in range(60)] + [(0, "n", "n", "n"), (2, "only", None, None)]
    df = spark.createDataFrame(rows, "cluster int, free string, even string, some string")
    got = {(r["cluster"], r["column"]): (r["value"], r["n"], round(r["pct"], 6)) for r in clusters.top_values(df, "cluster").collect()}
    assert got == {(1, "even"): ("a", 30, 50.0), (1, "some"): ("x", 20, 33.333333), (2, "free"): ("only", 1, 100.0)}


def test_distinct_counts_of_many_columns(spark, monkeypatch):
    """Nulls, both zeros, NaN, values of every type, nested ones, a column without values; dictionaries that fill up."""
    monkeypatch.setattr(profile, "DICTIONARY", 50)
    nan = float("nan")
    rows = [(i, i % 7, [0.0, -0.0, nan, 1.5, None][i % 5], "é" * (i % 3) if i % 4 else None, i % 2 == 0, [i % 3], None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, `small.one` int, real double, text string, flag boolean, list array<int>, none string").withColumn("day", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 30).cast("int")))
    got = {r["column"]: r["distinct_values"] for r in profile.distinct_counts(df.repartition(3)).collect()}
    assert got == {"id": 1000, "small.one": 7, "real": 3, "text": 3, "flag": 2, "list": 3, "none": 0, "day": 30}
    plan = profile.distinct_counts(df, ["id", "text"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan
    assert {r["distinct_values"] for r in profile.distinct_counts(df.limit(0), ["id", "text"]).collect()} == {0}


def test_command_line_options(spark, tmp_path):
    """Batch epochs on sparse rows; the silhouette of a sample says so."""
    lines = ["SEXO_PESSOA;IDADE_PESSOA;CIDADE"] + [f"{'MF'[i % 2]};{20 + i % 3 * 25};{'ABC'[i % 3]}" for i in range(240)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    asked = ["--sample_frac", "1.0", "--map_size", "4", "--iterations", "100", "--profile", "legacy", "--method", "batch", "--sparse", "--silhouette_rows", "50"]
    pipeline.main(["--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), *asked])
    rows = spark.read.parquet(str(tmp_path / "out/clustered"))
    assert rows.count() == 240 and spark.read.parquet(str(tmp_path / "out/matrix")).count() == 240
    measures = writers.read_json(spark, str(tmp_path / "out/metrics"))
    assert measures["silhouette_sample"] == 50 and rows.where(f"{clusters.LABEL} <> 0").count() > 50


def test_a_pass_over_labelled_rows_finds_units_once(spark):
    """a filter on the labels does not find the units again, and one pass gives what all measures but the pairs need."""
    x, df = vectors(spark, 300)
    model = som.train(df, 3, 3, 1.0, 0.5, 60)
    of_unit = [0, 1, 1, 2, 0, 2, 3, 3, 1]
    rows = clusters.label_rows(df, model, of_unit)
    for passed in (metrics.clustered(rows), metrics._tally(rows), metrics._counted(metrics._labellings(rows))):
        assert passed._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    k1, d1, _ = som.nearest(x, model.flat)
    labels = np.array(of_unit)[k1]
    got = {(r["cluster"], r["dim"]): (r["n"], r["mean"], r["spread"]) for r in metrics._tally(rows).collect()}
    assert {c for c, _ in got} == set(labels.tolist()) - {0}
    for c in set(labels.tolist()) - {0}:
        own = x[labels == c]
        assert got[c, metrics.ROWS][0] == len(own) and np.allclose(got[c, metrics.DISTANCE][:2], (len(own), d1[labels == c].mean()))
        for k in range(x.shape[1]):
            assert np.allclose(got[c, k], (len(own), own[:, k].mean(), ((own[:, k] - own[:, k].mean()) ** 2).sum()))
