import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import sampling, scalar
from gridloom.operators import clusters, encode, features, lattice, metrics, som, tune
from gridloom.operators import profile as prof
from gridloom.plans import pipeline
from gridloom.sources import readers, writers


def values(spark, column, rows, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_hour_parser(spark):
    text = ["14:30", "14h30", "14H30", "9", "930", "1430", "14.5", " 7 :30", "-5:00", "sem hora", ":30", "", "99", None, "+7:1"]
    assert values(spark, scalar.parse_hour, text) == [14, 14, None, 9, 93, 14, 14, 7, -5, None, None, None, 99, None, 7]


def test_bins(spark):
    got = values(spark, scalar.period_of_day, [0, 5, 6, 24, 25, -1, None], "int")
    assert got == ["Madrugada", "Madrugada", "Manhã Cedo", "Noite Tardia", "nan", "nan", "nan"]
    assert values(spark, scalar.age_band, [0, 1, 18, 19, 200, 201, None], "int") == ["nan", "0-18", "0-18", "19-30", "100+", "nan", "nan"]


def test_numbers(spark):
    assert values(spark, scalar.to_number, ["-23,5", "-23.5", " 7 ", "", None, "1e3", "inf", "7d"]) == [None, -23.5, 7.0, None, None, 1000.0, None, None]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (["2022-01-02", "13/02/2022"], ["2022-01-02", None]),
        (["01/02/2022", "13/02/2022"], ["2022-01-02", None]),
        (["13/02/2022", "01/02/2022"], ["2022-02-13", "2022-02-01"]),
    ],
)
def test_date_format_comes_from_the_first_value(spark, given, want):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "_row_id long, DATA_OCORRENCIA string").coalesce(1)
    fmt = features.infer_date_format(df, "DATA_OCORRENCIA")
    got = [r[0] and r[0].date().isoformat() for r in df.orderBy("_row_id").select(scalar.to_timestamp(F.col("DATA_OCORRENCIA"), fmt)).collect()]
    assert got == want


@pytest.mark.parametrize(("n", "want"), [(5, 2), (10, 3), (15, 4), (25, 8)])
def test_exact_sample(spark, n, want):
    df = spark.range(n).withColumnRenamed("id", "_row_id")
    once = {r[0] for r in sampling.sample_fraction(df, 0.3, 42).collect()}
    assert len(once) == want == len({r[0] for r in sampling.sample_fraction(df.repartition(3), 0.3, 42).collect()} & once)
    assert sampling.sample_fraction(df, None, 42).count() == n == sampling.sample_fraction(df, 1, 42).count()


def test_exact_rows_at_any_count(spark):
    df = spark.range(1000).withColumnRenamed("id", "_row_id").persist()
    for k in (0, 1, 499, 999, 1000, 2000):
        assert sampling.exact_rows(df, k, 1).count() == min(k, 1000)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n;x;flag;name\n1;1.5;True;São\n2;NA;False;\n3;2;True;Rio\n".encode("latin-1"))
    df = readers.load(spark, str(tmp_path / "a.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "flag": "boolean", "name": "string", "_row_id": "bigint"}
    assert [tuple(r)[:4] for r in df.orderBy("n").collect()] == [(1, 1.5, True, "São"), (2, None, False, None), (3, 2.0, True, "Rio")]
    with pytest.raises(FileNotFoundError):
        readers.load(spark, str(tmp_path / "none.csv"))
    (tmp_path / "b.csv").write_text("a;b\n")
    assert readers.load(spark, str(tmp_path / "b.csv")).count() == 0


def test_feature_blocks_are_optional(spark):
    df = spark.createDataFrame([(1, "x", "1")], "_row_id long, UF string, LATITUDE string")
    out, groups = features.engineer(df)
    assert out.columns == ["_row_id", "UF"] and groups["geographic"] == []


def test_encoder(spark):
    rows = [(i, float(i % 4 + 1), None, f"v{i % 25:02d}", "k" if i % 3 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "_row_id long, a double, b double, c string, d string")
    e = encode.fit(df)
    assert e.medians["a"] == 2.5 and len(e.levels["c"]) == 16 and config.OTHER in e.levels["c"] and e.levels["d"] == [config.FILL, "k"]
    x = np.array([r["features"] for r in encode.transform(df, e).orderBy("_row_id").collect()])
    assert x.shape == (100, 2 + 16 + 2) and len(e.names) == 20
    assert abs(x[:, 0].mean()) < 1e-6 and abs(x[:, 0].std() - 1) < 1e-6 and (x[:, 1] == 0).all()
    assert (x[:, 2:18].sum(axis=1) == 1).all() and (x[:, 18:].sum(axis=1) == 1).all()
    assert encode.Encoder.from_dict(e.to_dict()) == e
    only = encode.fit(df.select("_row_id", "a"))
    assert only.categorical == [] and encode.transform(df, only).first()["features"][0] is not None


def test_profile_helpers(spark):
    df = spark.createDataFrame([(1, 2.0, "a", True)], "x long, y double, z string, f boolean")
    assert prof.numeric_columns(df) == ["x", "y"] and prof.text_columns(df) == ["z"]
    assert dict(prof.narrow_types(df).dtypes) == {"x": "int", "y": "float", "z": "string", "f": "boolean"}
    assert prof.memory_available(1) and prof.driver_memory_mb() > 0 and prof.plan_bytes(df) > 0


def test_schedule_lengths():
    assert [len(som.effective_steps(n)) for n in (500, 1000, 1001, 1500, 2000, 3000)] == [500, 1000, 910, 1360, 1810, 2710]
    assert len(som.effective_steps(5000, False)) == 5000
    assert som.batch_size(100_000, 400) == 10_000 and som.batch_size(5000, 400) == 1000
    assert [som.preset(n)["som_x"] for n in (100_001, 50_001, 10)] == [25, 30, 35]


def test_update_moves_units_to_the_row():
    w = som.initial_weights(3, 4, 5)
    assert np.allclose(np.linalg.norm(w, axis=2), 1)
    x, before = np.ones(5), w.copy()
    k = int(((before - x) ** 2).sum(axis=2).argmin())
    som.step(w, x, 0.5, 0.8)
    for i in range(3):
        for j in range(4):
            pull = 0.5 * math.exp(-((i - k // 4) ** 2 + (j - k % 4) ** 2) / (2 * 0.8**2))
            assert np.allclose(w[i, j], before[i, j] + pull * (x - before[i, j]))


def vectors(spark, n=60, d=4, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "_row_id long, features array<double>")


def test_training_is_repeatable_and_saved(spark, tmp_path):
    x, df = vectors(spark)
    a, b = som.train(df, 3, 3, 1.0, 0.5, 100), som.train(df.repartition(5), 3, 3, 1.0, 0.5, 100)
    assert np.array_equal(a.weights, b.weights)
    d = np.sqrt(((x[:, None] - a.flat[None]) ** 2).sum(axis=2))
    assert abs(a.quantization_error - d.min(axis=1).mean()) < 1e-9 and 0 <= a.topographic_error <= 1
    a.save(spark, str(tmp_path / "m"))
    got = som.SomModel.load(spark, str(tmp_path / "m"))
    assert np.allclose(got.weights, a.weights) and got.quantization_error == a.quantization_error
    assert som.train_fallback(df).shape == (20, 20)


def test_ties_go_to_the_first_unit():
    flat = np.array([[1.0, 0], [1.0, 0], [0, 1.0]])
    k1, d1, k2 = som.nearest(np.array([[1.0, 0]]), flat)
    assert (k1[0], d1[0], k2[0]) == (0, 0.0, 1)


def test_components_in_raster_order(spark):
    mask = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (3, 3), (4, 3), (5, 0)], "i int, j int")
    got = {(r["i"], r["j"]): r["cluster"] for r in lattice.components(mask, 6).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 1): 1, (3, 3): 2, (4, 3): 2, (5, 0): 3}


def test_empty_map(spark):
    hits = spark.createDataFrame([(0, 0, 0), (0, 1, 0)], "i int, j int, hits long")
    assert {r["share"] for r in lattice.normalized(hits).collect()} == {0.0}
    assert {r["cluster"] for r in lattice.label_lattice(hits, 2, 0.7).collect()} == {0}


def test_quality_measures(spark):
    x, df = vectors(spark, 80)
    labels = np.array([i % 4 for i in range(80)])
    rows = df.join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(labels)], "_row_id long, cluster int"), "_row_id")
    got = metrics.comprehensive(rows)
    keep = labels > 0
    p, c = x[keep], labels[keep]
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(p)):
        a = d[i, c == c[i]].sum() / ((c == c[i]).sum() - 1)
        b = min(d[i, c == k].mean() for k in set(c) - {c[i]})
        s.append((b - a) / max(a, b))
    centre = {k: p[c == k].mean(axis=0) for k in set(c)}
    within = sum(((p[c == k] - centre[k]) ** 2).sum() for k in centre)
    between = sum((c == k).sum() * ((centre[k] - p.mean(axis=0)) ** 2).sum() for k in centre)
    spread = {k: np.sqrt(((p[c == k] - centre[k]) ** 2).sum(axis=1)).mean() for k in centre}
    db = np.mean([max((spread[i] + spread[j]) / np.linalg.norm(centre[i] - centre[j]) for j in centre if j != i) for i in centre])
    assert abs(got["silhouette"] - np.mean(s)) < 1e-9
    assert abs(got["calinski_harabasz"] - (between / 2) / (within / (len(p) - 3))) < 1e-6
    assert abs(got["davies_bouldin"] - db) < 1e-9
    assert metrics.comprehensive(rows.where("cluster < 2")) == {}


def test_balance_counts_empty_bins(spark):
    got = metrics.balance(spark.createDataFrame([(1,), (1,), (3,)], "cluster int")).first()
    assert abs(got["imbalance"] - 1.105542) < 1e-6 and abs(got["balance"] - 0.474937) < 1e-6


def test_pruning_keeps_ids(spark):
    labels = spark.createDataFrame([(i, c) for i, c in enumerate([0] * 5 + [1] * 10 + [2] * 10 + [3] * 2 + [4] * 8)], "_row_id long, cluster int")
    valid = clusters.valid_clusters(labels, 2, 0.1, config.LEGACY)
    assert {r["cluster"] for r in valid.collect()} == {1, 2}
    assert {r["cluster"] for r in clusters.prune(labels, valid).collect()} == {0, 1, 2}
    assert {r["cluster"] for r in clusters.valid_clusters(labels, 15, 0.9).collect()} == {1, 2, 3, 4}  # the canonical profile has its own ratio


def test_search(spark):
    _, df = vectors(spark)
    params, history = tune.search(df, {"som_x": [2], "som_y": [2, 3], "sigma": [0.8], "learning_rate": [0.3], "iterations": [50]}, 5)
    assert len(history) == 2 and params == max(history, key=lambda h: h["score"])["params"]
    assert tune.best(tune.history_frame(spark, history)).first()["score"] == max(h["score"] for h in history)
    assert tune.composite(1, 0, 0.5) == pytest.approx(0.65)
    assert len(list(tune.grid(config.FULL_GRID))) == 243 and len(list(tune.grid(config.FAST_GRID))) == 32
    assert all(p["som_x"] == p["som_y"] == 20 for p, _ in zip(tune.grid(config.FULL_GRID), range(15)))


def test_search_scores_all_rows_unless_asked(spark, monkeypatch):
    """No sample without `max_rows`, whatever the row count; the argument reaches the silhouette."""
    _, df = vectors(spark)
    seen, whole = [], metrics.silhouette
    monkeypatch.setattr(metrics, "silhouette", lambda rows, max_rows=None: seen.append(max_rows) or whole(rows, max_rows))
    params = {"som_x": [3], "som_y": [3], "sigma": [0.8], "learning_rate": [0.3], "iterations": [50]}
    tune.search(df, params, 1)
    tune.search(df, params, 1, max_rows=7)
    assert seen == [None, 7]


def test_whole_analysis(spark, tmp_path):
    lines = ["DATA_OCORRENCIA;HORA_OCORRENCIA;LATITUDE;LONGITUDE;IDADE_PESSOA;UF;OBS"]
    lines += [f"2022-01-{i % 28 + 1:02d};{i % 24}:30;{i % 7}.5;{i % 5}.25;{i % 90};{'SP' if i % 2 else 'RJ'};n{i}" for i in range(120)]
    (tmp_path / "in.csv").write_text("\n".join(lines))
    raw = readers.load(spark, str(tmp_path / "in.csv"))
    got = pipeline.cluster_rows(raw, map_size=4, iterations=200)
    assert got["activation"].agg(F.sum("hits")).first()[0] == 120
    pipeline.write(got, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out/clustered"))
    assert back.count() == 120 and "CLUSTER_SOM" in back.columns and "OBS" in back.columns
    assert spark.read.parquet(str(tmp_path / "out/matrix")).columns == ["_row_id", *got["encoder"].names]
    assert writers.write_metrics(spark, {}, str(tmp_path / "none")) is False


def test_delimited_files(spark, tmp_path):
    """Doubled quotes, line breaks in quotes, U+FFFD in UTF-8, and bytes that are not UTF-8."""
    (tmp_path / "a.csv").write_bytes('k;t\n1;"x""y"\n2;"two\nlines; one"\n3;São \ufffd\n'.encode())
    assert [r["t"] for r in readers.load(spark, str(tmp_path / "a.csv")).orderBy("k").collect()] == ['x"y', "two\nlines; one", "São \ufffd"]
    (tmp_path / "b.csv").write_bytes("k;t\n1;São\n2;açaí\n".encode("latin-1"))
    assert [r["t"] for r in readers.load(spark, str(tmp_path / "b.csv")).orderBy("k").collect()] == ["São", "açaí"]


def test_narrow_keeps_low_bits(spark):
    df = spark.createDataFrame([(2**31,), (2**40 + 5,), (-(2**31) - 1,), (7,), (None,)], "x long")
    want = [int(np.int64(v).astype(np.int32)) for v in (2**31, 2**40 + 5, -(2**31) - 1, 7)]
    assert [r["x"] for r in prof.narrow_types(df).collect()] == [*want, None]


def test_search_survives_any_failure(spark, monkeypatch):
    whole, asked = tune.evaluate, []

    def evaluate(df, params, *a, **k):
        asked.append(params)
        if len(asked) == 1:
            raise RuntimeError("worker died")
        return {"params": params, "q_error": 1.0, "t_error": 0.0, "score": 0.5}

    monkeypatch.setattr(tune, "evaluate", evaluate)
    best, history = tune.search(spark.range(1).selectExpr("id AS _row_id", "array(1.0) AS features"), max_evaluations=2)
    assert len(history) == 2 and len(asked) == 3 and best == asked[1] and whole


def test_training_falls_back_where_memory_ends(spark, monkeypatch):
    df = spark.range(50).selectExpr("id AS _row_id", "array(double(id), 1.0) AS features")
    train = som.train

    def full(df, som_x=None, **k):
        if som_x == 99:
            raise MemoryError
        return train(df, som_x, **k)

    monkeypatch.setattr(som, "train", full)
    assert som.train_or_fallback(df, som_x=99, som_y=2, sigma=1.0, learning_rate=0.5, iterations=10).shape == (20, 20)
    monkeypatch.setattr(som, "train", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        som.train_or_fallback(df)


def test_command_line_writes_the_report(spark, tmp_path):
    lines = ["SEXO_PESSOA;IDADE_PESSOA;CIDADE"] + [f"{'MF'[i % 2]};{20 + i % 3 * 25};{'ABC'[i % 3]}" for i in range(240)]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    pipeline.main(["--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), "--sample_frac", "1.0", "--map_size", "4", "--iterations", "100", "--silhouette_rows", "0"])
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / "report" / name))
    assert read("shape").first()["n_rows"] == 240 and read("umatrix").count() == 16 and read("activation").count() == 16
    assert {r["column"] for r in read("frequent").collect()} == {"SEXO_PESSOA", "CIDADE"}
    total = sum(r["n"] for r in read("distribution").collect())
    assert total == 240 and read("cluster_numbers").count() > 0 and read("cluster_values").count() > 0
