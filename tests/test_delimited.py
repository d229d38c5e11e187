"""Delimited files against a character-by-character reading, under several split sizes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import sampling
from gridloom.plans import catalog
from gridloom.sources import delimited, readers


def read_slowly(text, sep=";"):
    """Records of a text: a quote opens a field at its start alone; blank lines between records are left out."""
    rows, row, field, state = [], [], "", "start"
    lines, i = text, 0
    line_start = True
    while i < len(lines):
        ch = lines[i]
        if line_start and state == "start" and not row:
            end = lines.find("\n", i)
            end = len(lines) if end < 0 else end
            if not lines[i:end].strip():
                i = end + 1
                continue
        line_start = False
        if state == "quoted":
            if ch == '"' and lines[i + 1 : i + 2] == '"':
                field += '"'
                i += 1
            elif ch == '"':
                state = "after"
            else:
                field += ch
        elif ch == sep:
            row.append(field)
            field, state = "", "start"
        elif ch == "\n":
            row.append(field.removesuffix("\r"))
            rows.append(row)
            row, field, state, line_start = [], "", "start", True
        elif ch == '"' and state == "start":
            state = "quoted"
        else:
            field += ch
            state = state if state == "after" else "plain"
        i += 1
    if row or field or state != "start":
        rows.append([*row, field.removesuffix("\r")])
    return rows


def some_file(seed, rows=400):
    """Fields with line breaks, quotes, separators, blank lines, stray quotes; CRLF and blank lines between records."""
    rng = random.Random(seed)
    inner = ["word", "two\nlines", "\n\n", 'say ""hi""', ";", "ção", '""', "", "\n;\n", 'end ""', "long " * 40]
    outer = ["plain", "", 'in 5" steps', 'a"b"c', "7", "1.5", " spaced ", "ção", "x'y"]
    text = "k;note;more\n"
    for k in range(rows):
        fields = [str(k)] + [f'"{"".join(rng.choice(inner) for _ in range(rng.randrange(4)))}"' if rng.random() < 0.5 else rng.choice(outer) for _ in range(2)]
        text += ";".join(fields) + rng.choice(["\n", "\n", "\n", "\r\n", "\n\n", "\n  \n"])
    return text


def as_read(df):
    return [(r["_row_id"], r["k"], r["note"] or "", r["more"] or "") for r in df.orderBy("_row_id").collect()]


@pytest.fixture
def split(spark):
    """Splits of so many bytes."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def to(n):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.minPartitionNum", "1")

    yield to
    for k, v in before.items():
        spark.conf.set(k, v)
    spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize("seed", [1, 2])
def test_same_records_however_a_file_is_split(spark, tmp_path, split, seed):
    text = some_file(seed)
    path = tmp_path / "a b.csv"
    path.write_bytes(text.encode())
    want = [(i, *r) for i, r in enumerate(read_slowly(text)[1:])]
    assert len(want) == 400
    for size in (400, 4096, 1 << 20):
        split(size)
        df, n = delimited.read_columns(spark, str(path))
        assert n == 400 and as_read(df) == want
        if size < 5000:
            assert df.rdd.getNumPartitions() >= min(20, len(text.encode()) // size)


def test_a_record_longer_than_many_splits(spark, tmp_path, split):
    text = 'k;note;more\n1;"' + "line ; x\n" * 3000 + '";a\n2;b;"c"\n'
    (tmp_path / "a.csv").write_text(text)
    split(500)
    df, n = delimited.read_columns(spark, str(tmp_path / "a.csv"))
    assert n == 2 and as_read(df) == [(0, "1", "line ; x\n" * 3000, "a"), (1, "2", "b", "c")]


def test_several_files_odd_headers_and_encodings(spark, tmp_path, split):
    split(60)
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.csv").write_bytes("﻿k;note;more\n1;a;b\n".encode())
    (tmp_path / "d" / "2.csv").write_text("k;note;more\n")
    (tmp_path / "d" / "3.csv").write_text('k;note;more\n2;"x\ny";\n3;only\n\n4;a;b;too many\n')
    df, n = delimited.read_columns(spark, str(tmp_path / "d"))
    assert n == 4 and as_read(df) == [(0, "1", "a", "b"), (1, "2", "x\ny", ""), (2, "3", "only", ""), (3, "4", "a", "b")]
    (tmp_path / "h.csv").write_text('a;;a;"b;\nc";_row_id\n1;2;3;4;5\n')
    df, _ = delimited.read_columns(spark, str(tmp_path / "h.csv"))
    assert df.columns == ["a", "Unnamed: 1", "a.1", "b;\nc", "_row_id.1", "_row_id"]
    (tmp_path / "open.csv").write_text('k;note;more\n1;a;b\n2;"never closed\n3;a;b\n')
    df, n = delimited.read_columns(spark, str(tmp_path / "open.csv"))
    assert n == 2 and as_read(df)[0] == (0, "1", "a", "b")
    (tmp_path / "none.csv").write_text("\n \n")
    with pytest.raises(ValueError, match="no header"):
        delimited.read_columns(spark, str(tmp_path / "none.csv"))
    (tmp_path / "l.csv").write_bytes("k;note;more\n".encode() + "1;São;\n".encode("latin-1") * 50)
    df, _ = delimited.read_columns(spark, str(tmp_path / "l.csv"))
    assert {r[2] for r in as_read(df)} == {"São"}


def test_states_of_lines():
    import pyarrow as pa

    rule = delimited.Lines(";")
    lines = [b"a;b", b'"a";b', b'"a;b', b'a"b;c', b'x";"y', b'"a""b"', b'"a""', b'";"', b'"";"";"', b'a;"b";"c', b'"a"b"c;d']
    out, in_ = rule.ends(pa.array(lines, pa.binary()))
    assert list(out) == [0, 0, 1, 0, 1, 0, 1, 0, 1, 1, 0]
    assert list(in_) == [1, 0, 0, 0, 1, 0, 0, 1, 0, 1, 0]
    for start in (0, 1):
        states, now = delimited.before(out, in_, start), start
        for i in range(len(lines)):
            assert states[i] == now
            now = in_[i] if now else out[i]
        assert states[-1] == now


def test_the_same_rows_are_sampled_under_any_split(spark, tmp_path, split):
    text = some_file(5)
    (tmp_path / "a.csv").write_text(text)
    seen = []
    for size in (300, 5000, 1 << 20):
        split(size)
        seen.append(sorted((r["_row_id"], r["k"]) for r in readers.load(spark, str(tmp_path / "a.csv"), 0.1).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 40 and all(i == k for i, k in seen[0])
    other = readers.load(spark, str(tmp_path / "a.csv"), 0.1, seed=7)
    assert sorted(r["_row_id"] for r in other.collect()) != [i for i, _ in seen[0]]


def test_bottom_rows_by_hash(spark):
    """The limit found by the sketch is that of a full sort, at every count, and samples of a seed are nested."""
    import hashlib

    ids = np.random.default_rng(0).permutation(5000)[:3000].tolist()
    df = spark.createDataFrame([(i,) for i in ids], "_row_id long")
    order = sorted(ids, key=lambda i: (int(hashlib.md5(f"9:{i}".encode()).hexdigest()[:15], 16), i))
    for k in (1, 2, 17, 1500, 2999, 3000):
        assert {r[0] for r in sampling.exact_rows(df, k, 9).collect()} == set(order[:k])
    numbers = spark.range(1000).withColumnRenamed("id", "_row_id")
    whole = {r[0] for r in sampling.sample_fraction(numbers, 0.3, 4).collect()}
    assert whole == {r[0] for r in sampling.sample_numbered(numbers, 1000, 0.3, 4).collect()} and len(whole) == 300
    assert sampling.sample_numbered(numbers, 1000, 0.0001, 4).count() == 0 and sampling.sample_numbered(numbers, 1000, None, 4).count() == 1000


def test_delimited_files_of_queries_are_sorted_by_ranges(spark, monkeypatch):
    """no task sorts or writes the whole table; rows of the files are numbered in the order of the key."""
    monkeypatch.setattr(catalog, "_place", lambda spark, name, whole=catalog._place: places.append(whole(spark, name)) or places[-1])
    before, places = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(999, -1, -1).select(F.col("id").alias("k"), F.concat(F.col("id").cast("string"), F.lit(';"two\nlines"')).alias("value"))
        for path in (catalog._delimited(spark, rows.select("k"), "k"), catalog._lines(spark, rows, "k;note")):
            got = readers.load(spark, path).select("k", "_row_id").collect()
            assert len(got) == 1000 and all(r["k"] == r["_row_id"] for r in got)
            n = [len(t.splitlines()) for _, t in spark.sparkContext.wholeTextFiles(path).collect() if t]
            assert len(n) > 1 and max(n) < sum(n) / 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    empty = catalog._lines(spark, rows.limit(0), "k;note")
    assert readers.load(spark, empty).columns == ["k", "note", "_row_id"] and readers.load(spark, empty).count() == 0
    assert len(places) == 3
