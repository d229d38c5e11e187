"""Queries of the reference's own operators, by name, with the SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import AGES, FALLBACK, FILL, LEGACY, OTHER, PERIODS, SIZE_PRESETS, Profile
from gridloom.functions import quantiles, sampling, scalar
from gridloom.operators import charts, clusters, encode, features, lattice, metrics, profile, som, tune
from gridloom.plans import pipeline
from gridloom.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _r(c, places: int = 6):
    return F.round(c, places)


# ---- sources and sinks -------------------------------------------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; under a local master without one, a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="gridloom-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_NOTE = "CASE c_custkey % 4 WHEN 0 THEN 'São \"' || c_mktsegment || '\"; x' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN c_name END"


@query(f"SELECT c_custkey, {_NOTE} AS note, c_acctbal FROM customer")
def source_delimited(spark, sf_dir):
    """Quotes, separators, line breaks and accents in quoted text, nulls and numbers, written as text and read back typed."""
    rows = _table(spark, sf_dir, "customer")
    quoted = F.concat(F.lit('"São ""'), "c_mktsegment", F.lit('""; x"'))
    note = F.expr("c_custkey % 4")
    note = F.when(note == 0, quoted).when(note == 1, F.lit('"two\nlines"')).when(note == 2, F.col("c_name")).otherwise(F.lit(""))
    lines = rows.select(F.col("c_custkey").alias("k"), F.concat_ws(";", F.col("c_custkey").cast("string"), note, F.col("c_acctbal").cast("string")).alias("value"))
    path = _lines(spark, lines, "c_custkey;note;c_acctbal")
    return readers.load(spark, path).select("c_custkey", "note", "c_acctbal")


def _delimited(spark: SparkSession, rows: DataFrame, key: str, encoding: str = "UTF-8") -> str:
    """Files that together hold the rows in the order of a key, each with its header: a task sorts one range of keys."""
    path = _place(spark, "delimited")
    rows.repartitionByRange(key).sortWithinPartitions(key).write.options(sep=";", header=True, encoding=encoding, timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(path)
    return path


def _lines(spark: SparkSession, lines: DataFrame, header: str) -> str:
    """The same of (k, value), values as they are."""
    path = _place(spark, "delimited")

    def headed(batches):
        told = TaskContext.get().partitionId() == 0  # whose first row is the header, also of an empty table
        one = lambda values: pa.RecordBatch.from_arrays([values], ["value"])
        for b in batches:
            if b.num_rows and not told:
                told = True
                yield one(pa.array([header]))
            yield one(b.column(0))

    head = spark.createDataFrame([(None, header)], "k long, value string")
    lines = head.unionByName(lines)
    lines.repartitionByRange("k").sortWithinPartitions("k").select("value").mapInArrow(headed, "value string").write.text(path)
    return path


_HASH = "('0x' || md5('42:' || {})[1:15])::BIGINT"


@query(
    f"""WITH f AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS id FROM orders)
    SELECT o_orderkey, o_orderstatus, id AS _row_id FROM (SELECT *, row_number() OVER (ORDER BY {_HASH.format("id")}, id) AS r, count(*) OVER () AS n FROM f) WHERE r <= round_even(0.1 * n, 0)"""
)
def source_sampled(spark, sf_dir):
    """The rows of a file's exact seeded sample, named: by their number in the file, whatever its splits."""
    path = _delimited(spark, _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return readers.load(spark, path, 0.1).select("o_orderkey", "o_orderstatus", "_row_id")


_SEGMENT = "CASE c_custkey % 3 WHEN 0 THEN 'São ' WHEN 1 THEN 'Ação, ' ELSE '' END || c_mktsegment"


@query(f"SELECT c_custkey, {_SEGMENT} AS segment, c_acctbal FROM customer")
def source_latin1(spark, sf_dir):
    """A Latin-1 file: bytes that are no UTF-8 decide on the encoding."""
    way = F.col("c_custkey") % 3
    segment = F.concat(F.when(way == 0, "São ").when(way == 1, "Ação, ").otherwise(""), F.col("c_mktsegment"))
    path = _delimited(spark, _table(spark, sf_dir, "customer").select("c_custkey", segment.alias("segment"), "c_acctbal"), "c_custkey", "ISO-8859-1")
    return readers.load(spark, path).select("c_custkey", "segment", "c_acctbal")


_PIECES = "CASE p_partkey % 5 WHEN 0 THEN 'in 5\" steps' WHEN 1 THEN 'a \"quoted\"; word' || chr(10) || chr(10) || 'and \"\"' WHEN 2 THEN chr(10) || ';' || chr(10) WHEN 3 THEN '' ELSE p_name END"


@query(f"SELECT p_partkey, nullif({_PIECES}, '') AS note, p_size, row_number() OVER (ORDER BY p_partkey) - 1 AS _row_id FROM part")
def source_quotes(spark, sf_dir):
    """Stray quotes, doubled quotes, blank lines and separators within quotes; rows are numbered as they stand in the file."""
    way = F.col("p_partkey") % 5
    note = F.when(way == 0, 'in 5" steps').when(way == 1, '"a ""quoted""; word\n\nand """""').when(way == 2, '"\n;\n"').when(way == 3, '""').otherwise(F.col("p_name"))
    lines = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(";", F.col("p_partkey").cast("string"), note, F.col("p_size").cast("string")).alias("value"))
    path = _lines(spark, lines, "p_partkey;note;p_size")
    return readers.load(spark, path).select("p_partkey", "note", F.col("p_size").cast("int").alias("p_size"), "_row_id")


@query("SELECT vec_id, round(embedding[1]::DOUBLE, 5) AS first, round(embedding[64]::DOUBLE, 5) AS last FROM embeddings")
def sink_wide(spark, sf_dir):
    """A matrix written with one column a feature, read back."""
    rows = readers.vectors(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")
    path = _place(spark, "wide")
    writers.write_wide(rows, [f"f{i}" for i in range(64)], path)
    return spark.read.parquet(path).select(F.col("_row_id").alias("vec_id"), F.round("f0", 5).alias("first"), F.round("f63", 5).alias("last"))


@query("SELECT c_custkey, c_mktsegment, (c_custkey % 3)::INT AS CLUSTER_SOM FROM customer")
def sink_clustered(spark, sf_dir):
    """Labelled rows written without their row id, read back."""
    rows = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("_row_id"))
    labels = rows.select("_row_id", (F.col("_row_id") % 3).alias("cluster"))
    path = _place(spark, "clustered")
    writers.write_clustered(clusters.attach(rows, labels), path)
    return spark.read.parquet(path)


@query("SELECT count(*)::BIGINT AS n, round(sum(u * u), 4) AS squares FROM (SELECT unnest(embedding)::DOUBLE AS u FROM embeddings WHERE vec_id < 16)")
def sink_model(spark, sf_dir):
    """A map written and read back: its weights."""
    model = _model(spark, sf_dir)
    path = _place(spark, "model")
    model.save(spark, path)
    back = som.SomModel.load(spark, path)
    return back.to_frame(spark).select(F.explode("w").alias("w")).select(F.col("w").cast("double").alias("u")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("u") * F.col("u")), 4).alias("squares"))


# ---- profiling -------------------------------------------------------------------------------------------------------

_EVENTS = "SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS value, props FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.when(F.col("event_id") % 5 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"), "props")


_COLUMNS = ("event_id", "user_id", "event_type", "value", "props")


@query(f"SELECT count(*) AS n_rows, 5::BIGINT AS n_columns, (sum((event_type IS NULL)::INT) + sum((value IS NULL)::INT))::BIGINT AS null_cells FROM ({_EVENTS})")
def profile_shape_nulls(spark, sf_dir):
    return profile.shape_nulls(_events(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", coalesce(sum(({c} IS NULL)::INT), 0)::BIGINT AS nulls FROM ({_EVENTS})" for c in _COLUMNS))
def profile_top_missing(spark, sf_dir):
    return profile.top_missing(_events(spark, sf_dir))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM ({_EVENTS})" for c in _COLUMNS))
def profile_distinct(spark, sf_dir):
    return profile.distinct_counts(_events(spark, sf_dir))


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value, round(avg({c}), 4) AS mean_value FROM ({_EVENTS})" for c in ("event_id", "user_id", "value")
    )
)
def profile_numeric(spark, sf_dir):
    return profile.numeric_summary(_events(spark, sf_dir)).withColumn("mean_value", _r("mean_value", 4))


@query(
    """WITH v AS (SELECT 'p_brand' AS "column", p_brand AS value, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY ALL)
    SELECT "column", value, n, rank FROM (SELECT *, (row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value))::INT AS rank FROM v) WHERE rank <= 3"""
)
def profile_top3(spark, sf_dir):
    return profile.top_values(_table(spark, sf_dir, "part"), ["p_brand", "p_type"])


_TYPE = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(column_type) END"


@query(f"SELECT {_TYPE} AS dtype, count(*) AS n FROM (DESCRIBE lineitem) GROUP BY 1")
def profile_types(spark, sf_dir):
    return charts.data_types(_table(spark, sf_dir, "lineitem"))


@query(
    """SELECT column_name AS "column", CASE WHEN column_type IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN 'numeric' WHEN column_type = 'VARCHAR' THEN 'text' ELSE 'neither' END AS kind
    FROM (DESCRIBE SELECT *, o_totalprice > 1000 AS is_large FROM orders)"""
)
def profile_typing(spark, sf_dir):
    """Which columns are numbers and which are text; booleans and dates are neither and reach no matrix."""
    rows = _table(spark, sf_dir, "orders").withColumn("is_large", F.col("o_totalprice") > 1000)
    numeric, text = profile.numeric_columns(rows), profile.text_columns(rows)
    kinds = [(c, "numeric" if c in numeric else "text" if c in text else "neither") for c in rows.columns]
    return spark.createDataFrame(kinds, "column string, kind string")


@query("SELECT round_even(0.3 * count(*), 0)::BIGINT AS n_rows, round_even(0.3 * count(*), 0)::BIGINT AS n_ids FROM orders")
def sample_exact(spark, sf_dir):
    got = sampling.sample_fraction(_table(spark, sf_dir, "orders").withColumn("_row_id", F.col("o_orderkey")), 0.3, 42)
    return got.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("o_orderkey").alias("n_ids"))


@query(f"SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {_HASH.format('o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r <= round_even(0.3 * n, 0)")
def sample_ids(spark, sf_dir):
    """Which rows the seeded sample takes."""
    return sampling.sample_fraction(_table(spark, sf_dir, "orders").select("o_orderkey"), 0.3, 42, "o_orderkey")


# ---- features --------------------------------------------------------------------------------------------------------


@query(
    """SELECT event_id, dayname(t) AS day, monthname(t) AS month, year(t)::INT AS year, coalesce(isodow(t) >= 6, false) AS weekend
    FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END AS t FROM events)"""
)
def feat_dayname_month_year_weekend(spark, sf_dir):
    t = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    rows = _table(spark, sf_dir, "events").select("event_id", t.alias("t"))
    return rows.select("event_id", scalar.day_name(F.col("t")).alias("day"), scalar.month_name(F.col("t")).alias("month"), F.year("t").alias("year"), scalar.is_weekend(F.col("t")).alias("weekend"))


_HOUR_SQL = """CASE event_id % 9 WHEN 0 THEN strftime(ts, '%H:%M') WHEN 1 THEN strftime(ts, '%Hh%M') WHEN 2 THEN hour(ts)::VARCHAR WHEN 3 THEN 'sem hora'
    WHEN 4 THEN strftime(ts, '%H.%M') WHEN 5 THEN strftime(ts, '%H%M') WHEN 6 THEN NULL WHEN 7 THEN ' 7 :30' ELSE strftime(ts, '%HH%M') END"""


def _hour_text():
    k, f = F.col("event_id") % 9, F.date_format
    return (
        F.when(k == 0, f("ts", "HH:mm")).when(k == 1, f("ts", "HH'h'mm")).when(k == 2, F.hour("ts").cast("string")).when(k == 3, "sem hora").when(k == 4, f("ts", "HH.mm"))
        .when(k == 5, f("ts", "HHmm")).when(k == 7, " 7 :30").when(k == 8, f("ts", "HH'H'mm"))
    )


_PARSED = f"""SELECT event_id, CASE WHEN contains(d, ':') THEN try_cast(regexp_extract(trim(split_part(d, ':', 1)), '^[+-]?[0-9]+$') AS INT)
    WHEN regexp_matches(d, '^[0-9]+$') THEN try_cast(substr(d, 1, 2) AS INT) END AS hour FROM (SELECT event_id, translate(trim({_HOUR_SQL}), 'h.', '::') AS d FROM events)"""


@query(_PARSED)
def feat_hour_parse(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", scalar.parse_hour(_hour_text()).alias("hour"))


def _case(column: str, bins: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {column} > {lo} AND {column} <= {hi} THEN '{label}'" for lo, hi, label in bins) + " ELSE 'nan' END"


@query(f"SELECT {_case('hour', PERIODS)} AS period, count(*) AS n FROM ({_PARSED}) GROUP BY ALL")
def feat_period_bins(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(scalar.parse_hour(_hour_text()).alias("hour"))
    return rows.groupBy(scalar.period_of_day(F.col("hour")).alias("period")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, {_case('a', AGES)} AS band FROM (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN (c_custkey * 7) % 230 - 10 END AS a FROM customer)")
def feat_age_bins(spark, sf_dir):
    age = F.when(F.col("c_custkey") % 13 != 0, (F.col("c_custkey") * 7) % 230 - 10)
    return _table(spark, sf_dir, "customer").select("c_custkey", scalar.age_band(age).alias("band"))


@query(
    r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN k::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN -k::DOUBLE - 0.5 ELSE NULL END AS number
    FROM (SELECT event_id, regexp_extract(props, '[0-9]+')::INT AS k FROM events)"""
)
def feat_coerce_numeric(spark, sf_dir):
    k, way = F.regexp_extract("props", "[0-9]+", 0), F.col("event_id") % 4
    text = F.when(way == 0, F.concat(F.lit(" "), k, F.lit(" "))).when(way == 1, F.concat(k, F.lit(",5"))).when(way == 2, F.concat(F.lit("-"), k, F.lit(".5"))).otherwise("")
    return _table(spark, sf_dir, "events").select("event_id", scalar.to_number(text).alias("number"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE END AS day FROM orders")
def feat_coerce_date(spark, sf_dir):
    way = F.col("o_orderkey") % 3
    text = F.when(way == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(way == 1, F.date_format("o_orderdate", "dd/MM/yyyy"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", scalar.to_timestamp(text, "yyyy-MM-dd").cast("date").alias("day"))


@query("SELECT c_custkey, (nullif(c_nationkey, 3) IS NOT NULL AND c_acctbal >= 0) AS has_coordinates FROM customer")
def feat_has_coords(spark, sf_dir):
    lat, lon = F.nullif("c_nationkey", F.lit(3)), F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))
    return _table(spark, sf_dir, "customer").select("c_custkey", scalar.has_coordinates(lat, lon).alias("has_coordinates"))


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN ts::DATE + 20 END AS d FROM events), f AS (SELECT day(arg_min(d, event_id)) > 12 AS day_first FROM e WHERE d IS NOT NULL)
    SELECT event_id, CASE WHEN day_first OR day(d) = month(d) THEN d WHEN day(d) <= 12 THEN make_date(year(d), day(d), month(d)) END AS day FROM e, f"""
)
def feat_infer_date(spark, sf_dir):
    """Dates written day first, read by the format of the first one: month first where that fits it."""
    rows = _table(spark, sf_dir, "events").select(F.col("event_id").alias("_row_id"), F.when(F.col("event_id") % 7 != 0, F.date_format(F.date_add(F.col("ts").cast("date"), 20), "dd/MM/yyyy")).alias("text"))
    fmt = features.infer_date_format(rows, "text")
    return rows.select(F.col("_row_id").alias("event_id"), scalar.to_timestamp(F.col("text"), fmt).cast("date").alias("day"))


@query(f"SELECT c_custkey AS _row_id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS IDADE_PESSOA, {_case('CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END', AGES)} AS FAIXA_ETARIA, c_mktsegment AS UF FROM customer")
def feat_blocks(spark, sf_dir):
    """The features of a table that has an age and a category, and neither date, hour nor whole coordinates."""
    rows = _table(spark, sf_dir, "customer")
    age = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal").cast("string")).otherwise("unknown")
    rows = rows.select(F.col("c_custkey").alias("_row_id"), age.alias("IDADE_PESSOA"), F.col("c_mktsegment").alias("UF"), F.lit("1.5").alias("LATITUDE"), "c_name")
    return features.engineer(rows)[0]


# ---- encoding --------------------------------------------------------------------------------------------------------

_NAMES = f"SELECT 'p_name' AS \"column\", coalesce(CASE WHEN p_partkey % 7 <> 0 THEN p_name END, '{FILL}') AS v FROM part UNION ALL SELECT 'p_type', p_type FROM part"


@query(
    f"""WITH v AS ({_NAMES}), c AS (SELECT "column", v, count(*) AS n FROM v GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, v) AS rank, count(*) OVER (PARTITION BY "column") AS levels FROM c)
    SELECT "column", CASE WHEN levels <= 20 OR rank <= 15 THEN v ELSE '{OTHER}' END AS value, sum(n)::BIGINT AS n FROM r GROUP BY ALL"""
)
def enc_fill_cap(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("p_name"), "p_type")
    fitted = encode.fit(rows)
    capped = rows.select(*[encode.capped(F.col(c), fitted.kept[c]).alias(c) for c in fitted.categorical])
    return profile.value_counts(capped, fitted.categorical)


_CUSTOMER = "SELECT c_custkey AS _row_id, CASE WHEN c_custkey % 5 <> 0 THEN c_acctbal END AS balance, c_nationkey AS nation, CASE WHEN c_custkey % 9 <> 0 THEN c_mktsegment END AS segment FROM customer"
_IMPUTED = f"SELECT _row_id, coalesce(balance, median(balance) OVER ()) AS balance, nation FROM ({_CUSTOMER})"


def _customer(spark, sf_dir) -> DataFrame:
    key = F.col("c_custkey")
    return _table(spark, sf_dir, "customer").select(
        key.alias("_row_id"), F.when(key % 5 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").alias("nation"), F.when(key % 9 != 0, F.col("c_mktsegment")).alias("segment")
    )


@query(f"SELECT round(quantile_cont(balance, 0.5), 4) AS median_balance, round(quantile_cont(nation::DOUBLE, 0.5), 4) AS median_nation FROM ({_CUSTOMER})")
def enc_median_impute(spark, sf_dir):
    fitted = encode.fit(_customer(spark, sf_dir))
    row = [(round(fitted.medians["balance"], 4), round(fitted.medians["nation"], 4))]
    return spark.createDataFrame(row, "median_balance double, median_nation double")


_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", median(CASE WHEN l_orderkey % 5 <> 0 THEN {c}::DOUBLE - 1000 END) AS median FROM lineitem" for c in _NUMBERS))
def enc_medians(spark, sf_dir):
    """Exact medians of eight columns with nulls and negative values, by histograms narrowed together."""
    rows = _table(spark, sf_dir, "lineitem").select(*[F.when(F.col("l_orderkey") % 5 != 0, F.col(c).cast("double") - 1000).alias(c) for c in _NUMBERS])
    return spark.createDataFrame(list(quantiles.medians(rows, list(_NUMBERS)).items()), "column string, median double")


@query(
    f"""WITH i AS ({_IMPUTED}) SELECT _row_id, round((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER (), 4) AS balance,
    round((nation - avg(nation) OVER ()) / stddev_pop(nation) OVER (), 4) AS nation FROM i"""
)
def enc_standardize(spark, sf_dir):
    rows = _customer(spark, sf_dir)
    fitted = encode.fit(rows)
    return rows.select("_row_id", *[_r(encode.numeric_value(fitted, c), 4).alias(c) for c in fitted.numeric])


@query(
    f"""WITH n AS (SELECT round(sum(balance), 2) AS balance, round(sum(nation), 2) AS nation FROM ({ORACLES["enc_standardize"]})), g AS (SELECT 'segment_' || coalesce(segment, '{FILL}') AS name, count(*)::DOUBLE AS total FROM ({_CUSTOMER}) GROUP BY ALL)
    SELECT name, total FROM g UNION ALL SELECT 'cells', count(*) * (2 + (SELECT count(*) FROM g))::DOUBLE FROM ({_CUSTOMER})"""
)
def enc_dense(spark, sf_dir):
    """Rows encoded by what is not 0, as vectors again: totals of the one-hot columns, and the number of cells."""
    rows = _customer(spark, sf_dir)
    fitted = encode.fit(rows)
    full = encode.dense(encode.transform_sparse(rows, fitted), len(fitted.names))
    names = F.array(*[F.lit(n) for n in fitted.names])
    cells = full.select(F.posexplode("features").alias("at", "value"))
    totals = cells.where(F.col("at") >= len(fitted.numeric)).groupBy("at").agg(F.sum(F.col("value").cast("double")).alias("total")).select(F.get(names, "at").alias("name"), "total")
    return totals.unionByName(cells.agg(F.lit("cells").alias("name"), F.count(F.lit(1)).cast("double").alias("total")).select("name", "total"))


@query(ORACLES["enc_standardize"])
def enc_artefacts(spark, sf_dir):
    """What a fit learnt, written as JSON, read back and applied."""
    rows = _customer(spark, sf_dir)
    path = _place(spark, "encoder")
    writers.write_json(spark, encode.fit(rows).to_dict(), path)
    fitted = encode.Encoder.from_dict(writers.read_json(spark, path))
    return rows.select("_row_id", *[_r(encode.numeric_value(fitted, c), 4).alias(c) for c in fitted.numeric])


@query(
    f"""SELECT 'numbers' AS side, count(*) AS n_rows, 2::BIGINT AS n_features FROM customer UNION ALL SELECT 'none', count(*), 0 FROM customer
    UNION ALL SELECT 'text', count(*), count(DISTINCT coalesce(segment, '{FILL}')) FROM ({_CUSTOMER})"""
)
def enc_one_sided(spark, sf_dir):
    """Matrices of rows that have numbers alone, text alone, or neither."""
    rows, out = _customer(spark, sf_dir), []
    for side, cols in (("numbers", ["balance", "nation"]), ("text", ["segment"]), ("none", [])):
        own = rows.select("_row_id", *cols)
        out.append(profile.matrix_density(encode.transform(own, encode.fit(own))).select(F.lit(side).alias("side"), "n_rows", "n_features"))
    return out[0].union(out[1]).union(out[2])


@query(f"SELECT 'segment_' || coalesce(segment, '{FILL}') AS name, count(*)::DOUBLE AS total FROM ({_CUSTOMER}) GROUP BY ALL")
def enc_onehot(spark, sf_dir):
    rows = _customer(spark, sf_dir)
    fitted = encode.fit(rows)
    names = F.array(*[F.lit(n) for n in fitted.names])
    cells = encode.transform(rows, fitted).select(F.posexplode("features").alias("at", "value")).where(F.col("at") >= len(fitted.numeric))
    return cells.groupBy("at").agg(F.sum("value").alias("total")).select(F.get(names, "at").alias("name"), "total")


@query(
    f"""WITH i AS ({_IMPUTED}), z AS (SELECT (balance <> avg(balance) OVER ())::INT + (nation <> avg(nation) OVER ())::INT + 1 AS nz FROM i),
    f AS (SELECT 2 + count(DISTINCT coalesce(segment, '{FILL}')) AS n FROM ({_CUSTOMER}))
    SELECT count(*) AS n_rows, (SELECT n FROM f) AS n_features, sum(nz)::BIGINT AS n_nonzero, round(sum(nz) / (count(*) * (SELECT n FROM f)), 6) AS density FROM z"""
)
def enc_matrix_density(spark, sf_dir):
    rows = _customer(spark, sf_dir)
    return profile.matrix_density(encode.transform(rows, encode.fit(rows))).withColumn("density", _r("density"))


@query(
    f"""WITH s AS (SELECT count(*) AS n FROM ({_CUSTOMER})) SELECT count(*) AS n_cells, round(sum(v), 3) AS total FROM (
    WITH i AS ({_IMPUTED}) SELECT (balance - avg(balance) OVER ()) / stddev_pop(balance) OVER () AS v FROM i UNION ALL SELECT (nation - avg(nation) OVER ()) / stddev_pop(nation) OVER () FROM i
    UNION ALL SELECT 1.0 FROM i) WHERE v <> 0"""
)
def enc_sparse_long(spark, sf_dir):
    rows = _customer(spark, sf_dir)
    cells = writers.sparse_long(encode.transform(rows, encode.fit(rows)))
    return cells.agg(F.count(F.lit(1)).alias("n_cells"), _r(F.sum(F.col("value").cast("double")), 3).alias("total"))


@query(
    """SELECT count(*) AS n, sum(l_orderkey::INT)::BIGINT AS orders, round(sum(l_extendedprice::FLOAT::DOUBLE), 2) AS price, round(sum(l_discount::FLOAT::DOUBLE), 4) AS discount FROM lineitem"""
)
def cast_narrow(spark, sf_dir):
    rows = profile.narrow_types(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_extendedprice", "l_discount"))
    total = lambda c: F.sum(F.col(c).cast("double"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("orders"), _r(total("l_extendedprice"), 2).alias("price"), _r(total("l_discount"), 4).alias("discount"))


# ---- maps ------------------------------------------------------------------------------------------------------------

_SIDE = 4
_BMU = """cb AS MATERIALIZED (SELECT vec_id::INT AS k, (vec_id // 4)::INT AS i, (vec_id % 4)::INT AS j, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < 16),
    dist AS (SELECT e.vec_id, c.k, list_distance(e.embedding::DOUBLE[], c.w) AS d FROM embeddings e CROSS JOIN cb c),
    near AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, k) AS rn FROM dist),
    units AS MATERIALIZED (SELECT vec_id AS _row_id, max(CASE WHEN rn = 1 THEN k END) AS k1, max(CASE WHEN rn = 1 THEN d END) AS d1, max(CASE WHEN rn = 2 THEN k END) AS k2 FROM near WHERE rn <= 2 GROUP BY 1)"""
_HITS = _BMU + ", hits AS MATERIALIZED (SELECT c.i, c.j, count(u.k1) AS hits FROM cb c LEFT JOIN units u ON u.k1 = c.k GROUP BY 1, 2)"
_THRESHOLD = LEGACY.density_threshold * 2
_LATTICE = (
    _HITS
    + f""", mask AS MATERIALIZED (SELECT i, j, i * 4 + j AS cell FROM hits WHERE hits / (SELECT max(hits) FROM hits) > {_THRESHOLD}),
    reach(cell, root) AS (SELECT cell, cell FROM mask UNION SELECT m.cell, r.root FROM reach r JOIN mask s ON s.cell = r.cell JOIN mask m ON abs(m.i - s.i) + abs(m.j - s.j) = 1),
    roots AS (SELECT cell, min(root) AS root FROM reach GROUP BY cell),
    lattice AS MATERIALIZED (SELECT h.i, h.j, coalesce(dense_rank() OVER (ORDER BY r.root NULLS LAST), 0)::INT * (r.root IS NOT NULL)::INT AS cluster FROM hits h LEFT JOIN roots r ON r.cell = h.i * 4 + h.j)"""
)


def _with(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {select}"


def _rows(spark, sf_dir) -> DataFrame:
    return readers.vectors(_table(spark, sf_dir, "embeddings"), "embedding", "vec_id")


def _model(spark, sf_dir) -> som.SomModel:
    first = _table(spark, sf_dir, "embeddings").where(F.col("vec_id") < _SIDE * _SIDE)
    return som.SomModel.from_frame(first.select(F.floor(F.col("vec_id") / _SIDE).cast("int").alias("i"), (F.col("vec_id") % _SIDE).cast("int").alias("j"), F.col("embedding").alias("w")))


def _units(spark, sf_dir) -> DataFrame:
    return som.bmu(_rows(spark, sf_dir), _model(spark, sf_dir))


def _hits(spark, sf_dir) -> DataFrame:
    return lattice.activation_map(_units(spark, sf_dir), _SIDE, _SIDE)


def _lattice(spark, sf_dir) -> DataFrame:
    return lattice.label_lattice(_hits(spark, sf_dir), _SIDE, _THRESHOLD)


@query(_with(_BMU, "SELECT _row_id, k1, round(d1, 6) AS d1, k2 FROM units"))
def som_bmu(spark, sf_dir):
    return _units(spark, sf_dir).withColumn("d1", _r("d1"))


_ENCODED = f"""i AS ({_IMPUTED}), z AS (SELECT _row_id, ((balance - avg(balance) OVER ()) / stddev_pop(balance) OVER ())::FLOAT::DOUBLE AS b, ((nation - avg(nation) OVER ()) / stddev_pop(nation) OVER ())::FLOAT::DOUBLE AS n FROM i),
    g AS (SELECT _row_id, coalesce(segment, '{FILL}') AS s FROM ({_CUSTOMER})),
    v AS MATERIALIZED (SELECT _row_id, list_concat([b, n], list_transform((SELECT list(DISTINCT s ORDER BY s) FROM g), lambda x: (x = s)::INT::DOUBLE)) AS x FROM z JOIN g USING (_row_id))"""


@query(
    f"""WITH {_ENCODED}, cb AS (SELECT (_row_id // 7)::INT AS k, x AS w FROM v WHERE _row_id % 7 = 0 AND _row_id < 112),
    near AS (SELECT v._row_id, k, list_distance(x, w) AS d, row_number() OVER (PARTITION BY v._row_id ORDER BY round(list_distance(x, w), 9), k) AS r FROM v CROSS JOIN cb)
    SELECT _row_id, max(CASE WHEN r = 1 THEN k END) AS k1, round(max(CASE WHEN r = 1 THEN d END), 5) AS d1, max(CASE WHEN r = 2 THEN k END) AS k2 FROM near WHERE r <= 2 GROUP BY 1"""
)
def som_bmu_sparse(spark, sf_dir):
    """Nearest units of encoded rows that hold only what is not 0."""
    rows = _customer(spark, sf_dir)
    fitted = encode.fit(rows)
    first = encode.transform(rows, fitted).where((F.col("_row_id") % 7 == 0) & (F.col("_row_id") < 112)).withColumn("k", F.floor(F.col("_row_id") / 7))
    model = som.SomModel.from_frame(first.select(F.floor(F.col("k") / _SIDE).cast("int").alias("i"), (F.col("k") % _SIDE).cast("int").alias("j"), F.col("features").alias("w")))
    return som.bmu(encode.transform_sparse(rows, fitted), model).withColumn("d1", _r("d1", 5))


@query(_with(_HITS, "SELECT i, j, hits FROM hits"))
def som_activation_map(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(_with(_BMU, "SELECT round(avg(d1), 6) AS quantization_error FROM units"))
def som_qe(spark, sf_dir):
    return som.quantization_error(_units(spark, sf_dir)).select(_r("quantization_error").alias("quantization_error"))


@query(_with(_BMU, "SELECT round(avg(CASE WHEN greatest(abs(k1 // 4 - k2 // 4), abs(k1 % 4 - k2 % 4)) > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS topographic_error FROM units"))
def som_te(spark, sf_dir):
    return som.topographic_error(_units(spark, sf_dir), _SIDE).select(_r("topographic_error").alias("topographic_error"))


_UMATRIX = _BMU + """, nb AS (SELECT a.i, a.j, sum(list_distance(a.w, b.w)) AS s FROM cb a JOIN cb b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 AND a.k <> b.k GROUP BY 1, 2),
    um AS (SELECT i, j, s / (SELECT max(s) FROM nb) AS u FROM nb)"""


@query(_with(_UMATRIX, "SELECT i, j, round(u, 6) AS u FROM um"))
def som_umatrix(spark, sf_dir):
    return lattice.umatrix(_model(spark, sf_dir).to_frame(spark)).withColumn("u", _r("u"))


@query(_with(_UMATRIX, "SELECT k::INT AS level, round((SELECT min(u) FROM um) + ((SELECT max(u) FROM um) - (SELECT min(u) FROM um)) * k / 9, 6) AS value FROM range(10) t(k)"))
def som_map_levels(spark, sf_dir):
    return charts.umatrix(_model(spark, sf_dir).to_frame(spark))[1].withColumn("value", _r("value"))


_SMOOTH = _HITS + """, o AS (SELECT a::INT AS a, exp(-a * a / 2.0) / (SELECT sum(exp(-x * x / 2.0)) FROM range(-4, 5) r(x)) AS w FROM range(-4, 5) t(a)),
    m AS (SELECT c.i AS ci, c.j AS cj, (((c.i + p.a) % 8) + 8) % 8 AS mi, (((c.j + q.a) % 8) + 8) % 8 AS mj, p.w * q.w AS w FROM hits c CROSS JOIN o p CROSS JOIN o q),
    sm AS (SELECT ci AS i, cj AS j, sum(m.w * h.hits) AS smoothed FROM m JOIN hits h ON h.i = CASE WHEN mi >= 4 THEN 7 - mi ELSE mi END AND h.j = CASE WHEN mj >= 4 THEN 7 - mj ELSE mj END GROUP BY 1, 2)"""


@query(_with(_SMOOTH, "SELECT i, j, round(smoothed, 6) AS smoothed FROM sm"))
def som_smooth(spark, sf_dir):
    return lattice.smooth(_hits(spark, sf_dir), _SIDE, _SIDE).withColumn("smoothed", _r("smoothed"))


@query(_with(_SMOOTH, "SELECT h.i, h.j, h.hits, round(s.smoothed, 6) AS smoothed, h.hits <= (SELECT quantile_cont(hits, 0.7) FROM hits) AS dark_text FROM hits h JOIN sm s USING (i, j)"))
def som_map_stats(spark, sf_dir):
    return charts.activation(_hits(spark, sf_dir), _SIDE, _SIDE).withColumn("smoothed", _r("smoothed"))


@query(_with(_HITS, f"SELECT i, j, hits, round(hits / (SELECT max(hits) FROM hits), 6) AS share, hits / (SELECT max(hits) FROM hits) > {_THRESHOLD} AS is_dense FROM hits"))
def som_normalized_mask(spark, sf_dir):
    cells = lattice.normalized(_hits(spark, sf_dir))
    return cells.select("i", "j", "hits", _r("share").alias("share"), (F.col("share") > _THRESHOLD).alias("is_dense"))


@query(_with(_LATTICE, "SELECT i, j, cluster FROM lattice", True))
def som_components(spark, sf_dir):
    return _lattice(spark, sf_dir)


@query(_with(_LATTICE, "SELECT cluster, round(avg(i), 6) AS row, round(avg(j), 6) AS col FROM lattice WHERE cluster > 0 GROUP BY 1", True))
def som_component_centroids(spark, sf_dir):
    return charts.natural_clusters(_lattice(spark, sf_dir))[1].select("cluster", _r("row").alias("row"), _r("col").alias("col"))


@query(
    _with(
        _BMU,
        """, x AS (SELECT u.k1, generate_subscripts(e.embedding, 1) - 1 AS dim, unnest(e.embedding::DOUBLE[]) AS v FROM units u JOIN embeddings e ON e.vec_id = u._row_id),
        s AS (SELECT k1, dim, sum(v) AS total, count(*) AS n FROM x GROUP BY 1, 2),
        h AS (SELECT a.k, b.k AS c, exp(-((a.i - b.i) ** 2 + (a.j - b.j) ** 2) / 2.0) AS h FROM cb a CROSS JOIN cb b)
        SELECT h.k, s.dim::INT AS dim, round(sum(h.h * s.total) / sum(h.h * s.n), 6) AS w FROM h JOIN s ON s.k1 = h.c GROUP BY 1, 2""".lstrip(),
    ).replace("units, x AS", "units, x AS")
)
def som_batch_epoch(spark, sf_dir):
    return som.batch_epoch(_rows(spark, sf_dir), _model(spark, sf_dir), 1.0).withColumn("w", _r("w"))


_DRAW = "(('0x' || md5('42:' || k || ':' || j)[1:15])::BIGINT::DOUBLE / 2::DOUBLE ** 59 - 1)"
_EMBEDDED = "rows AS MATERIALIZED (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"


def _first_codebooks(maps: str) -> str:
    """Codebooks that trainings start with, one row for each row (o, x, y, ...) of `maps`: units by rows, of unit length."""
    return f"""draws AS (SELECT o, k, list({_DRAW} ORDER BY j) AS w FROM {maps}, (SELECT max(len(v)) AS d FROM rows), range(x * y) a(k), range(d) b(j) GROUP BY o, k),
    start AS MATERIALIZED (SELECT o, list(list_transform(w, lambda v: v / sqrt(list_sum(list_transform(w, lambda z: z * z)))) ORDER BY k) AS cb FROM draws GROUP BY o)"""


def _online(maps: str) -> str:
    """Codebooks `fin` (o, cb) trained on `rows` (id, v): the online update, one recursion a step, as long as there are more
    rows than steps. maps: (o, x, y, sigma, rate, n)."""
    return f"""steps AS MATERIALIZED (SELECT v AS x, row_number() OVER (ORDER BY {_HASH.format("id")}, id) - 1 AS t FROM rows), {_first_codebooks(maps)},
    train(o, t, cb) AS (SELECT o, 0::BIGINT, cb FROM start UNION ALL
      SELECT o, t + 1, list_transform(cb, lambda w, i: list_transform(w, lambda v, j: v + rate * exp(-(((i - 1) // y - k // y) ** 2 + ((i - 1) % y - k % y) ** 2) / (2 * sigma * sigma)) * (x[j] - v)))
      FROM (SELECT g.o, g.t, g.cb, s.x, c.y, c.sigma, c.rate, list_position(g.d, list_min(g.d)) - 1 AS k
        FROM (SELECT train.o, train.t, cb, list_transform(cb, lambda w: list_distance(w, steps.x)) AS d FROM train JOIN steps ON steps.t = train.t) g JOIN steps s ON s.t = g.t JOIN {maps} c ON c.o = g.o AND g.t < c.n)),
    fin AS MATERIALIZED (SELECT o, list_transform(cb, lambda w: w::FLOAT[]::DOUBLE[]) AS cb FROM train JOIN {maps} USING (o) WHERE t = n)"""


@query(
    f"""WITH RECURSIVE {_EMBEDDED}, maps AS (SELECT 0 AS o, 5 AS x, 5 AS y, 1.0::DOUBLE AS sigma, 0.5::DOUBLE AS rate, 500 AS n), {_online("maps")},
    units AS (SELECT unnest(cb) AS w, generate_subscripts(cb, 1) - 1 AS k FROM fin), cells AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS dim FROM units)
    SELECT (k // 5)::INT AS i, (k % 5)::INT AS j, dim::INT AS dim, round(w, 4) AS w FROM cells"""
)
def som_train_online(spark, sf_dir):
    """Weights after 500 online updates."""
    model = som.train(_rows(spark, sf_dir), 5, 5, 1.0, 0.5, 500)
    return model.to_frame(spark).select("i", "j", F.posexplode("w").alias("dim", "w")).withColumn("w", _r(F.col("w").cast("double"), 4))


def _epoch(name: str, before: str, y: int, sigma: float) -> str:
    """Codebook `name` (k, w) after one batch epoch of the codebook `before`."""
    return f"""{name}_u AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, k, list_distance(embedding::DOUBLE[], w) AS d FROM embeddings CROSS JOIN {before}) GROUP BY 1),
    {name}_s AS (SELECT k, dim, sum(v) AS total, count(*) AS n FROM (SELECT u.k, generate_subscripts(embedding, 1) AS dim, unnest(embedding::DOUBLE[]) AS v FROM {name}_u u JOIN embeddings USING (vec_id)) GROUP BY 1, 2),
    {name}_h AS (SELECT a.k, b.k AS c, exp(-((a.k // {y} - b.k // {y}) ** 2 + (a.k % {y} - b.k % {y}) ** 2) / (2 * {sigma} * {sigma})) AS h FROM {before} a CROSS JOIN {before} b),
    {name} AS MATERIALIZED (SELECT k, list(w ORDER BY dim) AS w FROM (SELECT h.k, s.dim, sum(h.h * s.total) / sum(h.h * s.n) AS w FROM {name}_h h JOIN {name}_s s ON s.k = h.c GROUP BY 1, 2) GROUP BY 1)"""


@query(
    f"""WITH {_EMBEDDED}, maps AS (SELECT 0 AS o, 4 AS x, 4 AS y), {_first_codebooks("maps")}, e0 AS MATERIALIZED (SELECT unnest(cb) AS w, generate_subscripts(cb, 1) - 1 AS k FROM start),
    {_epoch("e1", "e0", 4, 1.5)}, {_epoch("e2", "e1", 4, 1.5 * som.SHRINK)},
    cells AS (SELECT k, unnest(w) AS w, generate_subscripts(w, 1) - 1 AS dim FROM e2)
    SELECT (k // 4)::INT AS i, (k % 4)::INT AS j, dim::INT AS dim, round(w::FLOAT::DOUBLE, 4) AS w FROM cells"""
)
def som_train_batch(spark, sf_dir):
    """Weights after two epochs over all rows, the second started from what the first one saved."""
    rows, path = _rows(spark, sf_dir), _place(spark, "epochs")
    som.train(rows, 4, 4, 1.5, 0.5, 1, method="batch", epochs=1, path=path)
    model = som.train(rows, 4, 4, 1.5, 0.5, 1, method="batch", epochs=2, path=path)
    return model.to_frame(spark).select("i", "j", F.posexplode("w").alias("dim", "w")).withColumn("w", _r(F.col("w").cast("double"), 4))


_PRESETS = "CASE " + " ".join(f"WHEN n > {above} THEN {{{k}}}" for above, k in zip((p[0] for p in SIZE_PRESETS), range(3), strict=True)) + " END"


def _preset(column: int) -> str:
    return _PRESETS.format(*(p[column] for p in SIZE_PRESETS))


_COUNTED = ("customer", "orders", "lineitem", "events", "embeddings")


@query(
    f"""WITH c AS ({" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in _COUNTED)})
    SELECT name, n, {_preset(1)}::INT AS side, {_preset(2)}::DOUBLE AS learning_rate, {_preset(3)}::DOUBLE AS sigma, {_preset(4)}::INT AS iterations,
    greatest(1000, least(100000000 // (4 * {_preset(1)} ** 2)::BIGINT, 10000, n // 10))::BIGINT AS rows_at_once FROM c"""
)
def som_preset(spark, sf_dir):
    """What the size of each table presets."""
    rows = []
    for t in _COUNTED:
        n = _table(spark, sf_dir, t).count()
        p = som.preset(n)
        rows.append((t, n, p["som_x"], p["learning_rate"], p["sigma"], p["iterations"], som.batch_size(n, p["som_x"] * p["som_y"])))
    return spark.createDataFrame(rows, "name string, n long, side int, learning_rate double, sigma double, iterations int, rows_at_once long")


@query(
    f"""WITH RECURSIVE {_EMBEDDED}, maps AS (SELECT 0 AS o, {FALLBACK["som_x"]} AS x, {FALLBACK["som_y"]} AS y, {FALLBACK["sigma"]}::DOUBLE AS sigma, {FALLBACK["learning_rate"]}::DOUBLE AS rate, {FALLBACK["iterations"]} AS n), {_online("maps")},
    units AS (SELECT unnest(cb) AS w, generate_subscripts(cb, 1) - 1 AS k FROM fin)
    SELECT (k // {FALLBACK["som_y"]})::INT AS i, (k % {FALLBACK["som_y"]})::INT AS j, round(list_sum(list_transform(w, lambda v: v * v)), 4) AS squares FROM units"""
)
def som_fallback(spark, sf_dir):
    """The small map that a training without enough memory falls back to."""
    w = som.train_fallback(_rows(spark, sf_dir)).to_frame(spark)
    return w.select("i", "j", _r(F.aggregate("w", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")), 4).alias("squares"))


@query(
    _with(
        _LATTICE + "," + _UMATRIX.removeprefix(_BMU + ",") + """, lv AS (SELECT cluster, avg(i) AS row, avg(j) AS col FROM lattice WHERE cluster > 0 GROUP BY 1)""",
        "SELECT l.i, l.j, h.hits, round(um.u, 6) AS u, l.cluster, round(lv.row, 6) AS row FROM lattice l JOIN hits h USING (i, j) JOIN um USING (i, j) LEFT JOIN lv ON lv.cluster = l.cluster",
        True,
    )
)
def som_lattice(spark, sf_dir):
    """Hits, U-matrix, label and label's centre of each cell, by the one call."""
    found = lattice.analyze(_model(spark, sf_dir), _rows(spark, sf_dir), Profile(density_threshold=_THRESHOLD))
    cells = found["activation"].join(found["umatrix"], ["i", "j"]).join(found["lattice"], ["i", "j"]).join(lattice.centroids(found["lattice"]).select("cluster", "row"), "cluster", "left")
    out = spark.createDataFrame(cells.select("i", "j", "hits", _r("u").alias("u"), "cluster", _r("row").alias("row")).collect(), "i int, j int, hits long, u double, cluster int, row double")
    for name in ("units", "activation"):
        found[name].unpersist()
    return out


# ---- clusters --------------------------------------------------------------------------------------------------------


@query(_with(_LATTICE, "SELECT u._row_id, l.cluster FROM units u JOIN lattice l ON l.i * 4 + l.j = u.k1", True))
def cluster_assign(spark, sf_dir):
    units = _units(spark, sf_dir)
    return clusters.assign(units, lattice.label_lattice(lattice.activation_map(units, _SIDE, _SIDE), _SIDE, _THRESHOLD), _SIDE)


@query(
    f"""WITH a AS ({ORACLES["cluster_assign"]}), n AS (SELECT cluster, count(*) AS n FROM a GROUP BY 1),
    ok AS (SELECT cluster FROM (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS r FROM n WHERE cluster <> 0 AND n >= floor((SELECT sum(n) FROM n) * 0.05)) WHERE r <= 2)
    SELECT e.vec_id, e.label, coalesce(ok.cluster, 0)::INT AS "CLUSTER_SOM" FROM a JOIN embeddings e ON e.vec_id = a._row_id LEFT JOIN ok USING (cluster)"""
)
def cluster_analyze(spark, sf_dir):
    """From units and lattice to labelled rows: assignment, the two largest clusters of 5 % of the rows or more, attachment."""
    units = _units(spark, sf_dir)
    cells = lattice.label_lattice(lattice.activation_map(units, _SIDE, _SIDE), _SIDE, _THRESHOLD)
    raw = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").alias("_row_id"))
    return clusters.analyze(units, cells, raw, _SIDE, 2, 0.05, LEGACY)[0].drop("_row_id")


@query(ORACLES["cluster_analyze"])
def cluster_fused(spark, sf_dir):
    """The same analysis without a join or shuffle of rows: unit and label are looked up where the row lies."""
    hits, model = _hits(spark, sf_dir), _model(spark, sf_dir)
    of_unit = clusters.unit_labels(hits, lattice.label_lattice(hits, _SIDE, _THRESHOLD), _SIDE, 2, 0.05, LEGACY)
    rows = _table(spark, sf_dir, "embeddings").withColumn("features", F.col("embedding").cast("array<double>"))
    return clusters.label_rows(rows, model, of_unit).select("vec_id", "label", F.col("cluster").alias("CLUSTER_SOM"))


_SIZES = "n AS (SELECT label AS cluster, count(*) AS n FROM embeddings GROUP BY 1)"
_VALID = (
    _SIZES
    + ", ok AS (SELECT cluster, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, cluster) AS r FROM n WHERE cluster <> 0 AND n >= floor((SELECT sum(n) FROM n) * 0.09)) WHERE r <= 5)"
)


def _labels(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_row_id"), F.col("label").alias("cluster"))


def _pruned(spark, sf_dir) -> DataFrame:
    labels = _labels(spark, sf_dir)
    return clusters.prune(labels, clusters.valid_clusters(labels, 5, 0.09, LEGACY))


@query(_with(_VALID, "SELECT e.vec_id AS _row_id, coalesce(ok.cluster, 0)::INT AS cluster FROM embeddings e LEFT JOIN ok ON ok.cluster = e.label"))
def cluster_prune(spark, sf_dir):
    return _pruned(spark, sf_dir)


@query(_with(_VALID, "SELECT e.vec_id, e.label, coalesce(ok.cluster, 0)::INT AS \"CLUSTER_SOM\" FROM embeddings e LEFT JOIN ok ON ok.cluster = e.label"))
def cluster_attach(spark, sf_dir):
    raw = _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("vec_id").alias("_row_id"))
    return clusters.attach(raw, _pruned(spark, sf_dir)).drop("_row_id")


@query(_with(_VALID, "SELECT coalesce(ok.cluster, 0)::INT AS cluster, count(*) AS n FROM embeddings e LEFT JOIN ok ON ok.cluster = e.label GROUP BY 1"))
def cluster_distribution(spark, sf_dir):
    return clusters.distribution(_pruned(spark, sf_dir))


@query(_with(_SIZES, "SELECT cluster, n, round(n * 100.0 / (SELECT sum(n) FROM n), 6) AS pct, n > 0.01 * (SELECT sum(n) FROM n WHERE cluster <> 0) AS in_pie FROM n WHERE cluster <> 0"))
def cluster_share_pie(spark, sf_dir):
    return charts.cluster_distribution(_labels(spark, sf_dir)).withColumn("pct", _r("pct"))


@query(
    """WITH v AS (SELECT o_custkey % 4 AS cluster, 0 AS place, 'o_orderstatus' AS "column", o_orderstatus AS value FROM orders UNION ALL
    SELECT o_custkey % 4, 1, 'o_orderpriority', o_orderpriority FROM orders),
    c AS (SELECT cluster, place, "column", value, count(*) AS n FROM v WHERE cluster <> 0 GROUP BY ALL),
    r AS (SELECT *, sum(n) OVER (PARTITION BY cluster, place) AS size, row_number() OVER (PARTITION BY cluster, place ORDER BY n DESC, value) AS rank FROM c)
    SELECT cluster, "column", value, n, round(n * 100.0 / size, 6) AS pct FROM r WHERE rank = 1 AND n > size * 0.25"""
)
def cluster_top_values(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").withColumn("cluster", F.col("o_custkey") % 4)
    return clusters.top_values(rows, "cluster", ["o_orderstatus", "o_orderpriority"]).withColumn("pct", _r("pct"))


_MANY = {
    "one_value": "'all'",
    "status": "CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END",
    "levels_19": "CASE WHEN o_orderkey % 2 = 0 THEN 'most' ELSE cast(o_orderkey % 18 AS STRING) END",
    "levels_20": "CASE WHEN o_orderkey % 2 = 0 THEN 'most' ELSE cast(o_orderkey % 19 AS STRING) END",
    "quarters": "cast(o_orderkey % 5 AS STRING)",
    "thirds": "cast(o_orderkey % 3 AS STRING)",
    "halves": "CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END",
    "mostly_null": "CASE WHEN o_orderkey % 4 = 0 THEN 'seen' END",
    "priority": "CASE WHEN o_orderkey % 3 = 0 THEN 'low' ELSE o_orderpriority END",
    "late": "CASE WHEN o_orderkey % 7 < 4 THEN 'first' ELSE 'last' END",
    "later": "CASE WHEN o_orderkey % 7 < 3 THEN 'first' ELSE 'last' END",
}


@query(
    "WITH v AS ("
    + " UNION ALL ".join(f"SELECT o_custkey % 4 AS cluster, {i} AS place, '{c}' AS \"column\", {e} AS value FROM orders" for i, (c, e) in enumerate(_MANY.items()))
    + """), c AS (SELECT cluster, place, "column", value, count(*) AS n FROM v WHERE cluster <> 0 GROUP BY ALL),
    s AS (SELECT cluster, place, sum(n) AS size FROM c GROUP BY ALL),
    r AS (SELECT c.*, size, row_number() OVER (PARTITION BY cluster, place ORDER BY n DESC, value) AS rank, count(*) OVER (PARTITION BY cluster, place) AS levels
        FROM c JOIN s USING (cluster, place) WHERE value IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY place) AS nth FROM r WHERE rank = 1 AND levels < 20 AND n > size * 0.25)
    SELECT cluster, "column", value, n, round(n * 100.0 / size, 6) AS pct FROM f WHERE nth <= 6"""
)
def cluster_top_limits(spark, sf_dir):
    """Dominant values where every limit bites: columns of 19 and 20 levels, shares about a quarter, nulls, more than six columns."""
    rows = _table(spark, sf_dir, "orders").select((F.col("o_custkey") % 4).alias("cluster"), *[F.expr(e).alias(c) for c, e in _MANY.items()])
    return clusters.top_values(rows, "cluster").withColumn("pct", _r("pct"))


@query(
    " UNION ALL ".join(
        f"SELECT l_linenumber % 4 AS cluster, '{c}' AS \"column\", round(avg({c}), 4) AS mean_value, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value FROM lineitem WHERE l_linenumber % 4 <> 0 GROUP BY 1"
        for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    )
)
def cluster_first_numbers(spark, sf_dir):
    """Statistics of the first four of eight numeric columns."""
    rows = _table(spark, sf_dir, "lineitem").withColumn("cluster", F.col("l_linenumber") % 4)
    return clusters.numeric_stats(rows, "cluster").withColumn("mean_value", _r("mean_value", 4))


@query(
    " UNION ALL ".join(
        f"SELECT c_nationkey % 5 AS cluster, '{c}' AS \"column\", round(avg({c}), 4) AS mean_value, min({c})::DOUBLE AS min_value, max({c})::DOUBLE AS max_value FROM customer WHERE c_nationkey % 5 <> 0 GROUP BY 1"
        for c in ("c_custkey", "c_nationkey", "c_acctbal")
    )
)
def cluster_numeric_stats(spark, sf_dir):
    rows = _table(spark, sf_dir, "customer").withColumn("cluster", F.col("c_nationkey") % 5)
    return clusters.numeric_stats(rows, "cluster", ["c_custkey", "c_nationkey", "c_acctbal"]).withColumn("mean_value", _r("mean_value", 4))


# ---- quality ---------------------------------------------------------------------------------------------------------

_Q = """q AS MATERIALIZED (SELECT vec_id AS id, label AS c, embedding::DOUBLE[] AS x FROM embeddings WHERE label <> 0)"""
_FLAT = _Q + ", f AS (SELECT id, c, generate_subscripts(x, 1) AS d, unnest(x) AS v FROM q), m AS MATERIALIZED (SELECT c, d, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM f GROUP BY 1, 2)"


def _quality_rows(spark, sf_dir) -> DataFrame:
    return _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("_row_id"), F.col("embedding").alias("features"), F.col("label").alias("cluster"))


@query(
    _with(
        _Q,
        """, p AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM q a CROSS JOIN q b GROUP BY 1, 2, 3),
        s AS (SELECT id, max(CASE WHEN o = c AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN o <> c THEN t / n END) AS b FROM p GROUP BY 1)
        SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 6) AS silhouette FROM s""",
    )
)
def quality_silhouette(spark, sf_dir):
    return metrics.silhouette(_quality_rows(spark, sf_dir)).select(_r("silhouette").alias("silhouette"))


@query(
    _with(
        _FLAT,
        """, g AS (SELECT d, avg(v) AS g FROM f GROUP BY 1), z AS (SELECT sum(n * (mean - g) ** 2) AS b, sum(n * var) AS w, count(DISTINCT c) AS k FROM m JOIN g USING (d))
        SELECT round((b / (k - 1)) / (w / ((SELECT count(*) FROM q) - k)), 6) AS calinski_harabasz FROM z""",
    )
)
def quality_ch(spark, sf_dir):
    return metrics.calinski_harabasz(_quality_rows(spark, sf_dir)).select(_r("calinski_harabasz").alias("calinski_harabasz"))


@query(
    _with(
        _FLAT,
        """, k AS (SELECT c, list(mean ORDER BY d) AS centre FROM m GROUP BY 1), s AS (SELECT q.c, k.centre, avg(list_distance(q.x, k.centre)) AS s FROM q JOIN k USING (c) GROUP BY 1, 2)
        SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT a.c, max((a.s + b.s) / list_distance(a.centre, b.centre)) AS w FROM s a JOIN s b ON a.c <> b.c GROUP BY 1)""",
    )
)
def quality_db(spark, sf_dir):
    return metrics.davies_bouldin(_quality_rows(spark, sf_dir)).select(_r("davies_bouldin").alias("davies_bouldin"))


@query(
    """WITH b AS (SELECT k, count(e.label) AS n FROM range((SELECT max(label) + 1 FROM embeddings)) t(k) LEFT JOIN embeddings e ON e.label = k AND e.label <> 0 GROUP BY 1),
    c AS (SELECT stddev_pop(n) / avg(n) AS cv FROM b) SELECT round(cv, 6) AS imbalance, round(1 / (1 + cv), 6) AS balance FROM c"""
)
def quality_balance(spark, sf_dir):
    return metrics.balance(_labels(spark, sf_dir)).select(_r("imbalance").alias("imbalance"), _r("balance").alias("balance"))


@query("SELECT k::INT AS bin, count(e.label) AS n FROM range((SELECT max(label) + 1 FROM embeddings)) t(k) LEFT JOIN embeddings e ON e.label = k AND e.label <> 0 GROUP BY 1")
def quality_bins(spark, sf_dir):
    return metrics.bin_counts(_labels(spark, sf_dir))


@query(_with(_BMU, "SELECT round(avg(a), 6) AS som_quality FROM (SELECT avg(u.d1) AS a FROM units u JOIN embeddings e ON e.vec_id = u._row_id WHERE e.label <> 0 GROUP BY e.label)"))
def quality_som(spark, sf_dir):
    return metrics.som_quality(_units(spark, sf_dir), _labels(spark, sf_dir)).select(_r("som_quality").alias("som_quality"))


@query("SELECT * FROM " + ", ".join(f"({ORACLES[q]})" for q in ("quality_silhouette", "quality_ch", "quality_db", "quality_balance", "quality_som")))
def quality_all(spark, sf_dir):
    """All measures by the one call."""
    got = metrics.comprehensive(_quality_rows(spark, sf_dir), _units(spark, sf_dir))
    names = ["silhouette", "calinski_harabasz", "davies_bouldin", "imbalance", "balance", "som_quality"]
    return spark.createDataFrame([tuple(round(got[n], 6) for n in names)], ", ".join(f"{n} double" for n in names))


_WORDS = "CASE WHEN {0} > 0.7 THEN 'strong' WHEN {0} > 0.5 THEN 'reasonable' WHEN {0} > 0.25 THEN 'weak' ELSE 'none' END AS separation, CASE WHEN {1} > 0.7 THEN 'balanced' WHEN {1} > 0.5 THEN 'moderate' ELSE 'unbalanced' END AS evenness"


@query(f"SELECT *, {_WORDS.format('silhouette', 'balance')} FROM (SELECT silhouette, balance FROM ({ORACLES['quality_silhouette']}), ({ORACLES['quality_balance']}))")
def quality_interpret(spark, sf_dir):
    """What the measures of a clustering say, in words."""
    rows = _quality_rows(spark, sf_dir)
    s, b = metrics.silhouette(rows).first()[0], metrics.balance(_labels(spark, sf_dir)).first()["balance"]
    return metrics.interpret(round(s, 6), round(b, 6), spark)


@query(f"SELECT * FROM ({ORACLES['quality_ch']}), ({ORACLES['quality_db']})")
def sink_metrics(spark, sf_dir):
    """Measures written as JSON and read back."""
    path, rows = _place(spark, "metrics"), _quality_rows(spark, sf_dir)
    writers.write_metrics(spark, metrics.calinski_harabasz(rows).first().asDict() | metrics.davies_bouldin(rows).first().asDict(), path)
    back = writers.read_json(spark, path)
    return spark.createDataFrame([(round(back["calinski_harabasz"], 6), round(back["davies_bouldin"], 6))], "calinski_harabasz double, davies_bouldin double")


@query(
    """SELECT event_id, v AS value, CASE WHEN v > 0.7 THEN 'strong' WHEN v > 0.5 THEN 'reasonable' WHEN v > 0.25 THEN 'weak' ELSE 'none' END AS separation,
    CASE WHEN v > 0.7 THEN 'balanced' WHEN v > 0.5 THEN 'moderate' ELSE 'unbalanced' END AS evenness FROM (SELECT event_id, (user_id % 41 - 20) / 20.0::DOUBLE AS v FROM events)"""
)
def quality_labels(spark, sf_dir):
    """Words for a value of each event, from -1 to 1, with all limits among them."""
    v = _table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 41 - 20) / 20.0).alias("value"))
    return v.select("event_id", "value", scalar.silhouette_label(F.col("value")).alias("separation"), scalar.balance_label(F.col("value")).alias("evenness"))


# ---- search ----------------------------------------------------------------------------------------------------------


@query("SELECT * FROM (SELECT DISTINCT p_size AS som_x FROM part WHERE p_size <= 4), (SELECT DISTINCT l_linenumber AS som_y FROM lineitem), (SELECT DISTINCT l_tax AS sigma FROM lineitem), (SELECT DISTINCT l_discount AS learning_rate FROM lineitem)")
def tune_grid(spark, sf_dir):
    """All combinations of the values that columns hold."""
    part, lines = _table(spark, sf_dir, "part"), _table(spark, sf_dir, "lineitem")
    values = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  some tens
    return tune.grid_frame(
        spark, {"som_x": values(part.where("p_size <= 4"), "p_size"), "som_y": values(lines, "l_linenumber"), "sigma": values(lines, "l_tax"), "learning_rate": values(lines, "l_discount")}
    ).select(F.col("som_x").cast("int").alias("som_x"), F.col("som_y").cast("int").alias("som_y"), "sigma", "learning_rate")


@query(
    """SELECT l_orderkey, l_linenumber, round(0.4::DOUBLE / (1 + l_quantity) + 0.3::DOUBLE / (1 + l_tax) + 0.3::DOUBLE * (l_discount * 20 - 1), 6) AS score FROM lineitem"""
)
def tune_score(spark, sf_dir):
    """The composite score of a row's quantity as quantization error, tax as topographic error, and discount as silhouette."""
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", _r(tune.composite(F.col("l_quantity"), F.col("l_tax"), F.col("l_discount") * 20 - 1)).alias("score"))


_SEARCHED = {"som_x": [3], "som_y": [3, 4], "sigma": [0.8, 1.0], "learning_rate": [0.3], "iterations": [100]}


@query(
    f"""WITH RECURSIVE {_EMBEDDED}, maps AS (SELECT (row_number() OVER (ORDER BY y, sigma) - 1)::INT AS o, 3 AS x, y, sigma, 0.3::DOUBLE AS rate, 100 AS n FROM (VALUES (3), (4)) a(y) CROSS JOIN (VALUES (0.8::DOUBLE), (1.0::DOUBLE)) b(sigma) ORDER BY y, sigma LIMIT 3),
    {_online("maps")},
    d AS (SELECT o, vec_id, list_transform(cb, lambda w: list_distance(embedding::DOUBLE[], w)) AS d FROM fin CROSS JOIN embeddings),
    u AS MATERIALIZED (SELECT o, y, vec_id, list_min(d) AS d1, list_position(d, list_min(d)) - 1 AS k1, list_position(d, list_sort(d)[2]) - 1 AS k2 FROM d JOIN maps USING (o)),
    e AS (SELECT o, avg(d1) AS q, avg(CASE WHEN greatest(abs(k1 // y - k2 // y), abs(k1 % y - k2 % y)) > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS t FROM u GROUP BY 1),
    hits AS (SELECT o, y, k1 AS k, count(*) AS n FROM u GROUP BY ALL),
    mask AS MATERIALIZED (SELECT o, y, k FROM hits QUALIFY n / max(n) OVER (PARTITION BY o) > {pipeline.CANONICAL.density_threshold}),
    reach(o, k, root) AS (SELECT o, k, k FROM mask UNION SELECT m.o, m.k, r.root FROM reach r JOIN mask s ON s.o = r.o AND s.k = r.k JOIN mask m ON m.o = s.o AND abs(m.k // m.y - s.k // s.y) + abs(m.k % m.y - s.k % s.y) = 1),
    roots AS (SELECT o, k, min(root) AS c FROM reach GROUP BY 1, 2),
    l AS MATERIALIZED (SELECT u.o, u.vec_id, c, embedding::DOUBLE[] AS v FROM u JOIN roots r ON r.o = u.o AND r.k = u.k1 JOIN embeddings USING (vec_id)),
    p AS (SELECT a.o, a.vec_id, a.c, b.c AS other, sum(list_distance(a.v, b.v)) AS total, count(*) AS n FROM l a JOIN l b USING (o) GROUP BY ALL),
    s AS (SELECT o, vec_id, max(CASE WHEN other = c AND n > 1 THEN total / (n - 1) END) AS a, min(CASE WHEN other <> c THEN total / n END) AS b FROM p GROUP BY 1, 2),
    z AS (SELECT o, avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END) AS s FROM s GROUP BY 1)
    SELECT o AS ordinal, y AS som_y, sigma, round(q, 6) AS q_error, round(t, 6) AS t_error, round(0.4::DOUBLE / (1 + q) + 0.3::DOUBLE / (1 + t) + 0.3::DOUBLE * coalesce(z.s, 0), 6) AS score FROM e JOIN maps USING (o) LEFT JOIN z USING (o)"""
)
def tune_search(spark, sf_dir):
    """Three of four combinations, scored."""
    history = tune.history_frame(spark, tune.search(_rows(spark, sf_dir), _SEARCHED, 3)[1])
    return history.select("ordinal", F.col("params")["som_y"].cast("int").alias("som_y"), F.col("params")["sigma"].alias("sigma"), *[_r(c).alias(c) for c in ("q_error", "t_error", "score")])


@query(f"SELECT arg_max(som_y, (score, -ordinal)) AS som_y, arg_max(sigma, (score, -ordinal)) AS sigma, max(score) AS score FROM ({ORACLES['tune_search']})")
def tune_best(spark, sf_dir):
    """The search resumed from its own history: a budget of one, then of three; the best of it."""
    path, rows = _place(spark, "history"), _rows(spark, sf_dir)
    tune.search(rows, _SEARCHED, 1, history_path=path)
    found = tune.best(tune.history_frame(spark, tune.search(rows, _SEARCHED, 3, history_path=path)[1]))
    return found.select(F.col("params")["som_y"].cast("int").alias("som_y"), F.col("params")["sigma"].alias("sigma"), _r("score").alias("score"))


# ---- the whole analysis ----------------------------------------------------------------------------------------------


def incidents(spark, sf_dir) -> DataFrame:
    """The events in the shape of an incident table."""
    e = _table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("_row_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("DATA_OCORRENCIA"),
        F.date_format("ts", "HH:mm").alias("HORA_OCORRENCIA"),
        (F.col("value") % 90).cast("string").alias("LATITUDE"),
        (F.col("user_id") % 180).cast("string").alias("LONGITUDE"),
        (F.col("user_id") % 95).cast("string").alias("IDADE_PESSOA"),
        F.col("event_type").alias("NATUREZA_APURADA"),
        F.concat(F.lit("C"), F.col("user_id") % 30).alias("CIDADE"),
    )


_Z = "({0} - avg({0}) OVER ()) / coalesce(nullif(stddev_pop({0}) OVER (), 0), 1)"
_TEXTS = ("dia", "mes", "per", "fx", "nat", "cid")

#: The analysis step by step: features, capped levels, scaled and one-hot vectors, training, units, cells, pruned labels.
_ANALYSIS = f"""inc AS MATERIALIZED (SELECT event_id AS id, year(ts)::DOUBLE AS ano, hour(ts)::DOUBLE AS hora, value % 90 AS lat, (user_id % 180)::DOUBLE AS lon, (user_id % 95)::DOUBLE AS idade,
      dayname(ts) AS dia, monthname(ts) AS mes, event_type AS nat, 'C' || (user_id % 30) AS raw_cid FROM events),
    often AS (SELECT raw_cid, row_number() OVER (ORDER BY count(*) DESC, raw_cid) AS r, count(*) OVER () AS levels FROM inc GROUP BY 1),
    cat AS MATERIALIZED (SELECT inc.*, {_case("hora", PERIODS)} AS per, {_case("idade", AGES)} AS fx, CASE WHEN levels <= 20 OR r <= 15 THEN raw_cid ELSE '{OTHER}' END AS cid FROM inc JOIN often USING (raw_cid)),
    lv AS (SELECT {", ".join(f"list(DISTINCT {c} ORDER BY {c}) AS {c}_levels" for c in _TEXTS)} FROM cat),
    z AS (SELECT *, [{", ".join(_Z.format(c) for c in ("ano", "hora", "lat", "lon", "idade"))}] AS numbers FROM cat),
    rows AS MATERIALIZED (SELECT id, list_transform({"list_concat(" * len(_TEXTS)}numbers{"".join(f", list_transform({c}_levels, lambda l: (l = {c})::INT::DOUBLE))" for c in _TEXTS)}, lambda a: a::FLOAT::DOUBLE) AS v FROM z, lv),
    maps AS (SELECT 0 AS o, 6 AS x, 6 AS y, 1.0::DOUBLE AS sigma, 0.5::DOUBLE AS rate, 300 AS n), {_online("maps")},
    dist AS (SELECT id, list_transform(cb, lambda w: list_distance(v, w)) AS d FROM rows CROSS JOIN fin),
    u AS MATERIALIZED (SELECT id, list_min(d) AS d1, list_position(d, list_min(d)) - 1 AS k FROM dist),
    hits AS (SELECT k, count(*) AS n FROM u GROUP BY 1),
    mask AS MATERIALIZED (SELECT k FROM hits WHERE n / (SELECT max(n) FROM hits) > {LEGACY.density_threshold}),
    reach(k, root) AS (SELECT k, k FROM mask UNION SELECT m.k, r.root FROM reach r JOIN mask s ON s.k = r.k JOIN mask m ON abs(m.k // 6 - s.k // 6) + abs(m.k % 6 - s.k % 6) = 1),
    roots AS (SELECT k, dense_rank() OVER (ORDER BY min(root)) AS c FROM reach GROUP BY k),
    big AS (SELECT c FROM (SELECT c, sum(n) AS n FROM roots JOIN hits USING (k) GROUP BY 1) WHERE n >= floor((SELECT sum(n) FROM hits) * {LEGACY.default_ratio}) ORDER BY n DESC, c LIMIT 12),
    lab AS MATERIALIZED (SELECT id, d1, coalesce(big.c, 0)::INT AS c FROM u LEFT JOIN roots USING (k) LEFT JOIN big ON big.c = roots.c)"""


def _analysis(spark, sf_dir, measure: bool) -> dict:
    return pipeline.cluster_rows(incidents(spark, sf_dir), LEGACY, map_size=6, iterations=300, measure=measure)


@query(f"WITH RECURSIVE {_ANALYSIS} SELECT id AS _row_id, nat AS NATUREZA_APURADA, raw_cid AS CIDADE, c AS CLUSTER_SOM FROM lab JOIN inc USING (id)")
def pipeline_end_to_end(spark, sf_dir):
    """Labelled rows: features, encoding, training, units, cells, pruned clusters."""
    got = _analysis(spark, sf_dir, False)
    pipeline.release(got)
    return got["rows"].select("_row_id", "NATUREZA_APURADA", "CIDADE", "CLUSTER_SOM")


@query(
    f"""WITH RECURSIVE {_ANALYSIS}, q AS MATERIALIZED (SELECT id, c, d1, v AS x FROM lab JOIN rows USING (id) WHERE c <> 0),
    p AS (SELECT a.id, a.c, b.c AS o, sum(list_distance(a.x, b.x)) AS t, count(*) AS n FROM q a CROSS JOIN q b GROUP BY 1, 2, 3),
    s AS (SELECT id, max(CASE WHEN o = c AND n > 1 THEN t / (n - 1) END) AS a, min(CASE WHEN o <> c THEN t / n END) AS b FROM p GROUP BY 1),
    f AS (SELECT id, c, generate_subscripts(x, 1) AS d, unnest(x) AS v FROM q), m AS MATERIALIZED (SELECT c, d, count(*) AS n, avg(v) AS mean, var_pop(v) AS var FROM f GROUP BY 1, 2),
    g AS (SELECT d, avg(v) AS g FROM f GROUP BY 1), h AS (SELECT sum(n * (mean - g) ** 2) AS b, sum(n * var) AS w, count(DISTINCT c) AS k FROM m JOIN g USING (d)),
    e AS (SELECT c, list(mean ORDER BY d) AS centre FROM m GROUP BY 1), sp AS (SELECT q.c, e.centre, avg(list_distance(q.x, e.centre)) AS s FROM q JOIN e USING (c) GROUP BY 1, 2),
    bins AS (SELECT k, count(q.c) AS n FROM range((SELECT max(c) + 1 FROM q)) t(k) LEFT JOIN q ON q.c = k GROUP BY 1)
    SELECT (SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END), 5) FROM s) AS silhouette,
      (SELECT round((b / (k - 1)) / (w / ((SELECT count(*) FROM q) - k)), 4) FROM h) AS calinski_harabasz,
      (SELECT round(avg(w), 5) FROM (SELECT a.c, max((a.s + b.s) / list_distance(a.centre, b.centre)) AS w FROM sp a JOIN sp b ON a.c <> b.c GROUP BY 1)) AS davies_bouldin,
      (SELECT round(1 / (1 + stddev_pop(n) / avg(n)), 6) FROM bins) AS balance, (SELECT round(avg(a), 5) FROM (SELECT avg(d1) AS a FROM q GROUP BY c)) AS som_quality"""
)
def pipeline_metrics(spark, sf_dir):
    """All measures of the whole analysis, the silhouette over all clustered rows."""
    got = _analysis(spark, sf_dir, True)
    pipeline.release(got)
    places = {"silhouette": 5, "calinski_harabasz": 4, "davies_bouldin": 5, "balance": 6, "som_quality": 5}
    return spark.createDataFrame([tuple(round(got["metrics"][n], k) if n in got["metrics"] else None for n, k in places.items())], ", ".join(f"{n} double" for n in places))
