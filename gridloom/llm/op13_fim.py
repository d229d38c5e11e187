r"""Fill-in-middle transformation by lookaround splitting. DataFrame functions only.

A unit grammar names character classes whose runs are one unit each; any other character is a unit by itself. It is
translated to a regular expression of zero width that matches between two neighbouring characters of different units, so
Spark's split at it keeps every piece and the pieces joined are the text. Two hashes of the document's id cut the pieces
into prefix, middle and suffix; further hashes choose the form. An empty text has no unit (split gives one empty piece),
so its count is set apart.

Null text: empty, form plain. Null doc_id: hashed as the empty string. Texts that hold one of the markers stay plain, so
that each marker stands once in every other output and `restore` needs the output and the form alone. Repeated rows and
ids: one output each, equal ids are cut by equal hashes. Very long texts: whole, as one array of pieces. Characters
outside the basic plane are one unit and one character. Empty table: no rows. Extra columns are kept by `transform`
(its own have underscores behind their names where the table has such a column) and ignored by the query.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import fresh

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKER = "<[PSM]>"
#: Per cent of documents that are transformed, and of those the per cent that have the suffix first.
RATE, SPM_RATE = 90, 20
SEED = 1


@dataclass(frozen=True)
class Grammar:
    """Units of a text: runs of each class (insides of a bracket expression, disjoint), and other characters singly."""

    runs: tuple[str, ...]

    @property
    def boundary(self) -> str:
        """Zero-width pattern between two units: behind a single character, or between a class and anything else."""
        single = [f"(?<=[^{''.join(self.runs)}])(?=[\\s\\S])"] if self.runs else ["(?<=[\\s\\S])(?=[\\s\\S])"]
        return "|".join([*single, *(f"(?<=[{r}])(?=[^{r}])" for r in self.runs)])


#: `[A-Za-z]+|[^A-Za-z]`
TOKENS = Grammar(("A-Za-z",))
#: Words, runs of white space, and punctuation singly.
WORDS = Grammar(("A-Za-z0-9_\\x{80}-\\x{10FFFF}", "\\x20\\x09-\\x0D"))
#: Runs between line breaks, and each line break.
LINES = Grammar(("\\x00-\\x09\\x0B-\\x{10FFFF}",))
CHARACTERS = Grammar(())


def pieces(text: Column, grammar: Grammar = TOKENS) -> Column:
    """The units of a text, in order; none for an empty or null one."""
    whole = F.coalesce(text, F.lit(""))
    return F.when(whole == "", F.array().cast("array<string>")).otherwise(F.split(whole, grammar.boundary, -1))


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four numbers under 2 ** 32 from the id's hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def arranged(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    """The output of a form."""
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restore(output: Column, form: Column) -> Column:
    """The text, from the output and its form: each marker stands once, so a split at markers gives the three parts."""
    parts = F.split(output, MARKER, -1)
    at = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def transform(docs: DataFrame, grammar: Grammar = TOKENS, rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """`docs` with n (units), form, prefix, middle, suffix (null where plain) and output; a projection, no shuffle."""
    names = {}
    for c in ("n", "form", "prefix", "middle", "suffix", "output", "units", "first", "second", "third", "fourth"):
        names[c] = fresh(docs, c)
    col = {k: F.col(f"`{v}`") for k, v in names.items()}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.withColumns(dict(zip((names[c] for c in ("first", "second", "third", "fourth")), draws(F.col("doc_id"), seed), strict=True)))
    rows = rows.withColumn(names["units"], pieces(F.col("text"), grammar)).withColumn(names["n"], F.size(col["units"]).cast("long"))
    kept = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE)) | (col["third"] % 100 >= rate)
    rows = rows.withColumn(names["form"], F.when(kept, "plain").when(col["fourth"] % 100 < spm_rate, "spm").otherwise("psm"))
    cut = [col[c] % (col["n"] + 1) for c in ("first", "second")]
    rows = rows.withColumns({names["first"]: F.least(*cut).cast("int"), names["second"]: F.greatest(*cut).cast("int")})

    def part(start: Column, length: Column) -> Column:
        return F.when(col["form"] != "plain", F.array_join(F.slice(col["units"], start, length), ""))

    a, b = col["first"], col["second"]
    rows = rows.withColumns({names["prefix"]: part(F.lit(1), a), names["middle"]: part(a + 1, b - a), names["suffix"]: part(b + 1, F.size(col["units"]) - b)})
    rows = rows.withColumn(names["output"], arranged(col["form"], text, col["prefix"], col["middle"], col["suffix"]))
    return rows.drop(*(names[c] for c in ("units", "first", "second", "third", "fourth")))


def query(spark, sf_dir: str) -> DataFrame:
    rows = transform(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        "doc_id",
        "n",
        "form",
        F.char_length("prefix").cast("long").alias("prefix_chars"),
        F.char_length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The units by the grammar itself, not by its boundaries.
ORACLE = f"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT *, len(u) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM u),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS x FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || x || '{MIDDLE}' || m WHEN 'spm' THEN '{SUFFIX}' || x || '{PREFIX}' || p || '{MIDDLE}' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
