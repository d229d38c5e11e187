"""Column expressions: coercion, calendar parts, hour parsing, bins, threshold labels. All JVM-side, no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.config import AGES, FILL, MISSING_BIN, PERIODS

#: What counts as missing in a text file.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Formats that a date column may have, by a sample value.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss")


def _number_text(c: Column) -> Column:
    """Text of a number without its spaces; not a bare word such as infinity or a typed suffix."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text)


def null_tokens(c: Column) -> Column:
    return F.when(c.isin(*NULL_TOKENS), F.lit(None)).otherwise(c)


def to_number(c: Column) -> Column:
    """Number or null; a decimal comma is not a number."""
    return _number_text(c).try_cast("double")


def to_timestamp(c: Column, fmt: str) -> Column:
    """Time by one format, or null."""
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("timestamp_ntz")


def day_name(c: Column) -> Column:
    return F.date_format(c, "EEEE")


def month_name(c: Column) -> Column:
    return F.date_format(c, "MMMM")


def is_weekend(c: Column) -> Column:
    """Saturday or Sunday; null is no weekend."""
    return F.coalesce(F.weekday(c) >= 5, F.lit(False))


def parse_hour(c: Column) -> Column:
    """Hour from free text: what stands before the first colon (`h` and `.` count as colons), or a run of digits.

    Runs of more than two digits give their first two. Upper-case H is no separator. Anything else is null.
    """
    text = F.trim(c.cast("string"))
    dotted = F.translate(text, "h.", "::")
    whole = lambda x: F.when(F.trim(x).rlike("^[+-]?[0-9]+$"), F.trim(x)).try_cast("int")
    digits = dotted.rlike("^[0-9]+$")
    return F.when(dotted.contains(":"), whole(F.substring_index(dotted, ":", 1))).when(digits, F.substring(dotted, 1, 2).try_cast("int"))


def binned(c: Column, bins: tuple) -> Column:
    """Label of the right-closed bin; outside all bins, or null, the text `nan`."""
    out = F.lit(MISSING_BIN)
    for lo, hi, label in reversed(bins):
        out = F.when((c > lo) & (c <= hi), F.lit(label)).otherwise(out)
    return out


def period_of_day(hour: Column) -> Column:
    return binned(hour, PERIODS)


def age_band(age: Column) -> Column:
    return binned(age, AGES)


def has_coordinates(lat: Column, lon: Column) -> Column:
    return lat.isNotNull() & lon.isNotNull()


def fill_category(c: Column) -> Column:
    return F.coalesce(c, F.lit(FILL))


def narrow_vector(c: Column) -> Column:
    return c.cast("array<float>")


def silhouette_label(s: Column) -> Column:
    return F.when(s > 0.7, "strong").when(s > 0.5, "reasonable").when(s > 0.25, "weak").otherwise("none")


def balance_label(b: Column) -> Column:
    return F.when(b > 0.7, "balanced").when(b > 0.5, "moderate").otherwise("unbalanced")
