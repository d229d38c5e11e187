"""Delimited text cut into records in parallel, whatever line breaks and stray quotes its fields hold.

A line can start in one of two states: outside quotes, or inside a quoted field that an earlier line opened. Where a split
of a file ends is a function of the state it starts in, so the first pass finds for each split, for both states, the end
state and how many records start there; put together along the file these give every split its true start and the number
of its first record. The second pass cuts the splits side by side; only records that run over a split's end are joined by
a shuffle. Records are numbered as they stand in the file (files by name), so a row's number doesn't depend on the splits.

A quote opens a field only at the field's start; elsewhere it is a character. A quote in a quoted field is doubled. Lines
end with LF or CRLF; blank lines between records are left out. A byte order mark is dropped. Every file has the header.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "﻿"
OUT, IN = 0, 1


class Lines:
    """End states of lines by their start state. Possessive patterns: no line is read twice, none nests a call a field."""

    def __init__(self, sep: str):
        s = re.escape(sep.encode())
        closing = rb'[^"]*+(?:""[^"]*+)*+"[^' + s + rb"]*+"  # the rest of a quoted field and what follows it
        field = rb'(?>"' + closing + rb"|[^" + s + rb'"][^' + s + rb']*+|(?!"))'
        fields = rb"(?:" + field + s + rb")*+" + field
        self.closed = re.compile(fields)
        self.closes = re.compile(closing + rb"(?:" + s + fields + rb")?")

    def ends(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(state after a line that starts outside, after one that starts inside); lines without a quote keep theirs."""
        out, in_ = np.full(len(values), OUT, np.int8), np.full(len(values), IN, np.int8)
        at = np.nonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))[0]
        for i, line in zip(at, values.take(pa.array(at, pa.int64())).to_pylist(), strict=True):
            out[i] = OUT if self.closed.fullmatch(line) else IN
            in_[i] = OUT if self.closes.fullmatch(line) else IN
        return out, in_


def before(out: np.ndarray, in_: np.ndarray, start: int) -> np.ndarray:
    """State before each line and after the last; only lines that may change it are gone through."""
    states, now, done = np.empty(len(out) + 1, np.int8), start, 0
    for i in np.nonzero((out != OUT) | (in_ != IN))[0]:
        states[done : i + 1] = now
        now, done = int(in_[i] if now else out[i]), i + 1
    states[done:] = now
    return states


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, value): the lines' bytes, with their file and where their split of it begins."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select(F.xxhash64(F.input_file_name()).alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))


def _parts(b: pa.RecordBatch) -> Iterator[tuple[tuple[int, int], pa.Array]]:
    """((file, at), lines) of each split in a batch: a task may read several."""
    if b.num_rows:
        file, at = b["file"].to_numpy(), b["at"].to_numpy()
        cuts = np.nonzero((np.diff(file) != 0) | (np.diff(at) != 0))[0] + 1
        for lo, hi in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
            yield (int(file[lo]), int(at[lo])), b["value"].slice(lo, hi - lo)


def _blank(values: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(values, r"^[\s]*$").to_numpy(zero_copy_only=False)


def _is_utf8(values: pa.Array) -> bool:
    try:
        values.cast(pa.string())
    except pa.ArrowInvalid:
        return False
    return True


@dataclass
class Layout:
    """What the first pass finds of the splits: start state, number of the first record, and headers up to it; and of the text."""

    starts: dict[tuple[int, int], tuple[int, int, int]]
    headers: set[int]
    n_rows: int
    encoding: str
    crossing: bool


def layout(spark: SparkSession, path: str, sep: str = ";") -> Layout:
    """One pass over the bytes; one row for each split reaches the driver."""
    rule = Lines(sep)
    names = ["file", "at", "end_out", "end_in", "n_out", "n_in", "utf8"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, count, utf8 = None, [OUT, IN], [0, 0], True
        told = lambda: pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([*key, *now, *count, utf8], types, strict=True)], names)
        for b in batches:
            for here, values in _parts(b):
                if key != here:
                    if key:
                        yield told()
                    key, now, count, utf8 = here, [OUT, IN], [0, 0], True
                out, in_ = rule.ends(values)
                full = ~_blank(values)
                for k in (OUT, IN):
                    states = before(out, in_, now[k])
                    count[k] += int(((states[:-1] == OUT) & full).sum())
                    now[k] = int(states[-1])
                utf8 = utf8 and _is_utf8(values)
        if key:
            yield told()

    rows = _lines(spark, path)
    found = rows.mapInArrow(ends, "file long, at long, end_out int, end_in int, n_out long, n_in long, utf8 boolean").collect()
    files = sorted(spark.read.text(path).inputFiles())
    order = {r["h"]: r["k"] for r in spark.createDataFrame(list(enumerate(files)), "k long, f string").select("k", F.xxhash64("f").alias("h")).collect()}
    starts, headers, n, crossing, last, state = {}, set(), 0, False, None, OUT
    for r in sorted(found, key=lambda r: (order[r["file"]], r["at"])):
        if r["file"] != last:
            last, state = r["file"], OUT
            headers.add(n)
        starts[r["file"], r["at"]] = state, n, len(headers)
        crossing |= state == IN
        n += r["n_in"] if state else r["n_out"]
        state = r["end_in"] if state else r["end_out"]
    headers = {h for h in headers if h < n}
    return Layout(starts, headers, n - len(headers), "UTF-8" if all(r["utf8"] for r in found) else "ISO-8859-1", crossing)


def _cut(spark: SparkSession, path: str, sep: str, found: Layout, header: bool) -> DataFrame:
    """(id, at, record): rows from 0 on, or the headers by their place among all records; `at` marks pieces of records that lie in several splits."""
    rule, sent = Lines(sep), spark.sparkContext.broadcast(found)
    names = ["id", "at", "record"]

    def one(id_: int, at: int, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([id_], pa.int64()), pa.array([at], pa.int64()), pa.array([b"\n".join(lines)], pa.binary())], names)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, heads = sent.value.starts, sent.value.headers
        key, state, n, passed, held, head = None, OUT, 0, 0, [], False

        def wanted(number: int) -> bool:
            return (number in heads) == header

        shift = 0 if header else 1  # rows are counted without the headers before them

        for b in batches:
            for here, values in _parts(b):
                if key != here:
                    if held and wanted(n - 1):
                        yield one(n - 1 - shift * passed, key[1], held)
                    key, (state, n, passed), held = here, starts[here], []
                    head = state == IN  # its first lines end a record of an earlier split
                states = before(*rule.ends(values), state)
                state = int(states[-1])
                start = (states[:-1] == OUT) & ~_blank(values)
                kept = np.nonzero(start | (states[:-1] == IN))[0]
                first = np.nonzero(start[kept])[0]
                lines = values.take(pa.array(kept, pa.int64()))
                more = first[0] if len(first) else len(kept)
                held += lines.slice(0, more).to_pylist()
                if held and (len(first) or state == OUT):
                    if wanted(n - 1):
                        yield one(n - 1 - shift * passed, key[1] if head else None, held)
                    held, head = [], False
                if len(first):
                    last = first[-1] if state == IN else len(kept)  # the last record goes on
                    whole = first[first < last]
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*whole, last], pa.int32()), lines), b"\n")
                    number = np.arange(n, n + len(whole))
                    keep = np.isin(number, list(heads)) == header if heads else np.full(len(whole), not header)
                    cols = [pa.array(number[keep] - shift * passed), pa.nulls(int(keep.sum()), pa.int64()), joined.filter(pa.array(keep))]
                    yield pa.RecordBatch.from_arrays(cols, names)
                    n += len(first)
                    held = lines.slice(last).to_pylist()
        if held and wanted(n - 1):
            yield one(n - 1 - shift * passed, key[1], held)

    return _lines(spark, path).mapInArrow(records, "id long, at long, record binary")


def _joined(pieces: DataFrame, crossing: bool) -> DataFrame:
    if not crossing:
        return pieces.select("id", "record")
    part = F.array_sort(F.collect_list(F.struct("at", "record")))
    split = pieces.where("at IS NOT NULL").groupBy("id").agg(part.alias("p")).select("id", F.array_join(F.transform("p", lambda x: x["record"].cast("string")), "\n").cast("binary").alias("record"))
    return pieces.where("at IS NULL").select("id", "record").unionByName(split)


def _names(record: str, sep: str, taken: str) -> list[str]:
    """Column names: unnamed ones by their place, repeated ones and the taken one with a number behind."""
    out = [taken]
    for i, name in enumerate(next(csv.reader(io.StringIO(record.removeprefix(BOM)), delimiter=sep))):
        name = name or f"Unnamed: {i}"
        k, unique = 0, name
        while unique in out:
            k, unique = k + 1, f"{name}.{k + 1}"
        out.append(unique)
    return out[1:]


def read_columns(spark: SparkSession, path: str, sep: str = ";", row_id: str = "_row_id") -> tuple[DataFrame, int]:
    """(rows with all columns as text and their number in the file from 0 on, count of rows): UTF-8, or Latin-1 where bytes are not UTF-8."""
    found = layout(spark, path, sep)
    decoded = F.rtrim(F.decode("record", found.encoding), F.lit("\r"))
    heads = _joined(_cut(spark, path, sep, found, True), found.crossing).orderBy("id").limit(1).select(decoded.alias("r")).collect()
    if not heads:
        raise ValueError(f"no header in {path}")
    names = _names(heads[0]["r"], sep, row_id)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    fields = F.from_csv(decoded, schema, {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true"})
    rows = _joined(_cut(spark, path, sep, found, False), found.crossing).select("id", fields.alias("f"))
    return rows.select(*[F.col(f"f.c{i}").alias(c) for i, c in enumerate(names)], F.col("id").alias(row_id)), found.n_rows
