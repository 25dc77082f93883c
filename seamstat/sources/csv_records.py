"""CSV files read by many tasks although quoted fields hold line breaks.

Spark's text reader cuts a file into splits of whole lines. Whether a line begins inside a quoted field
depends on all lines before it, but only by one bit, so every split first tells how it would end from
either beginning. Following these answers in order of the splits gives each its true beginning. In the
second pass a split puts its lines together to records; parts of a record that spans splits are joined by
the split in which it began.

A field is quoted if it begins with a quote; two quotes inside stand for one. Text after a closing quote,
or a quote inside an unquoted field, is ordinary text up to the next separator. A line feed ends a line; in
files whose first line ends with a carriage return as well, that return is left out of all of them.

Files are only read by Spark's own reader, from any store it knows. What the driver keeps is one entry
for each split, of a list which it holds anyway.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamstat.sources.scratch import stored

QUOTING = {"quote": '"', "escape": '"'}
_QUOTED = re.compile('[^"]*(?:""[^"]*)*')

Split = tuple[str, int]


def ends_inside(line: str, inside: bool, separator: str = ",") -> bool:
    """Whether a quoted field is open at the end of a line that begins inside one or with a record."""
    at, size = 0, len(line)
    while True:
        if inside or line.startswith('"', at):
            end = _QUOTED.match(line, at if inside else at + 1).end()
            if end == size:
                return True
            inside, at = False, end + 1
        at = line.find(separator, at)
        if at < 0:
            return False
        at += len(separator)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Split, bool, list[str], bool]]:
    """(split, whether it goes on from the batch before, lines, whether any holds a quote) in the order of the file."""
    last = None
    for batch in batches:
        paths, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        quoted = pc.match_substring(batch.column(0), '"').to_pylist()
        first = 0
        for i in range(1, batch.num_rows + 1):
            if i == batch.num_rows or (paths[i], starts[i]) != (paths[first], starts[first]):
                split = paths[first], starts[first]
                yield split, split == last, batch.column(0).slice(first, i - first).to_pylist(), any(quoted[first:i])
                last, first = split, i


def split_ends(lines: DataFrame, separator: str = ",") -> DataFrame:
    """(path, start, from_outside, from_inside, begins, windows) of each split.

    The first two tell whether it ends inside a field, from either beginning; the next, whether a
    record begins in it if it begins inside one; the last, whether its first line ends with a carriage
    return, which decides for the file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, state, windows = None, (False, True, False), False

        def told() -> pa.RecordBatch:
            values = [*split, *state, windows]
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], ["path", "start", "from_outside", "from_inside", "begins", "windows"])

        for here, goes_on, content, quoted in _runs(batches):
            if not goes_on:
                if split:
                    yield told()
                split, state, windows = here, (False, True, False), content[0].endswith("\r")
            outside, inside, begins = state
            for line in content:
                begins = begins or not inside
                if quoted and '"' in line:
                    outside, inside = ends_inside(line, outside, separator), ends_inside(line, inside, separator)
            state = outside, inside, begins
        if split:
            yield told()

    return lines.mapInArrow(run, "path string, start bigint, from_outside boolean, from_inside boolean, begins boolean, windows boolean")


def open_splits(ends: list[tuple[str, int, bool, bool, bool]]) -> dict[Split, int]:
    """The splits that begin inside a field, with the start of the split in which that record began."""
    found: dict[Split, int] = {}
    last, inside, owner = None, False, 0
    for path, start, from_outside, from_inside, begins in sorted(ends):
        if path != last:
            last, inside, owner = path, False, start
        if inside:
            found[path, start] = owner
        if not inside or begins:
            owner = start
        inside = from_inside if inside else from_outside
    return found


def records(lines: DataFrame, begun: dict[Split, int], windows: set[str], header: list[str | None], separator: str = ",") -> DataFrame:
    """(record, path, owner, start): whole records, and parts with the split in which the record began.

    The header of each file is compared with the given one and left out. ``windows`` holds the files whose
    lines end with a carriage return, which does not belong to them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, owner, part, titled = None, None, [], False  # what is open at the end of the lines so far

        def rows(whole: list[str], pieces: list[tuple[str, int]]) -> pa.RecordBatch:
            texts = whole + [text for text, _ in pieces]
            path, start = (split or (None, None)) if pieces else (None, None)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(texts, pa.string()),
                    pa.array([None] * len(whole) + [path] * len(pieces), pa.string()),
                    pa.array([None] * len(whole) + [of for _, of in pieces], pa.int64()),
                    pa.array([None] * len(whole) + [start] * len(pieces), pa.int64()),
                ],
                ["record", "path", "owner", "start"],
            )

        for here, goes_on, content, quoted in _runs(batches):
            if not goes_on:
                if part:
                    yield rows([], [("\n".join(part), split[1] if owner is None else owner)])
                split, owner, part, titled = here, begun.get(here), [], here[1] == 0
            if here[0] in windows:
                content = [line.removesuffix("\r") for line in content]
            whole: list[str] = []
            pieces: list[tuple[str, int]] = []
            inside = bool(part) or owner is not None
            if not (quoted or inside or titled):
                whole = [line for line in content if line]
            else:
                for line in content:
                    inside = ends_inside(line, inside, separator) if '"' in line else inside
                    part.append(line)
                    if inside:
                        continue
                    text, part = "\n".join(part), []
                    if owner is not None:
                        pieces.append((text, owner))
                        owner = None
                    elif titled and text:
                        titled = False
                        _check_header(text, header, separator, split[0])
                    elif text:
                        whole.append(text)
            yield rows(whole, pieces)
        if part:
            yield rows([], [("\n".join(part), split[1] if owner is None else owner)])

    return lines.mapInArrow(run, "record string, path string, owner bigint, start bigint")


def _check_header(text: str, header: list[str | None], separator: str, path: str) -> None:
    found = next(csv.reader([text.removeprefix("﻿")], delimiter=separator, strict=False))
    if found != [name or "" for name in header]:
        raise ValueError(f"the header of {path} is {found}, not {header}")


def read_csv_records(spark: SparkSession, path: str | list[str], separator: str = ",") -> DataFrame:
    """Every field as text, named by the header, as Spark's CSV source reads them with ``multiLine``.

    Empty lines are left out. Files whose header differs from that of the first are an error.
    """
    options = QUOTING | {"sep": separator}
    whole = spark.read.options(**options, multiLine=True)
    columns = whole.options(header=True).csv(path).columns
    first = spark.read.options(**options, multiLine=True, header=False).csv(path).first()
    if first is None:
        return whole.options(header=True).csv(path)
    ddl = ", ".join(f"`{name.replace('`', '``')}` string" for name in columns)
    lines = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_block_start")
    ends = split_ends(lines, separator).collect()  # one row a split
    begun = open_splits([tuple(row)[:5] for row in ends])
    windows = {row["path"] for row in ends if row["windows"] and row["start"] == 0}
    found = records(lines, begun, windows, list(first), separator)
    every = found.where("owner IS NULL").select("record")
    if begun:
        parts = found.where("owner IS NOT NULL").groupBy("path", "owner")
        joined = parts.agg(F.sort_array(F.collect_list(F.struct("start", "record"))).alias("parts"))
        texts = F.array_join(F.transform("parts", lambda p: p["record"]), "\n")
        every = every.unionByName(stored(joined.select(texts.alias("record")), "spanning-records"))
    return every.select(F.from_csv("record", ddl, options | {"mode": "PERMISSIVE"}).alias("fields")).select("fields.*")
