"""Loading raw CSV lines: good rows as fields of the mapping, bad lines with the reason.

Each line gets the projection of its file's header (behind a check of the headers' number), and
lines are read where they lie, in bounded blocks of equal column count, however many files they come
from: a block is parsed and checked at once on Arrow's columnar CSV path. Only a block that fails is
halved, again and again, until few lines are left, which a strict reader then diagnoses. No line is
shuffled for it, and neither a file with a third of all lines nor thousands of short files matter.

Defined results: a null line is an empty one; a line of a file without a header line is
`column_count`, since it has no columns to match; repeated rows of one line give one row of output;
an empty table gives an empty one; further columns of the input, whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.functions.headers import FIELDS, fields_of
from fixtura.operators.joins import join_lookup

BLOCK_LINES = 4096
#: Blocks of at most so many lines are diagnosed line by line rather than halved further.
LEAF_LINES = 32
#: Letter of each field in the code of a projection; "-" stands for a column of no field.
_LETTERS = {f: chr(ord("a") + i) for i, f in enumerate(FIELDS)}
_NO_FIELD = "-"

MISSING = ("", "NA", "N/A")
DATE_FORMS = ((r"^\d{2}/\d{2}/\d{4}$", "%d/%m/%Y"), (r"^\d{2}/\d{2}/\d{2}$", "%d/%m/%y"), (r"^\d{4}-\d{2}-\d{2}$", "%Y-%m-%d"))
GOALS = r"^\d+(\.0+)?$"
RESULT = r"^[HDAhda]$"
WELL_QUOTED = r'^(?:[^",]*|"(?:[^"]|"")*")(?:,(?:[^",]*|"(?:[^"]|"")*"))*$'
TRIM = " \t 　"

OUTPUT = T.StructType(
    [T.StructField("file_name", T.StringType()), T.StructField("line_no", T.LongType()), T.StructField("reason", T.StringType())]
    + [T.StructField(f, T.StringType()) for f in FIELDS]
)
_ARROW = pa.schema([("file_name", pa.string()), ("line_no", pa.int64()), ("reason", pa.string())] + [(f, pa.string()) for f in FIELDS])
_QUOTED = re.compile(WELL_QUOTED, re.S)
_CELL = re.compile(r'"((?:[^"]|"")*)"|([^",]*)', re.S)


def split_record(line: str) -> list[str] | None:
    """The fields of one record by RFC 4180, or None where its quotes are not well formed."""
    if '"' not in line:
        return line.split(",")
    if not _QUOTED.match(line):
        return None
    out, at = [], 0
    while at <= len(line):
        m = _CELL.match(line, at)
        out.append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end() + 1
    return out


@lru_cache(maxsize=65_536)
def valid_date(text: str) -> bool:
    for form, pattern in DATE_FORMS:
        if re.match(form, text, re.A):
            try:
                datetime.strptime(text, pattern)
            except ValueError:
                return False
            return True
    return False


def diagnose(line: str, fields: list[str | None]) -> tuple[str | None, list[str] | None]:
    """The strict reading of one line: the first reason that applies, and its values."""
    values = split_record(line)
    if values is None:
        return "quoting", None
    if len(values) != len(fields):
        return "column_count", None
    values = [v.strip() for v in values]
    for field, value in zip(fields, values, strict=True):
        if field == "match_date":
            bad = not valid_date(value)
        elif field in ("home_team", "away_team"):
            bad = value in MISSING
        elif field in ("home_goals", "away_goals"):
            bad = not re.match(GOALS, value, re.A)
        elif field == "full_time_result":
            bad = not re.match(RESULT, value)
        else:
            bad = False
        if bad:
            return "invalid_value", None
    return None, values


def _good(field: str, column: pa.Array) -> bool:
    """Are all values of a checked field valid? Null stands for a file without the field."""
    if field == "match_date":
        if not pc.all(pc.match_substring_regex(column, "|".join(form for form, _ in DATE_FORMS))).as_py():
            return False
        return all(valid_date(d) for d in pc.unique(column).to_pylist() if d is not None)
    if field in ("home_team", "away_team"):
        return not pc.any(pc.is_in(column, pa.array(MISSING))).as_py()
    return pc.all(pc.match_substring_regex(column, GOALS if field.endswith("_goals") else RESULT)).as_py()


CHECKED = ("match_date", "home_team", "away_team", "home_goals", "away_goals", "full_time_result")


def _picked(columns: list[pa.Array], runs: list[tuple[int, int]]) -> pa.Array:
    """One field's values over (column or -1, lines) runs of the files of a block."""
    parts, at = [], 0
    for column, n in runs:
        parts.append(columns[column].slice(at, n) if column >= 0 else pa.nulls(n, pa.string()))
        at += n
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _runs(codes: list[str], letter: str) -> list[tuple[int, int]]:
    """(column or -1, lines): where the lines of a block have a field, neighbours taken together."""
    return [(column, sum(n for _, n in part)) for column, part in groupby(((code.find(letter), sum(1 for _ in same)) for code, same in groupby(codes)), key=lambda r: r[0])]


def _bulk(lines: pa.Array, codes: list[str]) -> dict[str, pa.Array] | None:
    """The trimmed values of each field of a block, or None if any of its lines is not plainly good."""
    if not pc.all(pc.match_substring_regex(lines, WELL_QUOTED)).as_py() or pc.any(pc.match_substring_regex(lines, r"[\r\n]")).as_py() or pc.any(pc.equal(lines, "")).as_py():
        return None
    names = [f"c{i}" for i in range(len(codes[0]))]
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(lines)], pa.int32()), lines), "\n")[0]
    try:
        read = pacsv.read_csv(
            pa.BufferReader(text.as_buffer()),
            pacsv.ReadOptions(use_threads=False, column_names=names, block_size=1 << 26),
            pacsv.ParseOptions(newlines_in_values=False, ignore_empty_lines=False),
            pacsv.ConvertOptions(column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False, quoted_strings_can_be_null=False),
        )
    except pa.ArrowInvalid:
        return None
    if read.num_rows != len(lines):
        return None
    columns = [c.combine_chunks() for c in read.columns]
    checked = {f: pc.utf8_trim_whitespace(_picked(columns, _runs(codes, _LETTERS[f]))) for f in CHECKED}
    if not all(_good(f, column) for f, column in checked.items()):
        return None
    return {f: checked[f] if f in checked else pc.utf8_trim_whitespace(_picked(columns, _runs(codes, _LETTERS[f]))) for f in FIELDS}


def _halves(lines: pa.Array, numbers: np.ndarray, codes: list[str]) -> Iterator[tuple[np.ndarray, list[str | None], dict[str, pa.Array]]]:
    """(line numbers, reasons, values by field) of pieces of a block of equal column count, bisecting
    what fails; the code of a line names the field of each of its columns."""
    if not len(lines):
        return
    values = _bulk(lines, codes) if len(lines) > LEAF_LINES else None
    if values is not None:
        yield numbers, [None] * len(numbers), values
    elif len(lines) <= LEAF_LINES:
        said = [diagnose(line, _fields(code)) for line, code in zip(lines.to_pylist(), codes, strict=True)]
        at = {code: {f: code.find(letter) for f, letter in _LETTERS.items()} for code in set(codes)}
        yield numbers, [r for r, _ in said], {f: pa.array([v[at[code][f]] if v and at[code][f] >= 0 else None for (_, v), code in zip(said, codes, strict=True)], pa.string()) for f in FIELDS}
    else:
        half = len(lines) // 2
        yield from _halves(lines[:half], numbers[:half], codes[:half])
        yield from _halves(lines[half:], numbers[half:], codes[half:])


def code_of(fields: list[str | None]) -> str:
    """A projection as one letter per column."""
    return "".join(_LETTERS.get(f, _NO_FIELD) for f in fields)


@lru_cache(maxsize=65_536)
def _fields(code: str) -> list[str | None]:
    return [FIELDS[ord(c) - ord("a")] if c != _NO_FIELD else None for c in code]


def _load(batches: Iterator[pa.RecordBatch], block_lines: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = np.array([c or "" for c in batch.column(3).to_pylist()], dtype=object)
        order = np.array(sorted(range(len(codes)), key=lambda k: (len(codes[k]), codes[k])), dtype=np.int64)
        lines = pc.utf8_rtrim(pc.fill_null(batch.column(2), ""), "\r")
        parts = []
        for width, part in groupby(order, key=lambda k: len(codes[k])):
            at = np.fromiter(part, np.int64)
            if not width:
                parts.append((at, ["column_count"] * len(at), {f: pa.nulls(len(at), pa.string()) for f in FIELDS}))
                continue
            for k in range(0, len(at), block_lines):
                own = at[k : k + block_lines]
                parts += _halves(lines.take(pa.array(own)), own, list(codes[own]))
        for who, reasons, values in parts:
            who = pa.array(who)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(who), batch.column(1).take(who), pa.array(reasons, pa.string()), *[values[f] for f in FIELDS]], schema=_ARROW)


def headers(lines: DataFrame) -> DataFrame:
    """(file_name, header array<string>) of each file: its line 1; of repeated ones the least text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cells(texts):  # noqa: ANN001, ANN202
        def split(t: str | None) -> list[str]:
            t = (t or "").rstrip("\r").removeprefix("﻿")
            return split_record(t) or t.split(",")

        return texts.map(split)

    return lines.filter("line_no = 1").groupBy("file_name").agg(F.min("line_text").alias("line_text")).select("file_name", cells("line_text").alias("header"))


def header_projections(lines: DataFrame) -> DataFrame:
    """(file_name, projection): for each file the field of each of its columns, by position."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def fields(texts):  # noqa: ANN001, ANN202
        return texts.map(lambda h: fields_of(list(h)))

    return headers(lines).select("file_name", fields("header").alias("projection"))


def parse_records(lines: DataFrame, projections: DataFrame | None = None, block_lines: int = BLOCK_LINES) -> DataFrame:
    """One row per data line: its fields if it is good, else the reason why not.

    `projections` (file_name, projection array of field or null per column) defaults to what the
    header lines name. Line 1 of each file is its header.
    """
    lines = lines.select("file_name", F.col("line_no").cast("long").alias("line_no"), F.col("line_text").cast("string").alias("line_text")).filter("file_name is not null and line_no is not null")
    projections = header_projections(lines) if projections is None else projections.select("file_name", "projection")
    letters = F.create_map(*[x for f, letter in _LETTERS.items() for x in (F.lit(f), F.lit(letter))])
    code = F.array_join(F.transform("projection", lambda f: F.coalesce(F.try_element_at(letters, F.coalesce(f, F.lit(""))), F.lit(_NO_FIELD))), "")
    data = join_lookup(lines.filter("line_no > 1"), projections.select("file_name", code.alias("code")), ["file_name"])
    return data.select("file_name", "line_no", "line_text", "code").mapInArrow(lambda batches: _load(batches, block_lines), OUTPUT)


def good_rows(parsed: DataFrame) -> DataFrame:
    """The loaded rows, each once."""
    return parsed.filter("reason is null").drop("reason").dropDuplicates(["file_name", "line_no"])


def bad_lines(parsed: DataFrame) -> DataFrame:
    """(file_name, line_no, reason) of the lines that do not parse, each once."""
    return parsed.filter("reason is not null").select("file_name", "line_no", "reason").distinct()
