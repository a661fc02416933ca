"""Files whose columns drift: one consistent table and a report of every change.

Each file's columns form a small nested schema (file / group of fields / column). Two least-cost tree
edit scripts do the work. The script from the canonical schema to a file decides which column carries
which field: turning a field into a column costs the less the more alike its wording is, and a column
that no field fits is inserted; the script is compiled into the projection with which the file's lines
are read. The scripts between the schemas of neighbouring files of one division give the additions,
deletions, renames and type changes; the script between their columns in file order gives the moves.

A column's type is that of its good values (whole < decimal < text, missing ones left out), taken
with one pre-aggregated pass over the parsed rows; a column without any value has no type and cannot
be retyped. Defined results: files whose name does not follow `division_season_number.csv` are kept
in the table but have no neighbour; of several columns that fit one field alike the first carries it;
nulls, repeated rows and empty tables as in `raw_records`.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.functions.headers import FIELDS, header_likeness
from fixtura.functions.tree_edit import edit_script
from fixtura.operators.raw_records import MISSING, good_rows, headers, parse_records
from fixtura.session import cut_lineage

KINDS = ("whole", "decimal", "text")
COLUMN = T.StructType([T.StructField("field", T.StringType()), T.StructField("header", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("position", T.IntegerType())])
CHANGE = T.StructType([T.StructField("field_name", T.StringType()), T.StructField("change_kind", T.StringType()), T.StructField("was", T.StringType()), T.StructField("now", T.StringType())])


GROUPS = ("when", "teams", "score", "half_time", "counts", "other")


def group_of(field: str | None) -> str:
    if field is None:
        return "other"
    if field in ("match_date", "kickoff_time"):
        return "when"
    if field.startswith("half_time"):
        return "half_time"
    return "score" if field in ("home_goals", "away_goals", "full_time_result") else "teams" if field.endswith("_team") else "counts"


def schema_tree(columns: list[dict]) -> tuple:
    """file / group / column, children in canonical order, so that order of columns costs nothing."""
    order = {f: i for i, f in enumerate(FIELDS)}
    groups: dict[str, list] = {g: [] for g in GROUPS}
    for c in sorted(columns, key=lambda c: (order.get(c["field"], len(order)), c["header"] or "", c["position"])):
        groups[group_of(c["field"])].append((("column", c["field"], c["header"], c["kind"]), []))
    return (("file",), [(("group", g), leaves) for g, leaves in groups.items()])


def _relabel(a: tuple, b: tuple) -> float:
    if a == b:
        return 0.0
    if a[0] != "column" or b[0] != "column" or a[1] != b[1]:
        return 3.0  # dearer than a deletion and an addition
    if a[1] is None:
        return 0.0 if a[2] == b[2] else 3.0
    return 0.5 * (a[2] != b[2]) + 0.5 * (a[3] != b[3] and None not in (a[3], b[3]))


#: Likeness from which on a wording that no word list knows costs less to turn into than to add anew.
ALIKE = 0.75


def _naming(a: tuple, b: tuple) -> float:
    """What it costs to take a file's column for a canonical field: less than a deletion and an
    addition (2) only for a wording that is like the field's."""
    if a[0] != "column" or b[0] != "column":
        return 0.0 if a == b else 3.0
    likeness = header_likeness(b[2] or "", a[1])
    return (1 - likeness) * 2 / (1 - ALIKE) * 0.999 + 0.001 * b[3] / 1000 if likeness > 0 else 3.0


def assign_fields(headers: list[str]) -> tuple[str | None, ...]:
    """The field that each column of a file carries, by the least-cost script from the canonical
    schema. A column hangs in the group, and at the place, of the field that its wording is most like."""
    fields = [{"field": f, "header": f, "kind": None, "position": i} for i, f in enumerate(FIELDS)]
    columns = []
    for at, header in enumerate(headers):
        like = [(header_likeness(header or "", f), -i) for i, f in enumerate(FIELDS)]
        best, order = max(like)
        columns.append((-order if best >= ALIKE else len(FIELDS), -best, at, header))
    groups: dict[str, list] = {g: [] for g in GROUPS}
    for order, _, at, header in sorted(columns):
        groups[group_of(FIELDS[order] if order < len(FIELDS) else None)].append((("column", at, header, at), []))
    own = (("file",), [(("group", g), leaves) for g, leaves in groups.items()])
    out: list[str | None] = [None] * len(headers)
    for op, a, b in edit_script(schema_tree(fields), own, _naming)[1]:
        if op in ("keep", "relabel") and b[0] == "column":
            out[b[1]] = a[1]
    return tuple(out)


def moves(was: list[dict], now: list[dict]) -> list[str]:
    """Fields that the least-cost script between two files' columns in file order takes out at one
    place and puts in at another."""
    in_order = lambda columns: [c["field"] for c in sorted(columns, key=lambda c: c["position"]) if c["field"]]
    before, after = in_order(was), in_order(now)
    both = set(before) & set(after)
    before, after = [f for f in before if f in both], [f for f in after if f in both]
    if before == after:
        return []
    script = edit_script(("file", [(f, []) for f in before]), ("file", [(f, []) for f in after]), lambda a, b: 0.0 if a == b else 3.0)[1]
    gone = [a for op, a, _ in script if op == "delete"]
    return [f for f in gone if f in {b for op, _, b in script if op == "insert"}]


def schema_changes(was: list[dict], now: list[dict]) -> list[tuple]:
    """(field, change, was, now) from the least-cost script between two files' columns."""
    out: list[tuple] = []
    key = lambda columns: sorted((c["field"] or "", c["header"] or "", c["kind"] or "") for c in columns)
    if key(was) != key(now):
        for op, a, b in edit_script(schema_tree(was), schema_tree(now), _relabel)[1]:
            if op == "delete" and a[1]:
                out.append((a[1], "removed", a[2], None))
            elif op == "insert" and b[1]:
                out.append((b[1], "added", None, b[2]))
            elif op == "relabel" and a[1]:
                if a[2] != b[2]:
                    out.append((a[1], "renamed", a[2], b[2]))
                if a[3] != b[3] and None not in (a[3], b[3]):
                    out.append((a[1], "retyped", a[3], b[3]))
    return out + [(f, "moved", None, None) for f in moves(was, now)]


def _rank(value: Column) -> Column:
    """0 whole, 1 decimal, 2 text; null for a missing value."""
    return (
        F.when(value.isNull() | value.isin(*MISSING), None)
        .when(value.rlike(r"^[+-]?[0-9]+$"), 0)
        .when(value.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), 1)
        .otherwise(2)
    )


def file_schemas(lines: DataFrame, parsed: DataFrame, projections: DataFrame) -> DataFrame:
    """(file_name, columns): per file its columns with the field that each carries, header text, kind
    and position. A line that comes twice does not change the kinds, so rows are not made distinct."""
    kinds = parsed.filter("reason is null").groupBy("file_name").agg(*[F.max(_rank(F.col(f))).alias(f) for f in FIELDS])
    ranks = F.create_map(*[x for f in FIELDS for x in (F.lit(f), F.col(f).cast("int"))])
    names = F.array(*[F.lit(k) for k in KINDS])
    known = projections.join(kinds.select("file_name", ranks.alias("ranks")), "file_name", "left")
    kind = lambda f: F.try_element_at(names, F.try_element_at("ranks", F.coalesce(f, F.lit(""))) + 1)
    columns = F.transform(F.arrays_zip("header", "projection"), lambda c, i: F.struct(c["projection"].alias("field"), c["header"].alias("header"), kind(c["projection"]).alias("kind"), i.alias("position")))
    return known.select("file_name", columns.alias("columns"))


def neighbours(schemas: DataFrame) -> DataFrame:
    """Each file with the columns of the file before it in its division, by season, then number."""
    name = lambda i: F.regexp_extract("file_name", r"^(.*)_([0-9]+)_([0-9]+)\.csv$", i)
    start = F.substring(name(2), 1, 2).cast("int")
    ordered = schemas.filter(name(1) != "").withColumns({"division": name(1), "season": F.when(F.length(name(2)) == 4, F.when(start >= 50, start + 1900).otherwise(start + 2000)).otherwise(F.expr("try_cast(regexp_extract(file_name, '^(.*)_([0-9]+)_([0-9]+)\\\\.csv$', 2) AS bigint)")), "number": name(3).cast("long")})
    w = Window.partitionBy("division").orderBy("season", "number", "file_name")
    return ordered.withColumn("before", F.lag("columns").over(w)).filter("before is not null").select("file_name", "before", "columns")


def changes(schemas: DataFrame) -> DataFrame:
    """Every change (added, removed, renamed, retyped, moved) of a mapped field between neighbours."""

    @F.pandas_udf(T.ArrayType(CHANGE))
    def script(before: pd.Series, after: pd.Series) -> pd.Series:
        done: dict[tuple, list] = {}

        def one(a: list, b: list) -> list:
            a, b = ([x if isinstance(x, dict) else x.asDict() for x in side] for side in (a, b))
            key = tuple(tuple(c.values()) for side in (a, b) for c in [*side, {}])
            if key not in done:
                done[key] = [dict(zip(CHANGE.names, c, strict=True)) for c in schema_changes(a, b)]
            return done[key]

        return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)], dtype=object)

    # the window leaves files by division; scripts are spread by file again
    pairs = neighbours(schemas)
    spread = pairs.repartition(int(schemas.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_name")
    return spread.select("file_name", F.explode(script("before", "columns")).alias("c")).select("file_name", "c.*")


def compile_projections(lines: DataFrame) -> DataFrame:
    """(file_name, header, projection): the script from the canonical schema to each file, as the field
    that each column is read as; headers that come again are compiled once."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def compiled(header: pd.Series) -> pd.Series:
        done: dict[tuple, list] = {}
        for h in header:
            if tuple(h) not in done:
                done[tuple(h)] = list(assign_fields(list(h)))
        return header.map(lambda h: done[tuple(h)])

    heads = headers(lines)
    once = heads.select("header").distinct()
    return cut_lineage(heads.join(once.select("header", compiled("header").alias("projection")), "header").select("file_name", "header", "projection"))


def _clock(value: Column) -> Column:
    """HH:mm of the ways a file may write a clock time; null if it is none of them."""
    digits = F.lpad(value, 4, "0")
    pm = F.regexp_extract(value, r"(?i)^(\d{1,2}):(\d{2})\s*([ap])\.?m\.?$", 3)
    hour = F.regexp_extract(value, r"(?i)^(\d{1,2}):(\d{2})", 1)
    minute = F.regexp_extract(value, r"(?i)^(\d{1,2}):(\d{2})", 2)
    h24 = F.when(F.lower(pm) == "p", hour.cast("int") % 12 + 12).otherwise(hour.cast("int") % 12)
    point = F.split(value, r"\.")
    return (
        F.when(value.rlike(r"^\d{3,4}$"), F.concat(F.substring(digits, 1, 2), F.lit(":"), F.substring(digits, 3, 2)))
        .when(value.rlike(r"^\d{1,2}$"), F.concat(F.lpad(value, 2, "0"), F.lit(":00")))
        .when(value.rlike(r"^\d{1,2}\.\d{1,2}$"), F.concat(F.lpad(point[0], 2, "0"), F.lit(":"), F.rpad(point[1], 2, "0")))
        .when(pm != "", F.concat(F.lpad(h24.cast("string"), 2, "0"), F.lit(":"), minute))
        .when(hour != "", F.concat(F.lpad(hour, 2, "0"), F.lit(":"), minute))
    )


def consistent_table(parsed: DataFrame) -> DataFrame:
    """The good rows of all files under one typed schema; what cannot be read is null."""

    def typed(f: str) -> Column:
        value = F.when(F.col(f).isin(*MISSING), None).otherwise(F.col(f))
        if f == "match_date":
            return F.coalesce(*[F.try_to_timestamp(value, F.lit(p)).cast("date") for p in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")])
        if f == "kickoff_time":
            return _clock(value)
        if f.endswith("_team"):
            return value
        if f.endswith("_result"):
            letter = F.upper(F.substring(value, 1, 1))
            return F.when(letter.isin("H", "D", "A"), letter)
        return F.expr(f"try_cast(try_cast(nullif(regexp_extract({f}, '^[+-]?[0-9]+([.][0-9]+)?', 0), '') AS double) AS bigint)")

    return good_rows(parsed).select("file_name", "line_no", *[typed(f).alias(f) for f in FIELDS])


def drift_report(lines: DataFrame) -> DataFrame:
    """All changes over the files of `lines`: lines are read by the compiled projections, and types
    taken from their good rows."""
    projections = compile_projections(lines)
    return changes(file_schemas(lines, parse_records(lines, projections), projections))
