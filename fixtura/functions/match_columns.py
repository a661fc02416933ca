"""Column expressions of the match domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class order of outcomes everywhere: 0 away win, 1 draw, 2 home win.
CLASSES = ("A", "D", "H")


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(strip_space(c), r"\s+", " ")


def normalise_alias(c: Column) -> Column:
    return F.lower(collapse_space(c))


def team_slug(c: Column) -> Column:
    plain = F.translate(F.replace(normalise_alias(c), F.lit("&"), F.lit("and")), "'.", "")
    return F.replace(plain, F.lit(" "), F.lit("-"))


def season_label(start_year: Column) -> Column:
    return F.concat(start_year.cast("string"), F.lit("/"), F.lpad(F.pmod(start_year + 1, F.lit(100)).cast("string"), 2, "0"))


def season_code(start_year: Column) -> Column:
    two = lambda c: F.lpad(F.pmod(c, F.lit(100)).cast("string"), 2, "0")
    return F.concat(two(start_year), two(start_year + 1))


def parse_match_date(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(p)).cast("date") for p in ("dd/MM/yyyy", "dd/MM/yy", "yyyy-MM-dd")])


def blank_to_null(c: Column) -> Column:
    return F.when(~strip_space(c).isin("", "NA", "N/A"), strip_space(c))


def result_of(home: Column, away: Column) -> Column:
    return F.when(home > away, "H").when(home < away, "A").when(home == away, "D")


def target_of(result: Column) -> Column:
    return F.when(result == "A", 0).when(result == "D", 1).when(result == "H", 2).cast("long")


def match_key(*parts: Column) -> Column:
    """SHA-256 of the parts; null if any of them is."""
    text = F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("|"))][:-1])
    return F.sha2(text, 256)


def expected_home_score(home: Column, away: Column, advantage: float = 60.0) -> Column:
    return 1 / (1 + F.pow(F.lit(10.0), -(home + advantage - away) / 400))


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def arg_max(*p: Column) -> Column:
    """Index of the greatest of the columns, the first of equals."""
    return (F.array_position(F.array(*p), F.array_max(F.array(*p))) - 1).cast("long")
