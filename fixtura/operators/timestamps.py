"""Texts of dates and times in many habits, brought to one date or UTC instant.

A text is taken apart in Arrow batches into day, time of day and zone (as one SQL expression its code
outgrows what the JVM compiles). Wall times are
then joined as of the moment to the intervals of constant UTC offset of their zone, laid out by
local time and exploded over the calendar years they touch: two intervals that hold a wall time mean
that it occurs twice (the first occurrence is taken), none that the clocks skip it, one gives the
offset. The interval table holds a few rows per zone and year of the public time zone database, so
its size is bounded whatever the data.

Defined results: null, empty and unreadable texts, a skipped wall time, an unknown zone, and a date
without a time where an instant is asked for give no value; input rows that repeat give one value.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fixtura.operators.joins import join_lookup
from fixtura.session import cut_lineage

#: Offsets in minutes of abbreviations that a feed may use outside its own zone.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "KST": 540, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "NZST": 720, "NZDT": 780,
}

FIRST_YEAR, LAST_YEAR = 1900, 2100
#: The earliest year of a text without a year of four digits: serial day numbers begin at 10,000.
SHORT_FROM = 1927
DAY = 86_400_000_000
_EPOCH, _SERIAL_START = datetime(1970, 1, 1), datetime(1899, 12, 30)
_ZONE = r"(?i:Z|UTC|[A-Z]{2,5}|(?:UTC|GMT)?[+-]\d{2}:?\d{2}|[+-]\d{2})"
_TIME = rf"^(?:T| ?,? (?:at )?)(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)? ?([AaPp]\.?[Mm]\.?)?(?: ?({_ZONE}))?$"
_COMPACT_TIME = rf"^[T ](\d{{2}})(\d{{2}})(\d{{2}})?(?:[.,](\d{{1,9}}))?()(?: ?({_ZONE}))?$"
_MONTH = r"([A-Za-z]{3,9})\.?"
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)(.*)$"
_COMPACT = r"^((?:19|20)\d{2})(\d{2})(\d{2})((?:[T ].*)?)$"
_NUMBERS = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)(.*)$"
_DAY_NAME = rf"^(\d{{1,2}})(?:st|nd|rd|th)?[ -]{_MONTH}[ ,-]+(\d{{4}}|\d{{2}})(?!\d)(.*)$"
_NAME_DAY = rf"^{_MONTH} (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})(?!\d)(.*)$"


def _int(text: Column) -> Column:
    return F.nullif(text, F.lit("")).cast("int")


def _tidy(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(text, r"[\s\u00a0]+", " "))
    return F.regexp_replace(plain, r"^(?i:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?\.?,? (?=[0-9A-Za-z])", "")


READ = T.StructType([T.StructField("day", T.IntegerType()), T.StructField("micros", T.LongType()), T.StructField("said", T.StringType()), T.StructField("offset_s", T.IntegerType()), T.StructField("epoch", T.LongType())])
_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}
_SHAPES = tuple(re.compile(p, re.A) for p in (_ISO, _COMPACT, _NUMBERS, _DAY_NAME, _NAME_DAY))
_TIMES = tuple(re.compile(p, re.A) for p in (_TIME, _COMPACT_TIME))
_SERIAL = re.compile(r"^([1-9]\d{4})(\.\d+)?$", re.A)
_UNIX = re.compile(r"^(-?\d{9,19})(?:\.(\d{1,9}))?$", re.A)
_ZONE_OFFSET = re.compile(r"([+-])(\d{2}):?(\d{2})?$", re.A)
#: Digits of a Unix time in seconds, milli-, micro- and nanoseconds, and the factor to micros.
_UNITS = {9: 1_000_000, 10: 1_000_000, 12: 1000, 13: 1000, 15: 1, 16: 1, 18: 0.001, 19: 0.001}


def read_text(text: str, month_first: bool) -> tuple | None:
    """(day since 1970, micros of the day, zone name, zone offset in seconds, epoch micros) as far
    as the text has them; None if it is no date and no instant."""
    if (m := _UNIX.match(text)) and (unit := _UNITS.get(len(m[1].lstrip("-")))):
        whole = int(m[1]) * unit if unit >= 1 else int(m[1]) // 1000
        return None, None, None, None, whole + (int(m[2].ljust(6, "0")[:6]) if m[2] and unit == 1_000_000 else 0)
    if m := _SERIAL.match(text):
        of_day = round(float(m[2]) * 86400) * 1_000_000 if m[2] else None
        return (_SERIAL_START + timedelta(int(m[1])) - _EPOCH).days, of_day, None, None, None
    for kind, shape in enumerate(_SHAPES):
        if m := shape.match(text):
            break
    else:
        return None
    a, b, c, rest = m.groups()
    year, month, day = ((a, b, c), (a, b, c), (c, a, b) if month_first else (c, b, a), (c, b, a), (c, a, b))[kind]
    year, month = int(year) + 2000 * (len(year) == 2), _MONTHS.get(month[:3].lower(), 0) if month[0].isalpha() else int(month)
    try:
        days = (datetime(year, month, int(day)) - _EPOCH).days
    except ValueError:
        return None
    if not rest.strip():
        return days, None, None, None, None
    m = _TIMES[0].match(rest) or _TIMES[1].match(rest)
    if not m:
        return None
    hour, minute, second, fine, half, zone = m.groups()
    hour, minute, second = int(hour), int(minute), int(second or 0)
    if half:
        if not 1 <= hour <= 12 and half[0] in "aA":
            return None
        hour = hour % 12 + 12 if half[0] in "pP" and hour <= 12 else hour % 12 if half[0] in "aA" else hour
    if hour > 23 or minute > 59 or second > 60:
        return None
    micros = ((hour * 60 + minute) * 60 + second) * 1_000_000 + int((fine or "0").ljust(6, "0")[:6])
    if zone and (z := _ZONE_OFFSET.search(zone)):
        return days, micros, None, (-1 if z[1] == "-" else 1) * (int(z[2]) * 60 + int(z[3] or 0)) * 60, None
    return days, micros, zone and zone.upper(), None, None


@F.pandas_udf(READ)
def _read(texts: pd.Series, month_first: pd.Series) -> pd.DataFrame:
    done: dict[tuple, tuple] = {}  # dates come again and again within a batch
    out = []
    for key in zip(texts, month_first, strict=True):
        if key not in done:
            done[key] = (read_text(key[0], bool(key[1])) if key[0] is not None else None) or (None,) * 5
        out.append(done[key])
    frame = pd.DataFrame(out, columns=READ.names, dtype=object)
    return frame.astype({"day": "Int32", "micros": "Int64", "offset_s": "Int32", "epoch": "Int64"})


def offset_intervals(zones: DataFrame) -> DataFrame:
    """(feed_zone, local_year, spans): the intervals of constant offset that touch a local year, of the
    zones and from the first to the last year that `zones` (feed_zone, first_year, last_year) names.

    A span has its bounds in local micros [from_local, to_local), offset_s and abbreviation. Names
    that the time zone database lacks are left out.
    """

    def intervals(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zoneinfo import ZoneInfo, available_timezones

        known = available_timezones()
        for batch in batches:
            out = []
            for name, first_year, last_year in batch.itertuples(index=False):
                if name not in known:
                    continue
                zone, end = ZoneInfo(name), datetime(last_year + 1, 1, 3, tzinfo=timezone.utc)

                def state(at: datetime, zone=zone):  # noqa: ANN001, ANN202
                    local = at.astimezone(zone)
                    return local.utcoffset(), local.tzname()

                start = datetime(first_year - 1, 12, 30, tzinfo=timezone.utc)
                at, had = start, state(start)
                while at < end:
                    after = min(at + timedelta(days=1), end)
                    now = state(after)
                    if now != had or after == end:
                        low, high = at, after
                        while now != had and high - low > timedelta(seconds=1):
                            middle = low + (high - low) // 2
                            middle -= timedelta(microseconds=middle.microsecond)
                            middle = max(middle, low + timedelta(seconds=1)) if middle <= low else middle
                            low, high = (middle, high) if state(middle) == had else (low, middle)
                        shift = had[0]
                        from_local, to_local = start.replace(tzinfo=None) + shift, high.replace(tzinfo=None) + shift
                        for year in range(from_local.year, to_local.year + 1):
                            out.append((name, year, (from_local - _EPOCH) // timedelta(microseconds=1), (to_local - _EPOCH) // timedelta(microseconds=1), int(shift.total_seconds()), had[1]))
                        start, had = high, now
                    at = after
            yield pd.DataFrame(out, columns=["feed_zone", "local_year", "from_local", "to_local", "offset_s", "abbreviation"])

    asked = zones.filter("feed_zone is not null").groupBy("feed_zone").agg(F.min("first_year").alias("first_year"), F.max("last_year").alias("last_year"))
    spread = asked.repartition(int(zones.sparkSession.conf.get("spark.sql.shuffle.partitions")), "feed_zone")
    spans = spread.mapInPandas(intervals, "feed_zone string, local_year int, from_local long, to_local long, offset_s int, abbreviation string")
    return spans.groupBy("feed_zone", "local_year").agg(F.collect_list(F.struct("from_local", "to_local", "offset_s", "abbreviation")).alias("spans"))


def feed_habits(values: DataFrame) -> DataFrame:
    """(feed, feed_zone, first_above, second_above, first_year, last_year), in one pass over all texts:
    how often the first and the second of all-number dates is above twelve, and the years that local
    times can lie in. A text without a year of four digits can lie in any of FIRST_YEAR..LAST_YEAR."""
    first, second = (_int(F.regexp_extract("tidy", _NUMBERS, i)) for i in (1, 2))
    year = F.regexp_extract("tidy", r"(?<!\d)((?:19|20)\d{2})(?!\d{5})", 1)
    plain = year != ""
    least = F.when(plain, F.greatest(year.cast("int"), F.lit(FIRST_YEAR))).when(~F.col("tidy").rlike(_UNIX.pattern), F.lit(SHORT_FROM))
    most = F.when(plain, F.least(year.cast("int"), F.lit(LAST_YEAR))).when(~F.col("tidy").rlike(_UNIX.pattern), F.lit(LAST_YEAR))
    return values.groupBy("feed", "feed_zone").agg(
        F.count_if(first > 12).alias("first_above"), F.count_if(second > 12).alias("second_above"), F.min(least).alias("first_year"), F.max(most).alias("last_year")
    )


def month_first_feeds(habits: DataFrame) -> DataFrame:
    """(feed, month_first): the order of day and month in a feed's all-number dates, by the numbers
    above twelve; a feed that never shows it counts as day first, or month first in US zones."""
    us = F.max(F.coalesce(F.col("feed_zone").rlike("^(America/(New_York|Chicago|Denver|Los_Angeles)|US/)"), F.lit(False)))
    summed = habits.groupBy("feed").agg(F.sum("first_above").alias("a"), F.sum("second_above").alias("b"), us.alias("us"))
    return summed.select("feed", ((F.col("b") > F.col("a")) | (F.col("b") == F.col("a")) & F.col("us")).alias("month_first"))


def normalise_times(records: DataFrame, id_col: str, feed: str, zone: str, dates: list[str], instants: list[str]) -> DataFrame:
    """(record_id, field_name, value_text): for each readable value its date as yyyy-MM-dd or its
    instant in UTC as yyyy-MM-ddTHH:mm:ss.SSSSSSZ.

    One pass aggregates the feeds' habits, another reads all columns (one scan, exploded); no row is
    shuffled: the feeds' orders and the interval table of the zones and years in use are joined behind
    a check of their size.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.lit(c in dates).alias("is_date"), F.col(c).cast("string").alias("text")) for c in [*dates, *instants]]))
    values = records.select(F.col(id_col).alias("record_id"), F.col(feed).alias("feed"), F.col(zone).alias("feed_zone"), pairs.alias("p")).select("record_id", "feed", "feed_zone", "p.*").filter("text is not null")
    values = values.withColumn("tidy", _tidy(F.col("text"))).filter("tidy != ''")
    habits = cut_lineage(feed_habits(values))
    read = join_lookup(values, month_first_feeds(habits), ["feed"])
    read = read.withColumn("r", _read(F.col("tidy"), F.coalesce("month_first", F.lit(False)))).select("record_id", "field_name", "is_date", "feed_zone", "r.*")
    read = read.withColumns({"date": F.date_add(F.lit("1970-01-01").cast("date"), F.col("day")), "local": F.col("day").cast("long") * DAY + F.col("micros")})
    read = join_lookup(read.withColumn("local_year", F.year("date")), offset_intervals(habits), ["feed_zone", "local_year"])
    holds = F.filter("spans", lambda s: (s["from_local"] <= F.col("local")) & (F.col("local") < s["to_local"]))
    named = F.filter("spans", lambda s: s["abbreviation"] == F.col("said"))
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v * 60))])
    seconds = (
        F.when(F.col("offset_s").isNotNull(), F.col("offset_s"))
        .when(F.col("said").isNull(), F.array_max(F.transform(holds, lambda s: s["offset_s"])))  # the greater offset is the first occurrence
        .when(F.size(named) > 0, F.array_max(F.transform(named, lambda s: s["offset_s"])))
        .otherwise(F.try_element_at(table, F.col("said")))
    )
    read = read.withColumn("utc", F.coalesce("epoch", F.col("local") - seconds.cast("long") * 1_000_000))
    of = F.pmod("utc", F.lit(DAY))
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    utc_date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("utc") / DAY).cast("int")).cast("string")
    instant = F.concat(utc_date, F.lit("T"), pad(F.floor(of / 3_600_000_000), 2), F.lit(":"), pad(F.floor(of / 60_000_000) % 60, 2), F.lit(":"), pad(F.floor(of / 1_000_000) % 60, 2), F.lit("."), pad(of % 1_000_000, 6), F.lit("Z"))
    date = F.when(F.col("epoch").isNotNull(), utc_date).otherwise(F.col("date").cast("string"))
    return read.select("record_id", "field_name", F.when(F.col("is_date"), date).otherwise(instant).alias("value_text")).filter("value_text is not null").distinct()
