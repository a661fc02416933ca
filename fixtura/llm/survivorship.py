"""One surviving record for each group of duplicates, chosen field by field.

Each attribute has its own composite rank: whether the value is usable at all, how far its record is
to be trusted for this attribute, and when it was last said. One aggregation per group takes, for
every attribute at once, the maximum of the struct (rank, value); with its map-side combine a group
that holds a third of all rows costs no more than any other. `holders` then names, per attribute,
the least record id of the group whose value is the surviving one.

Defined results: a null key forms no group; a value that no record can vouch for is null; equal
ranks are settled by the greater value; repeated rows change nothing; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.session import cut_lineage

#: Groups of more rows than this are joined by broadcast, being at most total / HOT_GROUP in number.
HOT_GROUP = 1_000_000


@dataclass(frozen=True)
class Attribute:
    """`usable` decides whether a value may survive; `ranks` order the usable ones, first rank first."""

    name: str
    usable: Column
    ranks: tuple[Column, ...]


def survivors(records: DataFrame, key: str, attributes: list[Attribute], kept: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: every attribute's surviving value, `n` rows, and `<name>_differs`, whether
    the group's values of the attribute are not all equal (null counting as a value); of the columns
    `kept` beside them, the greatest value."""
    best = [
        F.max(F.struct(F.when(a.usable, 1).otherwise(0).alias("usable"), *[r.alias(f"r{i}") for i, r in enumerate(a.ranks)], F.when(a.usable, F.col(a.name)).alias("value"))).alias(f"_{a.name}")
        for a in attributes
    ]
    same = [(F.count(a.name) != F.count(F.lit(1))) & (F.count(a.name) != 0) | (F.min(a.name) != F.max(a.name)) for a in attributes]
    differs = [F.coalesce(s, F.lit(False)).alias(f"{a.name}_differs") for s, a in zip(same, attributes, strict=True)]
    first = [F.max(c).alias(c) for c in kept]
    out = records.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), *best, *differs, *first)
    return out.select(key, "n", *[F.col(f"_{a.name}.value").alias(a.name) for a in attributes], *[f"{a.name}_differs" for a in attributes], *kept)


def holders(records: DataFrame, golden: DataFrame, key: str, names: list[str], id_col: str) -> DataFrame:
    """(key, field_name, id): for each attribute whose values differ within the group and whose
    surviving value is not null, the least id among the records that hold that value."""
    differs = F.lit(False)
    for n in names:
        differs = differs | (F.col(f"{n}_differs") & F.col(n).isNotNull())
    wanted = cut_lineage(golden.filter((F.col("n") > 1) & differs).select(key, "n", *[F.when(F.col(f"{n}_differs"), F.col(n)).alias(f"_right_{n}") for n in names]))
    hot = wanted.filter(F.col("n") > HOT_GROUP)
    slim = records.select(key, id_col, *names)
    if hot.isEmpty():
        joined = slim.join(wanted.drop("n"), key)
    else:
        joined = slim.join(F.broadcast(hot.drop("n")), key).unionByName(slim.join(wanted.filter(F.col("n") <= HOT_GROUP).drop("n"), key))
    least = joined.groupBy(key).agg(*[F.min(F.when(F.col(n) == F.col(f"_right_{n}"), F.col(id_col))).alias(n) for n in names])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias(id_col)) for n in names])).alias("f")
    return least.select(key, rows).select(key, "f.field_name", f"f.{id_col}").filter(F.col(id_col).isNotNull())


@dataclass(frozen=True)
class MatchRules:
    """What is known of the sources of match records; every list can be another one.

    `trust` ranks sources (others rank 0); `live` is the source whose unfinished records mean a time of
    midnight as it stands; `archive` the source whose kickoff outranks the others' where both are sound.
    """

    trust: dict[str, int]
    live: str
    archive: str
    statuses: tuple[str, ...]
    unplayed: tuple[str, ...]
    early: tuple[str, ...]
    awarded: str
    most_goals: int
    least_year: int


def match_attributes(rules: MatchRules) -> list[Attribute]:
    """The ranks of match records, by what their sources are known to do.

    More trusted sources outrank less trusted ones. A record is as recent as it says itself
    (last_updated), not as late as it came in; an awarded result replaces the one that was played. A
    score that contradicts the result of the same record is trusted less than any that does not; goals
    out of range and codes that are no result are no values. Midnight stands for a missing time in
    trusted records, but for the live source's unfinished ones.
    """
    said = F.coalesce(F.col("last_updated"), F.col("ingested_at"))
    said = F.coalesce(F.unix_micros(said.cast("timestamp")), F.lit(-1))
    trust = F.coalesce(*[F.when(F.col("source") == s, t) for s, t in rules.trust.items()], F.lit(0))
    status = F.coalesce(F.col("status"), F.lit(""))
    trusted = trust > 0
    awarded = (trusted & (status == rules.awarded)).cast("int")
    kickoff = F.col("kickoff_utc")
    placeholder = (F.hour(kickoff) * 60 + F.minute(kickoff) == 0) & trusted & ~((F.col("source") == rules.live) & status.isin(*rules.early))
    clean = (~F.coalesce(placeholder, F.lit(False))).cast("int")
    goals = lambda c: F.col(c).between(0, rules.most_goals)
    result = F.col("full_time_result").isin("H", "D", "A")
    told = F.when(F.col("home_goals") > F.col("away_goals"), "H").when(F.col("home_goals") < F.col("away_goals"), "A").otherwise("D")
    checked = goals("home_goals") & goals("away_goals") & result
    agrees = F.when(F.coalesce(checked, F.lit(False)), F.when(told == F.col("full_time_result"), 2).otherwise(0)).otherwise(1)
    sound = (agrees > 0).cast("int")
    over = ~status.isin(*rules.unplayed)
    return [
        Attribute("kickoff_utc", kickoff.isNotNull() & (F.year(kickoff) >= rules.least_year), (clean, trusted.cast("int"), (F.coalesce(F.col("source"), F.lit("")) == rules.archive).cast("int"), said)),
        Attribute("status", F.col("status").isin(*rules.statuses), (trusted.cast("int"), awarded, said)),
        Attribute("home_goals", goals("home_goals") & over, (awarded, sound, trust, said, agrees)),
        Attribute("away_goals", goals("away_goals") & over, (awarded, sound, trust, said, agrees)),
        Attribute("full_time_result", result & over, (awarded, sound, trust, said, agrees)),
    ]


def golden_matches(silver: DataFrame, rules: MatchRules, kept: tuple[str, ...] = ()) -> DataFrame:
    """The surviving record of each match_key; a match that was not played has no score or result."""
    golden = survivors(silver, "match_key", match_attributes(rules), kept)
    played = F.coalesce(~F.col("status").isin(*rules.unplayed), F.lit(True))
    return golden.withColumns({c: F.when(played, F.col(c)) for c in ("home_goals", "away_goals", "full_time_result")})
