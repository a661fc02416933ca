"""Chronological rating fold. State of two keys interacts, so a window cannot express it.

Teams that never meet, not even through others, do not touch each other's ratings: the fold falls
apart into the connected components of the teams. Each component is a stream: its matches are sorted
by Spark (which spills) and folded in Arrow batches, and all that a task holds is one rating per team.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.operators.joins import join_lookup
from fixtura.session import cut_lineage


@dataclass(frozen=True)
class EloParameters:
    initial: float = 1500.0
    k: float = 20.0
    home_advantage: float = 60.0

    def __post_init__(self) -> None:
        if self.initial <= 0 or self.k <= 0 or self.home_advantage < 0:
            raise ValueError("initial and k must be positive, home_advantage not negative")


MOST_PAIRS = 100_000
COLUMNS = ["match_key", "home_elo_pre", "away_elo_pre", "elo_difference", "home_expected_score", "away_expected_score", "actual_home", "home_elo_change", "away_elo_change", "home_elo_post", "away_elo_post"]
SCHEMA = "match_key string, " + ", ".join(f"{c} double" for c in COLUMNS[1:])


class Ratings:
    """Ratings of the teams met so far; a team not met has the initial one."""

    def __init__(self, parameters: EloParameters) -> None:
        self.p, self.of = parameters, {}

    def play(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Ratings before and after each match, in the order given; scheduled ones only read."""
        p, of, out = self.p, self.of, []
        columns = (rows[c].tolist() for c in ("match_key", "home_team_id", "away_team_id", "home_goals", "away_goals", "status"))
        for key, home, away, hg, ag, status in zip(*columns, strict=True):
            h, a = of.get(home, p.initial), of.get(away, p.initial)
            expected = 1.0 / (1.0 + 10.0 ** (-(h + p.home_advantage - a) / 400.0))
            actual, change = None, 0.0
            if status == "FINISHED" and hg is not None and ag is not None and hg == hg and ag == ag:  # noqa: PLR0124 (NaN)
                actual = 1.0 if hg > ag else 0.5 if hg == ag else 0.0
                change = p.k * (actual - expected)
                of[home] = h + change
                of[away] = a - change
            out.append((key, h, a, h - a, expected, 1.0 - expected, actual, change, -change, h + change, a - change))
        return pd.DataFrame(dict(zip(COLUMNS, zip(*out, strict=True), strict=True)) if out else {c: [] for c in COLUMNS}).astype(dict.fromkeys(COLUMNS[1:], float))


def fold(matches: pd.DataFrame, p: EloParameters) -> pd.DataFrame:
    """The fold of one table in order of kickoff, then key."""
    return Ratings(p).play(matches.sort_values(["kickoff_utc", "match_key"], kind="stable"))


def components(matches: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(team_id, component): the least team that each team is linked to.

    Up to `most_pairs` different pairs of teams are joined up on the driver; more by the least label of
    the neighbours, and of the labels' own labels, until none changes. Both give the same.
    """
    met = matches.filter("home_team_id is not null and away_team_id is not null").select(F.col("home_team_id").alias("a"), F.col("away_team_id").alias("b")).distinct()
    met = cut_lineage(met)
    few = met.limit(most_pairs + 1).collect()
    if len(few) <= most_pairs:
        return matches.sparkSession.createDataFrame(list(_joined_up(few).items()), f"team_id {met.schema['a'].dataType.simpleString()}, component {met.schema['a'].dataType.simpleString()}")
    edges = cut_lineage(met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("team_id"), "label"))
    while True:
        near = edges.join(labels.select(F.col("team_id").alias("b"), "label"), "b").groupBy(F.col("a").alias("team_id")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "team_id", "left").select("team_id", "label", F.least("label", "near").alias("new"))
        jumped = moved.join(labels.select(F.col("team_id").alias("new"), F.col("label").alias("further")), "new", "left")
        after = cut_lineage(jumped.select("team_id", F.least("new", "further").alias("label"), (F.least("new", "further") != F.col("label")).alias("changed")))
        labels = after.select("team_id", "label")
        if after.filter("changed").isEmpty():
            return labels.withColumnRenamed("label", "component")


def _joined_up(pairs: list) -> dict:
    """The least member of the group of each member of some pairs."""
    root: dict = {}

    def find(x):  # noqa: ANN001, ANN202
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        root.setdefault(a, a)
        root.setdefault(b, b)
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {x: find(x) for x in root}


def elo_history(matches: DataFrame, parameters: EloParameters | None = None, group_col: str | None = None) -> DataFrame:
    """Ratings before and after every match.

    Components of teams are found unless `group_col` names groups that share no team. Matches of one
    component are one stream in time, so one component is one task, but a task only holds batches and
    one number per team. A match without one of its teams is rated by itself from the initial rating.
    """
    p = parameters or EloParameters()
    slim = matches.select("match_key", "kickoff_utc", "home_team_id", "away_team_id", "home_goals", "away_goals", "status", *([F.col(group_col).cast("string").alias("component")] if group_col else []))
    if not group_col:
        slim = join_lookup(slim, components(slim).withColumnRenamed("team_id", "home_team_id"), ["home_team_id"])
    slim = slim.withColumn("component", F.coalesce("component", F.col("away_team_id").cast("string"), F.lit("")))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        component, ratings = None, Ratings(p)
        for batch in batches:
            starts = batch.index[batch["component"].ne(batch["component"].shift())]
            for a, b in zip(starts, [*starts[1:], len(batch)], strict=True):
                if batch["component"].iat[a] != component:
                    component, ratings = batch["component"].iat[a], Ratings(p)
                yield ratings.play(batch.iloc[a:b])

    return slim.repartition("component").sortWithinPartitions("component", "kickoff_utc", "match_key").mapInPandas(stream, SCHEMA)


def elo_invariants(history: DataFrame) -> DataFrame:
    """Counts of violations of what must hold of every rating history."""
    inside = F.col("home_expected_score").between(0, 1) & F.col("away_expected_score").between(0, 1)
    return history.agg(
        F.count("*").alias("row_count"), (F.count("*") - F.countDistinct("match_key")).alias("duplicate_keys"), F.count_if(~inside).alias("outside_unit"),
        F.count_if(F.abs(F.col("home_expected_score") + F.col("away_expected_score") - 1) > 1e-10).alias("not_one"), F.count_if(F.abs(F.col("home_elo_pre") + F.col("away_elo_pre") - F.col("home_elo_post") - F.col("away_elo_post")) > 1e-8).alias("not_conserved"),
    )


def match_elo(matches: DataFrame, history: DataFrame) -> DataFrame:
    """Each match with its ratings (1:1); a match without is an error."""
    from fixtura.operators.joins import checked_join

    rated = checked_join(matches, history, "match_key", "left", "1:1", "ratings of a match")
    whole = F.when(F.col("home_elo_pre").isNull(), F.raise_error(F.lit("a match has no rating"))).otherwise(True).cast("boolean")
    return rated.filter(whole)
