"""Rolling form of teams: one shuffle on the team serves all windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.operators.joins import at_most_one

SUMS = ("points", "goals_for", "goals_against", "goal_difference", "is_win", "is_draw", "is_loss")
NAMES = ("points_last_5", "goals_for_last_5", "goals_against_last_5", "goal_difference_last_5", "wins_last_5", "draws_last_5", "losses_last_5")
#: What a match takes over of each of its teams, and the differences home less away.
TAKEN = ("matches_played_before", *NAMES, "average_points_last_5", "days_since_previous_match")
DIFFERENCES = {
    "form_points_difference": "points_last_5",
    "recent_attack_difference": "goals_for_last_5",
    "recent_defence_difference": "goals_against_last_5",
    "recent_goal_difference_difference": "goal_difference_last_5",
    "average_form_difference": "average_points_last_5",
    "rest_days_difference": "days_since_previous_match",
}


def team_history(matches: DataFrame) -> DataFrame:
    """Two rows per finished match with a score, one from the view of each team.

    A finished match without a score is no match that was played: it gives no row.
    """

    def view(venue: str, own: str, other: str) -> Column:
        gap = F.col(f"{own}_goals") - F.col(f"{other}_goals")
        return F.struct(
            F.lit(venue).alias("venue"), F.col(f"{own}_team_id").alias("team_id"), F.col(f"{other}_team_id").alias("opponent_id"), F.col(f"{own}_goals").alias("goals_for"), F.col(f"{other}_goals").alias("goals_against"),
            gap.alias("goal_difference"), F.when(gap > 0, "W").when(gap == 0, "D").otherwise("L").alias("result"), F.when(gap > 0, 3).when(gap == 0, 1).otherwise(0).cast("long").alias("points"),
            (gap > 0).cast("long").alias("is_win"), (gap == 0).cast("long").alias("is_draw"), (gap < 0).cast("long").alias("is_loss"),
        )

    both = F.explode(F.array(view("home", "home", "away"), view("away", "away", "home"))).alias("t")
    played = matches.filter("status = 'FINISHED' and home_goals is not null and away_goals is not null")
    return played.select("match_key", "season", "kickoff_utc", both).select("match_key", "season", "kickoff_utc", "t.*")


def _by_team() -> Window:
    return Window.partitionBy("team_id").orderBy("kickoff_utc", "match_key")


def rest_days(history: DataFrame) -> DataFrame:
    """Whole days of 24 hours since the team's last match."""
    before = F.lag("kickoff_utc").over(_by_team())
    return history.withColumn("previous_match", before).withColumn("rest_days", F.expr("timestampdiff(DAY, previous_match, kickoff_utc)"))


def rolling_form(history: DataFrame, window_size: int = 5) -> DataFrame:
    if window_size < 1:
        raise ValueError("window_size must be at least 1")
    w = _by_team()
    last = w.rowsBetween(-window_size, -1)
    out = history.withColumns({"matches_played_before": (F.row_number().over(w) - 1).cast("long")} | {n: F.coalesce(F.sum(c).over(last), F.lit(0)).cast("long") for c, n in zip(SUMS, NAMES, strict=True)})
    played = F.nullif(F.least(F.col("matches_played_before"), F.lit(window_size)), F.lit(0))
    return out.withColumn("average_points_last_5", F.coalesce(F.try_divide(F.col("points_last_5"), played), F.lit(0.0)))


def match_form(matches: DataFrame, form: DataFrame) -> DataFrame:
    """Home and away form of each match and their differences: conditional aggregation, one shuffle
    instead of two joins. Two rows of one match and venue are an error; a team without form has zeros,
    but no days of rest."""
    rested = "rest_days" in form.columns
    source = {c: c for c in TAKEN if c != "days_since_previous_match"} | ({"days_since_previous_match": "rest_days"} if rested else {})
    picked = [F.max(F.when(F.col("venue") == v, F.col(c))).alias(f"{v}_{name}") for v in ("home", "away") for name, c in source.items()]
    checks = [at_most_one(F.col("venue") == v, f"more than one {v} row of form in a match").alias(f"_one_{v}") for v in ("home", "away")]
    wide = form.groupBy("match_key").agg(*picked, *checks).filter("_one_home and _one_away").drop("_one_home", "_one_away")
    out = matches.join(wide, "match_key", "left").fillna(0, [f"{v}_{c}" for v in ("home", "away") for c in source if c != "days_since_previous_match"])
    return out.withColumns({name: F.col(f"home_{c}") - F.col(f"away_{c}") for name, c in DIFFERENCES.items() if c in source})


def form_as_of(matches: DataFrame, history: DataFrame, window_size: int = 5) -> DataFrame:
    """Points of the last matches before each kickoff for scheduled fixtures too (match_key, side, points)."""
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id")) for s in ("home", "away")])).alias("s")
    asked = matches.filter("status != 'FINISHED'").select("match_key", "kickoff_utc", sides).select("match_key", "kickoff_utc", "s.side", "s.team_id", F.lit(None).cast("long").alias("points"))
    both = history.select("match_key", "kickoff_utc", F.col("venue").alias("side"), "team_id", "points").unionByName(asked)
    # fixtures take the number of the match that would be next, so the last played ones are a range of numbers
    before = Window.partitionBy("team_id").orderBy("kickoff_utc", "match_key", "side").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("team_id").orderBy("nth").rangeBetween(-window_size, -1)
    numbered = both.withColumn("nth", F.count("points").over(before) + 1)
    return numbered.withColumn("points_last", F.coalesce(F.sum("points").over(last), F.lit(0).cast("long"))).select("match_key", "side", "points_last")
