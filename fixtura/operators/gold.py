"""Model dataset: targets, flags, season splits, folds, time partitions and data-quality counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions import match_columns as C
from fixtura.operators.joins import join_lookup
from fixtura.session import cut_lineage


class DataQualityError(ValueError):
    """A layer breaks one of its rules."""


def season_order(df: DataFrame) -> DataFrame:
    """Seasons by first kickoff."""
    starts = df.groupBy("season").agg(F.min("kickoff_utc").alias("season_start"))
    return starts.withColumn("position", F.row_number().over(Window.orderBy("season_start", "season")).cast("long"))  # a few rows


def assign_splits(df: DataFrame, validation: str, test: str) -> DataFrame:
    """train before the validation season, validation, test, and future for all else."""
    starts = season_order(df)
    v = starts.filter(F.col("season") == validation).select(F.col("season_start").alias("_v"))
    order = starts.crossJoin(F.broadcast(v)).select("season", F.when(F.col("season") == validation, "validation").when(F.col("season") == test, "test").when(F.col("season_start") < F.col("_v"), "train").otherwise("future").alias("split"))
    return join_lookup(df, order, ["season"])


def cold_start_flags(df: DataFrame, window_size: int = 5) -> DataFrame:
    flags = {}
    for side in ("home", "away"):
        played = F.col(f"{side}_matches_played_before")
        flags |= {f"{side}_is_cold_start": played == 0, f"{side}_has_limited_history": played < window_size}
    return df.withColumns(flags)


def feature(c: str) -> Column:
    """A column as a model sees it, the same in training and serving: double, NaN and null as 0."""
    return F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0))


def number_in_time(df: DataFrame, name: str = "_n") -> DataFrame:
    """Each row with its 1-based position in order of kickoff and key, and `_total` rows.

    Rows are range-partitioned by time, numbered within their partition and moved up by the sizes of
    the partitions before it (one number per partition), so that no task holds more than its part.
    """
    spread = cut_lineage(df.repartitionByRange("kickoff_utc", "match_key").withColumn("_part", F.spark_partition_id()))
    sizes = sorted(spread.groupBy("_part").count().collect())
    before, total = {}, 0
    for part, n in sizes:
        before[part] = total
        total += n
    offset = F.try_element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("_part")) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("_part").orderBy("kickoff_utc", "match_key"))
    return spread.withColumns({name: (inside + offset).cast("long"), "_total": F.lit(total).cast("long")}).drop("_part")


def chronological_partition(df: DataFrame, fraction: float, names: tuple[str, str] = ("tuning", "calibration"), least: int = 30) -> DataFrame:
    """Rows up to floor(n * fraction) in order of kickoff and key are the first part; fewer than
    `least` rows are too few to be parted."""
    if not 0.5 <= fraction <= 0.8:
        raise ValueError("fraction must lie in [0.5, 0.8]")
    numbered = number_in_time(df)
    enough = F.when(F.col("_total") < least, F.raise_error(F.lit(f"fewer than {least} rows to part"))).otherwise(True).cast("boolean")
    return numbered.filter(enough).withColumn("part", F.when(F.col("_n") <= F.floor(F.col("_total") * fraction), names[0]).otherwise(names[1])).drop("_n", "_total")


def calibration_partition(df: DataFrame, fraction: float = 0.15, least: int = 30) -> DataFrame:
    """The last max(30, ceil(n * fraction)) rows, widened to whole kickoff times, calibrate."""
    if not 0.05 <= fraction <= 0.3:
        raise ValueError("fraction must lie in [0.05, 0.3]")
    first = F.col("_total") - F.greatest(F.lit(least), F.ceil(F.col("_total") * fraction)) + 1
    boundary = number_in_time(df.select("kickoff_utc", "match_key")).filter(F.col("_n") == first).agg(F.min("kickoff_utc").alias("_from"))
    return df.crossJoin(F.broadcast(boundary)).withColumn("part", F.when(F.col("kickoff_utc") >= F.col("_from"), "calibration").otherwise("training")).drop("_from")


def backtest_folds(df: DataFrame, least_training: int = 2, most: int = 4) -> DataFrame:
    """(fold_number, evaluation_season, role, season) of expanding folds over the last seasons."""
    seasons = season_order(df)
    last = seasons.agg(F.max("position").alias("_last"))
    evaluated = seasons.crossJoin(F.broadcast(last)).filter((F.col("position") > least_training) & (F.col("position") > F.col("_last") - most))
    evaluated = evaluated.select(F.col("season").alias("evaluation_season"), F.col("position").alias("_at"), F.row_number().over(Window.orderBy("position")).cast("long").alias("fold_number"))
    pairs = evaluated.join(F.broadcast(seasons), F.col("position") <= F.col("_at"))
    return pairs.select("fold_number", "evaluation_season", F.when(F.col("position") == F.col("_at"), "evaluation").otherwise("training").alias("role"), "season")


def _duplicates(*keys: str) -> Column:
    return F.count("*") - F.countDistinct(*keys)


def silver_violations(df: DataFrame) -> DataFrame:
    """All rules of the silver layer in one pass."""
    done = F.col("status") == "FINISHED"
    return df.agg(
        F.count("*").alias("row_count"), _duplicates("match_key").alias("duplicate_keys"), F.count_if(F.col("home_team_id") == F.col("away_team_id")).alias("same_team"),
        F.count_if(done & (F.col("home_goals").isNull() | F.col("away_goals").isNull())).alias("missing_score"), F.count_if((F.col("home_goals") < 0) | (F.col("away_goals") < 0)).alias("negative_goals"),
        F.count_if(done & (F.col("full_time_result") != C.result_of(F.col("home_goals"), F.col("away_goals")))).alias("wrong_result"), F.count_if(F.col("match_date").isNull()).alias("missing_date"),
    )


def form_violations(df: DataFrame, window_size: int = 5) -> DataFrame:
    sides = ("home", "away")
    any_of = lambda f: f("home") | f("away")
    results = lambda s: F.col(f"{s}_wins_last_5") + F.col(f"{s}_draws_last_5") + F.col(f"{s}_losses_last_5")
    return df.agg(
        F.count("*").alias("row_count"), _duplicates("match_key").alias("duplicate_keys"), F.count_if(any_of(lambda s: F.col(f"{s}_matches_played_before") < 0)).alias("negative_played"),
        *[F.count_if(F.col(f"{s}_points_last_5") > 3 * window_size).alias(f"{s}_points_over") for s in sides], *[F.count_if(results(s) > window_size).alias(f"{s}_results_over") for s in sides],
    )


SPLITS = ("train", "validation", "test")


def model_violations(df: DataFrame, window_size: int = 5) -> DataFrame:
    """All rules of the model dataset in one pass: keys, targets, expectations, splits and flags."""
    edge = lambda f, split: f(F.when(F.col("split") == split, F.col("kickoff_utc")))
    overlaps = lambda a, b: F.coalesce((edge(F.max, a) >= edge(F.min, b)).cast("int"), F.lit(0))
    expected, of_away = F.col("home_expected_score"), F.col("away_expected_score")
    flags = [F.col(f"{s}_is_cold_start") != (F.col(f"{s}_matches_played_before") == 0) for s in ("home", "away")]
    flags += [F.col(f"{s}_has_limited_history") != (F.col(f"{s}_matches_played_before") < window_size) for s in ("home", "away")]
    wrong = flags[0]
    for f in flags[1:]:
        wrong = wrong | f
    empty = [(F.count_if(F.col("split") == s) == 0).cast("int").alias(f"no_{s}") for s in SPLITS]
    return df.agg(
        F.count("*").alias("row_count"), _duplicates("match_key").alias("duplicate_keys"), F.count_if(~F.col("target").isin(0, 1, 2)).alias("bad_target"), F.count_if(~expected.between(0, 1) | ~of_away.between(0, 1)).alias("bad_expectation"),
        F.count_if(F.abs(expected + of_away - 1) > 1e-9).alias("expectation_sum"), *empty, overlaps("train", "validation").alias("train_overlaps"), overlaps("validation", "test").alias("validation_overlaps"),
        F.count_if(wrong).alias("bad_flag"),
    )


def historical_violations(df: DataFrame) -> DataFrame:
    """All rules of one ingested results file in one pass (empty is a row count of zero)."""
    blank = lambda c: F.coalesce(C.strip_space(F.col(c)), F.lit("")) == ""
    home, away = F.col("home_goals"), F.col("away_goals")
    return df.agg(
        F.count("*").alias("row_count"), _duplicates("match_id").alias("duplicate_keys"), F.count_if(blank("home_team") | blank("away_team")).alias("blank_team"), F.count_if(F.col("home_team") == F.col("away_team")).alias("same_team"),
        F.count_if(home.isNull() | away.isNull()).alias("missing_score"), F.count_if((home < 0) | (away < 0)).alias("negative_goals"),
        F.count_if(~F.col("full_time_result").eqNullSafe(C.result_of(home, away)) & home.isNotNull() & away.isNotNull()).alias("wrong_result"), F.count_if(F.col("match_date").isNull()).alias("missing_date"),
    )


def history_violations(df: DataFrame) -> DataFrame:
    """All rules of team histories in one pass: venue, one row per match and team, points and results."""
    points = F.when(F.col("result") == "W", 3).when(F.col("result") == "D", 1).otherwise(0)
    return df.agg(
        F.count("*").alias("row_count"), F.count_if(~F.coalesce(F.col("venue").isin("home", "away"), F.lit(False))).alias("bad_venue"), _duplicates("match_key", "team_id").alias("duplicate_keys"),
        F.count_if(F.col("team_id") == F.col("opponent_id")).alias("same_team"), F.count_if(F.col("points") != points).alias("bad_points"),
    )


def fold_violations(training: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Both parts of a fold non-empty, and all training before all evaluation, in one row."""
    t = training.agg(F.count("*").alias("row_count"), F.max("kickoff_utc").alias("_last"))
    e = evaluation.agg(F.count("*").alias("_n"), F.min("kickoff_utc").alias("_first"))
    return t.crossJoin(F.broadcast(e)).select("row_count", (F.col("_n") == 0).cast("int").alias("no_evaluation"), F.coalesce((F.col("_last") >= F.col("_first")).cast("int"), F.lit(0)).alias("not_in_order"))


def require_columns(df: DataFrame, columns: tuple[str, ...] | list[str], layer: str) -> DataFrame:
    """The table itself, if it has all the columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise DataQualityError(f"{layer}: missing columns {', '.join(missing)}")
    return df


def null_counts(df: DataFrame) -> DataFrame:
    """One row: how many nulls each column has."""
    return df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])


def split_rows(df: DataFrame, split: str, features: list[str]) -> DataFrame:
    """The labelled rows of a split in order of time, features as a model sees them; none is an error."""
    rows = require_columns(df, ["match_key", "season", "kickoff_utc", "target", "split", *features], split).filter((F.col("split") == split) & F.col("target").isNotNull())
    if rows.isEmpty():
        raise DataQualityError(f"{split}: no labelled rows")
    kept = [c for c in df.columns if c not in features]
    return rows.select(*kept, *[feature(c).alias(c) for c in features]).orderBy("kickoff_utc", "match_key")


def split_triple(df: DataFrame, features: list[str]) -> dict[str, DataFrame]:
    """Train, validation and test rows, each checked."""
    return {s: split_rows(df, s, features) for s in SPLITS}


def require_clean(violations: DataFrame, layer: str) -> None:
    """Raise if a row of violation counts has any."""
    row = violations.first().asDict()
    if not row.pop("row_count"):
        raise DataQualityError(f"{layer}: the table is empty")
    if broken := {k: v for k, v in row.items() if v}:
        raise DataQualityError(f"{layer}: " + ", ".join(f"{v} rows break {k}" for k, v in broken.items()))
