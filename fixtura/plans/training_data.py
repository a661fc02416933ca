"""Registered queries of the core operators for training data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.operators import asof, raw_records, schema_drift, timestamps
from fixtura.session import table

#: What a team without any known rating has.
START = {"elo": 1500.0, "points_last_5": 0}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    report = schema_drift.drift_report(table(spark, d, "raw_lines"))
    return report.filter("change_kind != 'moved'").select("file_name", "field_name", "change_kind").distinct()


def p2_table(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_lines")
    return schema_drift.consistent_table(raw_records.parse_records(lines, schema_drift.compile_projections(lines)))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return raw_records.bad_lines(raw_records.parse_records(table(spark, d, "raw_lines")))


def p3_rows(spark: SparkSession, d: str) -> DataFrame:
    return raw_records.good_rows(raw_records.parse_records(table(spark, d, "raw_lines")))


def features_as_known(spark: SparkSession, d: str) -> DataFrame:
    """(match_key, side, elo, points_last_5, given) of both teams of each match: what was known at its
    kickoff, and what the match says. The match's own values go through the join, not beside it."""
    matches = table(spark, d, "model_dataset")
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_elo_pre").alias("given_elo"), F.col(f"{s}_points_last_5").alias("given_points")) for s in ("home", "away")]))
    events = matches.filter("match_key is not null").select(sides.alias("e"), "match_key", "kickoff_utc").select("match_key", "kickoff_utc", "e.*")
    known = asof.state_as_of(events, table(spark, d, "team_ratings"), "team_id", "match_key", "kickoff_utc", ["elo", "points_last_5"], order_by=["rating_id"], kept=["side", "given_elo", "given_points"])
    value = lambda c: F.when(F.col("known"), F.col(c)).otherwise(F.lit(START[c])).alias(c)
    return known.select(F.col("event_id").alias("match_key"), "side", value("elo"), value("points_last_5"), "given_elo", "given_points")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    known = features_as_known(spark, d)
    checks = F.array(
        F.struct(F.concat("side", F.lit("_elo_pre")).alias("field_name"), F.col("given_elo").eqNullSafe(F.col("elo")).alias("ok")),
        F.struct(F.concat("side", F.lit("_points_last_5")).alias("field_name"), F.col("given_points").eqNullSafe(F.col("points_last_5").cast("long")).alias("ok")),
    )
    return known.select("match_key", F.explode(checks).alias("c")).filter("not c.ok").select("match_key", "c.field_name").distinct()


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    return features_as_known(spark, d).select("match_key", "side", "elo", F.col("points_last_5").cast("long").alias("points_last_5"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return timestamps.normalise_times(table(spark, d, "feed_times"), "record_id", "feed", "feed_zone", ["match_date"], ["kickoff_utc", "last_updated"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_table, p3_found, p3_rows, p4_found, p4_features, p6_found)}


_KNOWN = """
    WITH e AS (SELECT match_key, 'home' AS side, home_team_id AS team_id, kickoff_utc AS k, home_elo_pre AS ge, home_points_last_5 AS gp FROM model_dataset
               UNION ALL SELECT match_key, 'away', away_team_id, kickoff_utc, away_elo_pre, away_points_last_5 FROM model_dataset),
    v AS (SELECT e.match_key, e.side, arg_max(struct_pack(elo := elo, p := points_last_5), struct_pack(a := valid_from, b := recorded_at, c := rating_id)) AS s
          FROM e JOIN team_ratings r ON r.team_id = e.team_id AND r.valid_from <= e.k AND r.recorded_at <= e.k GROUP BY ALL),
    w AS (SELECT e.*, CASE WHEN v.match_key IS NULL THEN 1500.0 ELSE v.s.elo END AS elo, CASE WHEN v.match_key IS NULL THEN 0 ELSE v.s.p END AS points
          FROM e LEFT JOIN v ON v.match_key = e.match_key AND v.side = e.side)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": _KNOWN
        + """SELECT DISTINCT match_key, side || '_elo_pre' AS field_name FROM w WHERE ge IS DISTINCT FROM elo
             UNION SELECT DISTINCT match_key, side || '_points_last_5' FROM w WHERE gp IS DISTINCT FROM points""",
        "p4_features": _KNOWN + "SELECT match_key, side, CAST(elo AS DOUBLE) AS elo, CAST(points AS BIGINT) AS points_last_5 FROM w",
    }
