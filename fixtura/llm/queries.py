"""Registered queries of the operators of this subpackage, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.llm import leakage, linkage, ranking, sentences, survivorship, tokenizer
from fixtura.session import table

#: What the project's sources of match records are known to do: the archive is checked after the fact,
#: the feed is live, and the mirrors only copy.
RULES = survivorship.MatchRules(
    trust={"results-archive": 2, "matchfeed-api": 1}, live="matchfeed-api", archive="results-archive", statuses=("SCHEDULED", "TIMED", "IN_PLAY", "PAUSED", "FINISHED", "SUSPENDED", "POSTPONED", "CANCELLED", "AWARDED"),
    unplayed=("SCHEDULED", "TIMED", "POSTPONED", "CANCELLED", "IN_PLAY", "PAUSED", "SUSPENDED"), early=("SCHEDULED", "TIMED", "IN_PLAY", "PAUSED"), awarded="AWARDED", most_goals=30, least_year=1991,
)
SURVIVING = ["kickoff_utc", "status", "home_goals", "away_goals", "full_time_result"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = linkage.link_matches(table(spark, d, "historical_matches"), table(spark, d, "current_matches"), table(spark, d, "competitions"))
    return pairs.select("match_id", "api_match_id")


def p1_confidence(spark: SparkSession, d: str) -> DataFrame:
    pairs = linkage.link_matches(table(spark, d, "historical_matches"), table(spark, d, "current_matches"), table(spark, d, "competitions"))
    return pairs.select("match_id", "api_match_id", F.round("confidence", 3).alias("confidence"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    silver = table(spark, d, "silver_matches")
    golden = survivorship.golden_matches(silver, RULES)
    return survivorship.holders(silver, golden, "match_key", SURVIVING, "record_id")


def p5_golden(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.golden_matches(table(spark, d, "silver_matches"), RULES, ("season", "competition", "home_team_id", "away_team_id")).select(
        "match_key", "season", "competition", "home_team_id", "away_team_id", *SURVIVING, "n"
    )


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    golden = survivorship.golden_matches(table(spark, d, "silver_matches"), RULES, ("home_team_id", "away_team_id"))
    return ranking.rank_items(golden, "home_team_id", "away_team_id", "full_time_result")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.above_widest_gap(_ranking(spark, d)).select(F.col("item").alias("team_id"))


def p7_ranking(spark: SparkSession, d: str) -> DataFrame:
    return _ranking(spark, d).select(F.col("item").alias("team_id"), F.round("strength", 4).alias("strength"), "comparisons")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_documents(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_confidence, p5_found, p5_golden, p7_found, p7_ranking, p8_ids, p9_found, p10_found)
    return {f.__name__: f for f in found}


def _listed(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_RANKED = f"""
    WITH a AS (SELECT *, coalesce(epoch_us(coalesce(last_updated, ingested_at)), -1) AS said, CASE source WHEN 'results-archive' THEN 2 WHEN 'matchfeed-api' THEN 1 ELSE 0 END AS trust, coalesce(status, '') AS st FROM silver_matches WHERE match_key IS NOT NULL),
    b AS (SELECT *, CAST(trust > 0 AND st = 'AWARDED' AS INT) AS awarded, CAST(trust > 0 AS INT) AS trusted, CAST(coalesce(source, '') = 'results-archive' AS INT) AS archived, st NOT IN {_listed(RULES.unplayed)} AS over,
        CAST(NOT coalesce(hour(kickoff_utc) * 60 + minute(kickoff_utc) = 0 AND trust > 0 AND NOT (source = 'matchfeed-api' AND st IN {_listed(RULES.early)}), false) AS INT) AS clean,
        CASE WHEN coalesce(home_goals BETWEEN 0 AND 30 AND away_goals BETWEEN 0 AND 30 AND full_time_result IN ('H', 'D', 'A'), false)
          THEN CASE WHEN CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' ELSE 'D' END = full_time_result THEN 2 ELSE 0 END ELSE 1 END AS agrees FROM a),
    c AS (SELECT *, CAST(agrees > 0 AS INT) AS sound FROM b)
"""


def _best(name: str, usable: str, *ranks: str) -> str:
    return f"max({{'u': CASE WHEN {usable} THEN 1 ELSE 0 END, {', '.join(f"'r{i}': {r}" for i, r in enumerate(ranks))}, 'v': CASE WHEN {usable} THEN {name} END}}).v AS {name}, coalesce(count({name}) <> count(*) AND count({name}) <> 0 OR min({name}) <> max({name}), false) AS {name}_differs"


_SCORE = ("awarded", "sound", "trust", "said", "agrees")
_GOLDEN = f"""{_RANKED}, g AS (SELECT match_key, count(*) AS n, max(season) AS season, max(competition) AS competition, max(home_team_id) AS home_team_id, max(away_team_id) AS away_team_id,
      {_best('kickoff_utc', 'kickoff_utc IS NOT NULL AND year(kickoff_utc) >= 1991', 'clean', 'trusted', 'archived', 'said')}, {_best('status', f'status IN {_listed(RULES.statuses)}', 'trusted', 'awarded', 'said')},
      {_best('home_goals', 'home_goals BETWEEN 0 AND 30 AND over', *_SCORE)}, {_best('away_goals', 'away_goals BETWEEN 0 AND 30 AND over', *_SCORE)}, {_best('full_time_result', "full_time_result IN ('H', 'D', 'A') AND over", *_SCORE)} FROM c GROUP BY match_key),
    gm AS (SELECT * REPLACE (CASE WHEN p THEN home_goals END AS home_goals, CASE WHEN p THEN away_goals END AS away_goals, CASE WHEN p THEN full_time_result END AS full_time_result) FROM (SELECT *, coalesce(status NOT IN {_listed(RULES.unplayed)}, true) AS p FROM g))"""


def oracle_sql() -> dict[str, str]:
    """Of what SQL can say; the others are held against brute force in the tests."""
    held = " UNION ALL ".join(f"SELECT s.match_key, '{f}' AS field_name, min(s.record_id) AS record_id FROM silver_matches s JOIN gm ON gm.match_key = s.match_key WHERE gm.n > 1 AND gm.{f}_differs AND s.{f} = gm.{f} GROUP BY s.match_key" for f in SURVIVING)
    return {
        "p5_found": f"{_GOLDEN} {held}",
        "p5_golden": f"{_GOLDEN} SELECT match_key, season, competition, home_team_id, away_team_id, {', '.join(SURVIVING)}, n FROM gm",
    }
