"""Queries of the match pipeline over the driver's tables, each with its SQL oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.functions import match_columns as C
from fixtura.operators import elo, evaluation, form, gold, models, probability, silver
from fixtura.session import table
from fixtura.sources import layers, payloads

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
VALIDATION, TEST = "2000", "2001"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def matches(spark: SparkSession, d: str) -> DataFrame:
    """`orders` as fixtures, by integer arithmetic; some finished ones lack their score."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    open_ = F.col("o_orderstatus") == "P"
    goals = lambda a, m: F.when(~open_ & (key % 97 != 0), (key * a + cust) % m)
    name = lambda n: F.concat(F.lit("team-"), F.lpad(n.cast("string"), 2, "0"))
    m = table(spark, d, "orders").select(
        F.lpad(key.cast("string"), 12, "0").alias("match_key"), F.year("o_orderdate").cast("string").alias("season"), F.concat(F.lit("League "), (cust % 3).cast("string")).alias("competition"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("kickoff_utc"), F.to_date("o_orderdate").alias("match_date"), F.when(open_, "TIMED").otherwise("FINISHED").alias("status"),
        name(cust % 20).alias("home_team_id"), name((cust % 20 + 1 + key % 19) % 20).alias("away_team_id"), goals(7, 5).alias("home_goals"), goals(3, 4).alias("away_goals"),
    )
    return m.withColumn("full_time_result", C.result_of(F.col("home_goals"), F.col("away_goals")))


M = """
  m AS (SELECT *, CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' WHEN home_goals = away_goals THEN 'D' END AS full_time_result FROM (
    SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS match_key, CAST(year(o_orderdate) AS VARCHAR) AS season, 'League ' || CAST(o_custkey % 3 AS VARCHAR) AS competition,
      o_orderdate AS kickoff_utc, CAST(o_orderdate AS DATE) AS match_date, CASE WHEN o_orderstatus = 'P' THEN 'TIMED' ELSE 'FINISHED' END AS status,
      'team-' || lpad(CAST(o_custkey % 20 AS VARCHAR), 2, '0') AS home_team_id, 'team-' || lpad(CAST((o_custkey % 20 + 1 + o_orderkey % 19) % 20 AS VARCHAR), 2, '0') AS away_team_id,
      CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 97 <> 0 THEN (o_orderkey * 7 + o_custkey) % 5 END AS home_goals, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 97 <> 0 THEN (o_orderkey * 3 + o_custkey) % 4 END AS away_goals
    FROM orders))"""
H = """
  h AS (SELECT match_key, season, kickoff_utc, 'home' AS venue, home_team_id AS team_id, away_team_id AS opponent_id, home_goals AS goals_for, away_goals AS goals_against,
      home_goals - away_goals AS goal_difference, CASE full_time_result WHEN 'H' THEN 'W' WHEN 'D' THEN 'D' ELSE 'L' END AS result FROM m WHERE status = 'FINISHED' AND home_goals IS NOT NULL AND away_goals IS NOT NULL
    UNION ALL SELECT match_key, season, kickoff_utc, 'away', away_team_id, home_team_id, away_goals, home_goals, away_goals - home_goals,
      CASE full_time_result WHEN 'A' THEN 'W' WHEN 'D' THEN 'D' ELSE 'L' END FROM m WHERE status = 'FINISHED' AND home_goals IS NOT NULL AND away_goals IS NOT NULL),
  hp AS (SELECT *, CAST(CASE result WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END AS BIGINT) AS points, CAST(result = 'W' AS BIGINT) AS is_win, CAST(result = 'D' AS BIGINT) AS is_draw, CAST(result = 'L' AS BIGINT) AS is_loss FROM h)"""


def _form_sql(n: int) -> str:
    last = f"OVER (PARTITION BY team_id ORDER BY kickoff_utc, match_key ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    sums = ", ".join(f"CAST(coalesce(sum({c}) {last}, 0) AS BIGINT) AS {a}" for c, a in zip(form.SUMS, form.NAMES, strict=True))
    return f""", f AS (SELECT *, round(CASE WHEN least(matches_played_before, {n}) = 0 THEN 0.0 ELSE points_last_5 / least(matches_played_before, {n}) END, 6) AS average_points_last_5
      FROM (SELECT hp.*, CAST(row_number() OVER (PARTITION BY team_id ORDER BY kickoff_utc, match_key) - 1 AS BIGINT) AS matches_played_before, {sums} FROM hp))"""


FORM_COLUMNS = ["match_key", "team_id", "venue", "matches_played_before", *form.NAMES, "average_points_last_5"]


@query(f"WITH {M} SELECT * FROM m")
def match_adapter(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d)


@query("""WITH r AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 5 END AS hg FROM orders)
    SELECT sha256('2019/20|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|Team ' || CAST(o_custkey AS VARCHAR) || '|Team ' || CAST(o_custkey + 1 AS VARCHAR)) AS match_id, '2019/20' AS season, 'Premier League' AS competition, CAST(o_orderdate AS DATE) AS match_date, '12:30' AS kickoff_time,
    'Team ' || CAST(o_custkey AS VARCHAR) AS home_team, 'Team ' || CAST(o_custkey + 1 AS VARCHAR) AS away_team, hg AS home_goals, o_custkey % 4 AS away_goals, o_orderstatus AS full_time_result, o_orderkey % 7 AS home_shots, o_orderkey % 3 AS away_red_cards, 'football-data.co.uk' AS source FROM r""")
def historical_normalise(spark: SparkSession, d: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(key % 3 == 0, F.date_format(day, "dd/MM/yyyy")).when(key % 3 == 1, F.date_format(day, "yyyy-MM-dd")).otherwise(F.concat(F.lit(" "), F.date_format(day, "dd/MM/yyyy"), F.lit("\t")))
    raw = table(spark, d, "orders").select(
        text.alias("Date"), F.lit("12:30").alias("Time"), F.concat(F.lit("\t Team "), F.col("o_custkey").cast("string"), F.lit(" ")).alias("HomeTeam"), F.concat(F.lit("Team "), (F.col("o_custkey") + 1).cast("string")).alias("AwayTeam"),
        F.when(key % 11 == 0, "n/a").otherwise((key % 5).cast("string")).alias("FTHG"), F.concat(F.lit(" "), (F.col("o_custkey") % 4).cast("string")).alias("FTAG"), F.lower("o_orderstatus").alias("FTR"), (key % 7).cast("string").alias("HS"), (key % 3).cast("string").alias("AR"), F.lit("x").alias("Referee"),
    )
    return silver.normalise_historical(raw, 2019).drop("ingested_at")


@query("""SELECT 'football-data.org:' || event_id AS match_id, event_id AS api_match_id, 7::BIGINT AS competition_id, 'AAA' AS competition_code, user_id AS home_team_id, CASE WHEN event_id % 5 <> 0 THEN 'Home ' || user_id END AS home_team, CASE WHEN event_id % 5 <> 0 THEN 'H' || user_id % 10 END AS home_team_tla,
    CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS home_goals, CAST(event_id % 3 AS BIGINT) AS away_goals, CASE WHEN event_id % 3 = 0 THEN NULL WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > event_id % 3 THEN 'H'
    WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) < event_id % 3 THEN 'A' ELSE 'D' END AS full_time_result, date_trunc('second', ts) AS kickoff_utc, 'REGULAR' AS duration, CAST(year(ts) AS VARCHAR) || '/' || lpad(CAST((year(ts) + 1) % 100 AS VARCHAR), 2, '0') AS season FROM events WHERE event_id % 13 <> 0""")
def json_flatten_current(spark: SparkSession, d: str) -> DataFrame:
    """Payloads with missing objects, scores that are no numbers, and entries that are no objects."""
    e, k = table(spark, d, "events"), F.col("event_id").cast("string")
    score = F.concat(F.lit('{"duration": "REGULAR", "fullTime": {"home": '), F.when(F.col("event_id") % 3 == 0, '"abandoned"').otherwise(F.get_json_object("props", "$.k")), F.lit(', "away": '), (F.col("event_id") % 3).cast("string"), F.lit("}}"))
    home = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"id": '), F.col("user_id").cast("string"), F.lit("}"))).otherwise(F.concat(F.lit('{"id": '), F.col("user_id").cast("string"), F.lit(', "name": "Home '), F.col("user_id").cast("string"), F.lit('", "tla": "H'), (F.col("user_id") % 10).cast("string"), F.lit('"}')))
    one = F.concat(F.lit('{"id": '), k, F.lit(', "utcDate": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", "season": {"startDate": "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"}, "homeTeam": '), home, F.lit(', "awayTeam": null, "score": '), score, F.lit("}"))
    payload = F.concat(F.lit('{"competition": {"id": 7, "code": "AAA"}, "matches": ['), F.when(F.col("event_id") % 13 == 0, "17").otherwise(one), F.lit("]}"))
    kept = ["match_id", "api_match_id", "competition_id", "competition_code", "home_team_id", "home_team", "home_team_tla", "home_goals", "away_goals", "full_time_result", "duration", "season"]
    return payloads.flatten_matches(e.select(payload.alias("payload"))).select(*kept, F.col("kickoff_utc").cast("timestamp_ntz").alias("kickoff_utc"))


@query("""SELECT n_regionkey AS group_id, 'TOTAL' AS standing_type, CAST(n_nationkey AS BIGINT) AS team_id, n_name AS team, CAST(n_nationkey * 2 AS BIGINT) AS points, CAST(n_nationkey % 4 AS BIGINT) AS won, 'W,D' AS form, '2023/24' AS season FROM nation WHERE n_nationkey <> 3""")
def json_flatten_standings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey").cast("string")
    row = F.when(F.col("n_nationkey") == 3, "null").otherwise(F.concat(F.lit('{"form": "W,D", "team": {"id": '), k, F.lit(', "name": "'), F.col("n_name"), F.lit('"}, "won": '), (F.col("n_nationkey") % 4).cast("string"), F.lit(', "points": '), (F.col("n_nationkey") * 2).cast("string"), F.lit("}")))
    groups = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(row).alias("rows"))
    payload = F.concat(F.lit('{"season": {"startDate": "2023-08-11"}, "standings": [5, {"type": "HOME"}, {"type": "TOTAL", "table": ['), F.array_join("rows", ","), F.lit("]}]}"))
    return payloads.flatten_standings(groups.select(F.col("n_regionkey").alias("group_id"), payload.alias("payload")), ["group_id"]).select("group_id", "standing_type", "team_id", "team", "points", "won", "form", "season")


def _noisy(spark: SparkSession, d: str) -> DataFrame:
    """Fixtures between nations under noisy spellings, some unknown."""
    n = table(spark, d, "nation")
    names = n.select(F.col("n_nationkey").alias("k"), "n_name")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).cast("int").alias("h"), ((F.col("o_custkey") + 1 + F.col("o_orderkey") % 24) % 25).cast("int").alias("a"))
    spell = lambda c, i: F.when(i % 3 == 0, F.concat(F.lit("  "), F.lower(c), F.lit("\t"))).when(i % 3 == 1, F.replace(c, F.lit(" "), F.lit("   "))).otherwise(c)
    j = o.join(F.broadcast(names.select(F.col("k").alias("h"), F.col("n_name").alias("hn"))), "h").join(F.broadcast(names.select(F.col("k").alias("a"), F.col("n_name").alias("an"))), "a")
    return j.select("id", spell(F.col("hn"), F.col("id")).alias("home_team"), spell(F.col("an"), F.col("id") + 1).alias("away_team"))


def _aliases(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").filter("n_nationkey != 7").select(C.normalise_alias(F.col("n_name")).alias("alias"), F.initcap("n_name").alias("canonical"))


NATION_PAIRS = "SELECT o_orderkey AS id, h.n_name AS hn, h.n_nationkey AS hk, a.n_name AS an, a.n_nationkey AS ak FROM orders JOIN nation h ON h.n_nationkey = o_custkey % 25 JOIN nation a ON a.n_nationkey = (o_custkey + 1 + o_orderkey % 24) % 25"


@query(f"WITH p AS ({NATION_PAIRS}) SELECT id, CASE WHEN hk <> 7 THEN lower(replace(hn, ' ', '-')) END AS home_team_id, CASE WHEN ak <> 7 THEN lower(replace(an, ' ', '-')) END AS away_team_id FROM p")
def alias_canonicalise(spark: SparkSession, d: str) -> DataFrame:
    return silver.canonicalise_teams(_noisy(spark, d), _aliases(spark, d)).select("id", "home_team_id", "away_team_id")


@query("SELECT DISTINCT lower(n_name) AS team FROM nation WHERE n_nationkey = 7 AND (SELECT count(*) FROM orders) > 0")
def unknown_teams(spark: SparkSession, d: str) -> DataFrame:
    unknown = silver.find_unknown_teams(_noisy(spark, d), _aliases(spark, d))
    return unknown.select(C.normalise_alias(F.col("team")).alias("team")).distinct()


@query(f"WITH {M} SELECT match_key AS id, sha256(season || '|' || competition || '|' || CAST(match_date AS VARCHAR) || '|' || home_team_id || '|' || away_team_id) AS match_key FROM m")
def match_keys(spark: SparkSession, d: str) -> DataFrame:
    return silver.add_match_keys(matches(spark, d).withColumnRenamed("match_key", "id")).select("id", "match_key")


def _two_sources(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    late = F.expr("kickoff_utc + make_interval(0, 0, 0, 1)")
    return m.withColumns({"source": F.lit("football-data.co.uk"), "ingested_at": F.col("kickoff_utc")}).unionByName(m.filter("match_key % 2 = 0").withColumns({"source": F.lit("football-data.org"), "ingested_at": late})).unionByName(
        m.filter("match_key % 3 = 0").withColumns({"source": F.lit("football-data.co.uk"), "ingested_at": late})
    )


TWO = """t AS (SELECT *, 'football-data.co.uk' AS source, kickoff_utc AS ingested_at FROM m UNION ALL SELECT *, 'football-data.org', kickoff_utc + INTERVAL 1 DAY FROM m WHERE CAST(match_key AS BIGINT) % 2 = 0
    UNION ALL SELECT *, 'football-data.co.uk', kickoff_utc + INTERVAL 1 DAY FROM m WHERE CAST(match_key AS BIGINT) % 3 = 0)"""


@query(f"""WITH {M}, {TWO} SELECT match_key, source, ingested_at FROM (SELECT *, row_number() OVER (PARTITION BY match_key ORDER BY CASE source WHEN 'football-data.org' THEN 2 WHEN 'football-data.co.uk' THEN 1 ELSE 0 END DESC, ingested_at DESC) AS n FROM t) WHERE n = 1""")
def dedup_matches(spark: SparkSession, d: str) -> DataFrame:
    return silver.deduplicate(_two_sources(spark, d)).select("match_key", "source", "ingested_at")


@query(f"""WITH {M}, {TWO} SELECT source, count(*) AS row_count, count(DISTINCT season) AS seasons, min(match_date) AS first_date, max(match_date) AS last_date FROM t GROUP BY source""")
def silver_report(spark: SparkSession, d: str) -> DataFrame:
    return _two_sources(spark, d).groupBy("source").agg(F.count("*").alias("row_count"), F.countDistinct("season").alias("seasons"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"))


@query(f"""WITH {M} SELECT match_key, CAST(CASE full_time_result WHEN 'H' THEN 3 WHEN 'D' THEN 1 WHEN 'A' THEN 0 END AS BIGINT) AS home_points,
    CAST(CASE full_time_result WHEN 'A' THEN 3 WHEN 'D' THEN 1 WHEN 'H' THEN 0 END AS BIGINT) AS away_points, home_goals - away_goals AS home_goal_difference FROM m""")
def match_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return silver.add_outcomes(matches(spark, d)).select("match_key", "home_points", "away_points", "home_goal_difference")


@query(f"WITH {M} SELECT home_team_id AS team_id, upper(home_team_id) AS team_name FROM m UNION SELECT away_team_id, upper(away_team_id) FROM m")
def team_dimension(spark: SparkSession, d: str) -> DataFrame:
    return silver.team_dimension(matches(spark, d).withColumns({"home_team": F.upper("home_team_id"), "away_team": F.upper("away_team_id")}))


@query(f"WITH {M} SELECT match_key, season, NULL::BIGINT AS home_goals FROM m UNION ALL SELECT match_key, NULL, home_goals FROM m")
def union_relaxed(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    return silver.union_relaxed(m.select("match_key", "season"), m.select("match_key", "home_goals"))


@query(f"WITH {M}, {TWO} SELECT match_key, kickoff_utc, CAST(CAST(match_date AS TIMESTAMP) AS TIMESTAMP) AS midnight, 'FINISHED' AS status FROM t WHERE source = 'football-data.co.uk'")
def prepare_historical(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_sources(spark, d).filter("source = 'football-data.co.uk'").withColumns({"home_team": F.col("home_team_id"), "away_team": F.col("match_key"), "competition": F.date_format("kickoff_utc", "yyyy-MM-dd HH:mm:ss")})
    out = silver.prepare_historical(rows)
    return out.select(F.col("away_team").alias("match_key"), F.to_timestamp_ntz("competition", F.lit("yyyy-MM-dd HH:mm:ss")).alias("kickoff_utc"), F.col("kickoff_utc").alias("midnight"), "status")


@query(f"WITH {M}, {TWO} SELECT match_key, match_date, CASE WHEN season = '1999' THEN 'Premier League' ELSE competition END AS competition FROM t WHERE source = 'football-data.org'")
def prepare_current(spark: SparkSession, d: str) -> DataFrame:
    rows = _two_sources(spark, d).filter("source = 'football-data.org'").drop("match_date").withColumns({"home_team": F.col("home_team_id"), "away_team": F.col("match_key"), "competition": F.when(F.col("season") != "1999", F.col("competition"))})
    return silver.prepare_current(rows).select(F.col("away_team").alias("match_key"), "match_date", "competition")


@query(f"WITH {M} SELECT match_key, round(1 / (1 + pow(10.0, -((1400 + CAST(match_key AS BIGINT) % 300) + 60.0 - (1400 + CAST(match_key AS BIGINT) % 170)) / 400.0)), 9) AS home_expected_score FROM m")
def expected_score(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("match_key").cast("long")
    return matches(spark, d).select("match_key", F.round(C.expected_home_score(1400 + k % 300, 1400 + k % 170), 9).alias("home_expected_score"))


@query(f"WITH {M} SELECT DISTINCT season, season || '/' || lpad(CAST((CAST(season AS INT) + 1) % 100 AS VARCHAR), 2, '0') AS label, lpad(CAST(CAST(season AS INT) % 100 AS VARCHAR), 2, '0') || lpad(CAST((CAST(season AS INT) + 1) % 100 AS VARCHAR), 2, '0') AS code FROM m")
def season_codes(spark: SparkSession, d: str) -> DataFrame:
    year = F.col("season").cast("int")
    return matches(spark, d).select("season", C.season_label(year).alias("label"), C.season_code(year).alias("code")).distinct()


@query(f"WITH {M}, {H} SELECT match_key, venue, team_id, opponent_id, goals_for, goals_against, goal_difference, result, points, is_win, is_draw, is_loss FROM hp")
def team_history(spark: SparkSession, d: str) -> DataFrame:
    return form.team_history(matches(spark, d)).drop("season", "kickoff_utc")


@query(f"""WITH {M}, {H} SELECT match_key, team_id, CAST(CASE WHEN p IS NULL THEN NULL ELSE floor((epoch_us(kickoff_utc) - epoch_us(p)) / 86400000000) END AS BIGINT) AS rest_days
    FROM (SELECT *, lag(kickoff_utc) OVER (PARTITION BY team_id ORDER BY kickoff_utc, match_key) AS p FROM hp)""")
def rest_days(spark: SparkSession, d: str) -> DataFrame:
    return form.rest_days(form.team_history(matches(spark, d))).select("match_key", "team_id", "rest_days")


def _form(spark: SparkSession, d: str, n: int) -> DataFrame:
    return form.rolling_form(form.team_history(matches(spark, d)), n)


@query(f"WITH {M}, {H} {_form_sql(5)} SELECT {', '.join(FORM_COLUMNS)} FROM f")
def rolling_form(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, 5).withColumn("average_points_last_5", F.round("average_points_last_5", 6)).select(*FORM_COLUMNS)


@query(f"WITH {M}, {H} {_form_sql(3)} SELECT {', '.join(FORM_COLUMNS)} FROM f")
def rolling_form_window3(spark: SparkSession, d: str) -> DataFrame:
    return _form(spark, d, 3).withColumn("average_points_last_5", F.round("average_points_last_5", 6)).select(*FORM_COLUMNS)


def _sides(columns: list[str]) -> str:
    return ", ".join(f"coalesce({v[0]}.{c}, 0) AS {v}_{c}" for v in ("home", "away") for c in columns)


FORM_FEATURES = ["matches_played_before", *form.NAMES, "average_points_last_5"]
REST = "fr AS (SELECT f.*, CAST(floor((epoch_us(kickoff_utc) - epoch_us(lag(kickoff_utc) OVER (PARTITION BY team_id ORDER BY kickoff_utc, match_key))) / 86400000000) AS BIGINT) AS days FROM f)"
WIDE = f"""{M}, {H} {_form_sql(5)}, {REST}, w AS (SELECT m.*, {_sides(FORM_FEATURES)}, h.days AS home_days_since_previous_match, a.days AS away_days_since_previous_match FROM m
    LEFT JOIN fr h ON h.match_key = m.match_key AND h.venue = 'home' LEFT JOIN fr a ON a.match_key = m.match_key AND a.venue = 'away')"""
WIDE_COLUMNS = [f"{v}_{c}" for v in ("home", "away") for c in [*FORM_FEATURES, "days_since_previous_match"]]
_GAPS = ", ".join(f"round(home_{c} - away_{c}, 6) AS {name}" if "average" in c else f"home_{c} - away_{c} AS {name}" for name, c in form.DIFFERENCES.items())


def _match_form(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    return form.match_form(m, form.rolling_form(form.rest_days(form.team_history(m))))


@query(f"WITH {WIDE} SELECT match_key, {', '.join(WIDE_COLUMNS)}, {_GAPS} FROM w")
def match_form(spark: SparkSession, d: str) -> DataFrame:
    rounded = {c: F.round(c, 6) for c in ("home_average_points_last_5", "away_average_points_last_5", "average_form_difference")}
    return _match_form(spark, d).withColumns(rounded).select("match_key", *WIDE_COLUMNS, *form.DIFFERENCES)


@query(f"""WITH {M}, {H}, pl AS (SELECT team_id, row_number() OVER w AS pn, sum(points) OVER (w ROWS UNBOUNDED PRECEDING) AS cs FROM hp WINDOW w AS (PARTITION BY team_id ORDER BY kickoff_utc, match_key, venue)),
    al AS (SELECT match_key, kickoff_utc, venue AS side, team_id, points FROM hp UNION ALL SELECT match_key, kickoff_utc, 'home', home_team_id, NULL FROM m WHERE status <> 'FINISHED' UNION ALL SELECT match_key, kickoff_utc, 'away', away_team_id, NULL FROM m WHERE status <> 'FINISHED'),
    ak AS (SELECT *, count(points) OVER (PARTITION BY team_id ORDER BY kickoff_utc, match_key, side ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM al)
    SELECT ak.match_key, side, CAST(coalesce(a.cs, 0) - coalesce(b.cs, 0) AS BIGINT) AS points_last FROM ak LEFT JOIN pl a ON a.team_id = ak.team_id AND a.pn = k LEFT JOIN pl b ON b.team_id = ak.team_id AND b.pn = k - 5""")
def form_as_of(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    return form.form_as_of(m, form.team_history(m))


#: The fold as a recursion over the matches in order, with the ratings of the twenty teams as a list.
_TEAM = "CAST(right({0}_team_id, 2) AS INT) + 1"
ELO = f"""{M}, eo AS MATERIALIZED (SELECT row_number() OVER (ORDER BY kickoff_utc, match_key) AS n, match_key, {_TEAM.format('home')} AS h, {_TEAM.format('away')} AS a,
    CASE WHEN status = 'FINISHED' AND home_goals IS NOT NULL AND away_goals IS NOT NULL THEN CASE WHEN home_goals > away_goals THEN 1.0::DOUBLE WHEN home_goals = away_goals THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END END AS s FROM m),
  ee AS (SELECT 0::BIGINT AS n, list_transform(range(20), lambda x: 1500.0::DOUBLE) AS r, NULL::VARCHAR AS match_key, 0.0::DOUBLE AS hp, 0.0::DOUBLE AS ap, 0.0::DOUBLE AS x, NULL::DOUBLE AS s, 0.0::DOUBLE AS c
    UNION ALL SELECT q.n, list_transform(q.r, lambda v, i: v + CASE WHEN i = q.h THEN q.c WHEN i = q.a THEN -q.c ELSE 0.0::DOUBLE END), q.match_key, q.hp, q.ap, q.x, q.s, q.c FROM (
      SELECT p.*, coalesce(20.0 * (p.s - p.x), 0.0) AS c FROM (SELECT eo.n, eo.match_key, eo.h, eo.a, eo.s, ee.r, ee.r[eo.h] AS hp, ee.r[eo.a] AS ap, 1 / (1 + pow(10.0, -(ee.r[eo.h] + 60.0 - ee.r[eo.a]) / 400.0)) AS x FROM ee JOIN eo ON eo.n = ee.n + 1) p) q),
  el AS (SELECT match_key, hp AS home_elo_pre, ap AS away_elo_pre, hp - ap AS elo_difference, x AS home_expected_score, 1 - x AS away_expected_score, s AS actual_home, c AS home_elo_change, -c AS away_elo_change, hp + c AS home_elo_post, ap - c AS away_elo_post FROM ee WHERE n > 0)"""


def _elo(spark: SparkSession, d: str) -> DataFrame:
    return elo.elo_history(matches(spark, d))


@query(f"WITH RECURSIVE {ELO} SELECT match_key, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in elo.COLUMNS[1:])} FROM el")
def elo_history(spark: SparkSession, d: str) -> DataFrame:
    return _elo(spark, d).select("match_key", *[F.round(c, 6).alias(c) for c in elo.COLUMNS[1:]])


@query(f"""WITH {M} SELECT count(*) + count(nullif(CAST(match_key AS BIGINT) % 50 = 0, false)) AS row_count, count(nullif(CAST(match_key AS BIGINT) % 50 = 0, false)) AS duplicate_keys, 2 * count(nullif(CAST(match_key AS BIGINT) % 300 = 0, false)) + count(nullif(CAST(match_key AS BIGINT) % 60 = 0 AND CAST(match_key AS BIGINT) % 300 <> 0, false)) AS outside_unit,
    2 * count(nullif(CAST(match_key AS BIGINT) % 300 = 0, false)) + count(nullif(CAST(match_key AS BIGINT) % 60 = 0 AND CAST(match_key AS BIGINT) % 300 <> 0, false)) AS not_one,
    2 * count(nullif(CAST(match_key AS BIGINT) % 350 = 0, false)) + count(nullif(CAST(match_key AS BIGINT) % 70 = 0 AND CAST(match_key AS BIGINT) % 350 <> 0, false)) AS not_conserved FROM m""")
def elo_invariants(spark: SparkSession, d: str) -> DataFrame:
    """Counted on a history with planted faults."""
    k = F.col("match_key").cast("long")
    history = _elo(spark, d).withColumns({"home_expected_score": F.when(k % 60 == 0, F.col("home_expected_score") + 1).otherwise(F.col("home_expected_score")), "away_elo_post": F.when(k % 70 == 0, F.col("away_elo_post") + 1).otherwise(F.col("away_elo_post"))})
    return elo.elo_invariants(history.unionByName(history.filter(k % 50 == 0)))


def _model(spark: SparkSession, d: str) -> DataFrame:
    """Form and ratings of each match with target, flags and split."""
    m = elo.match_elo(_match_form(spark, d), _elo(spark, d).select("match_key", "home_elo_pre", "away_elo_pre", "elo_difference", "home_expected_score", "away_expected_score"))
    return gold.assign_splits(gold.cold_start_flags(m.withColumn("target", C.target_of(F.col("full_time_result")))), VALIDATION, TEST)


MODEL = f"""{ELO.replace(M, WIDE)}, md AS (SELECT w.*, el.home_elo_pre, el.away_elo_pre, el.elo_difference, el.home_expected_score, el.away_expected_score, CAST(CASE full_time_result WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'H' THEN 2 END AS BIGINT) AS target,
    CASE WHEN season = '{VALIDATION}' THEN 'validation' WHEN season = '{TEST}' THEN 'test' WHEN season < '{VALIDATION}' THEN 'train' ELSE 'future' END AS split, home_matches_played_before = 0 AS home_is_cold_start, away_matches_played_before = 0 AS away_is_cold_start,
    home_matches_played_before < 5 AS home_has_limited_history, away_matches_played_before < 5 AS away_has_limited_history FROM w JOIN el USING (match_key))"""
_ROUNDED = ("home_elo_pre", "away_elo_pre", "elo_difference", "home_expected_score", "away_expected_score")
_MODEL_KEPT = ["match_key", "season", "split", "target", "home_points_last_5", "away_points_last_5", "home_is_cold_start", "away_is_cold_start", "home_has_limited_history", "away_has_limited_history", "rest_days_difference"]


@query(f"WITH RECURSIVE {MODEL} SELECT {', '.join(c for c in _MODEL_KEPT if c != 'rest_days_difference')}, home_days_since_previous_match - away_days_since_previous_match AS rest_days_difference, {', '.join(f'round({c}, 6) AS {c}' for c in _ROUNDED)} FROM md")
def model_dataset(spark: SparkSession, d: str) -> DataFrame:
    return _model(spark, d).select(*_MODEL_KEPT, *[F.round(c, 6).alias(c) for c in _ROUNDED])


@query(f"WITH {M} SELECT match_key, CAST(CASE full_time_result WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'H' THEN 2 END AS BIGINT) AS target FROM m")
def target_encoding(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).select("match_key", C.target_of(F.col("full_time_result")).alias("target"))


@query(f"WITH {WIDE} SELECT match_key, home_matches_played_before = 0 AS home_is_cold_start, home_matches_played_before < 5 AS home_has_limited_history, away_matches_played_before = 0 AS away_is_cold_start, away_matches_played_before < 5 AS away_has_limited_history FROM w")
def cold_start_flags(spark: SparkSession, d: str) -> DataFrame:
    flagged = gold.cold_start_flags(_match_form(spark, d))
    return flagged.select("match_key", "home_is_cold_start", "home_has_limited_history", "away_is_cold_start", "away_has_limited_history")


SPLIT = f"{M}, sp AS (SELECT m.*, CASE WHEN season = '{VALIDATION}' THEN 'validation' WHEN season = '{TEST}' THEN 'test' WHEN season < '{VALIDATION}' THEN 'train' ELSE 'future' END AS split, CAST(CASE full_time_result WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'H' THEN 2 END AS BIGINT) AS target FROM m)"


def _split(spark: SparkSession, d: str) -> DataFrame:
    return gold.assign_splits(matches(spark, d).withColumn("target", C.target_of(F.col("full_time_result"))), VALIDATION, TEST)


@query(f"WITH {SPLIT} SELECT match_key, split FROM sp")
def season_splits(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).select("match_key", "split")


@query(f"WITH {SPLIT} SELECT match_key, split, target, coalesce(CAST(home_goals AS DOUBLE), 0.0) AS home_goals FROM sp WHERE target IS NOT NULL AND split IN ('train', 'validation', 'test')")
def split_rows(spark: SparkSession, d: str) -> DataFrame:
    parts = gold.split_triple(_split(spark, d), ["home_goals"])
    return silver.union_relaxed(*parts.values()).select("match_key", "split", "target", "home_goals")


@query(f"WITH {SPLIT} SELECT split, count(*) AS row_count, min(kickoff_utc) AS first_kickoff, max(kickoff_utc) AS last_kickoff, count(DISTINCT season) AS seasons FROM sp GROUP BY split")
def split_summary(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).groupBy("split").agg(F.count("*").alias("row_count"), F.min("kickoff_utc").alias("first_kickoff"), F.max("kickoff_utc").alias("last_kickoff"), F.countDistinct("season").alias("seasons"))


@query(f"WITH {SPLIT} SELECT split, target, count(*) AS row_count FROM sp GROUP BY split, target")
def target_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _split(spark, d).groupBy("split", "target").agg(F.count("*").alias("row_count"))


@query(f"WITH {WIDE} SELECT match_key, CAST(home_points_last_5 AS DOUBLE) AS f1, coalesce(CAST(home_goals AS DOUBLE), 0.0) AS f2, CAST(home_matches_played_before = 0 AS DOUBLE) AS f3 FROM w")
def feature_frame(spark: SparkSession, d: str) -> DataFrame:
    m = gold.cold_start_flags(_match_form(spark, d))
    return m.select("match_key", gold.feature("home_points_last_5").alias("f1"), gold.feature("home_goals").alias("f2"), gold.feature("home_is_cold_start").alias("f3"))


#: Faults planted by key: what a validator must count.
BROKEN = f"""{M}, bm AS (SELECT match_key, season, kickoff_utc, CASE WHEN k % 90 <> 0 THEN match_date END AS match_date, status, home_team_id, CASE WHEN k % 60 = 0 THEN home_team_id ELSE away_team_id END AS away_team_id, CASE WHEN k % 70 = 0 THEN -1 ELSE home_goals END AS home_goals, away_goals,
    CASE WHEN k % 50 = 0 THEN 'D' ELSE full_time_result END AS full_time_result FROM (SELECT *, CAST(match_key AS BIGINT) AS k FROM m)), br AS (SELECT * FROM bm UNION ALL SELECT * FROM bm WHERE CAST(match_key AS BIGINT) % 80 = 0)"""
_TRUE_RESULT = "CASE WHEN home_goals > away_goals THEN 'H' WHEN home_goals < away_goals THEN 'A' WHEN home_goals = away_goals THEN 'D' END"


def _broken(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("match_key").cast("long")
    changed = {"match_date": F.when(k % 90 != 0, F.col("match_date")), "away_team_id": F.when(k % 60 == 0, F.col("home_team_id")).otherwise(F.col("away_team_id")), "home_goals": F.when(k % 70 == 0, -1).otherwise(F.col("home_goals")), "full_time_result": F.when(k % 50 == 0, "D").otherwise(F.col("full_time_result"))}
    m = matches(spark, d).withColumns(changed)
    return m.unionByName(m.filter(k % 80 == 0))


def _count(condition: str) -> str:
    return f"count(nullif({condition}, false))"


@query(f"""WITH {BROKEN} SELECT count(*) AS row_count, count(*) - count(DISTINCT match_key) AS duplicate_keys, {_count('home_team_id = away_team_id')} AS same_team, {_count("status = 'FINISHED' AND (home_goals IS NULL OR away_goals IS NULL)")} AS missing_score,
    {_count('home_goals < 0 OR away_goals < 0')} AS negative_goals, {_count(f"status = 'FINISHED' AND full_time_result <> {_TRUE_RESULT}")} AS wrong_result, {_count('match_date IS NULL')} AS missing_date FROM br""")
def violations_silver(spark: SparkSession, d: str) -> DataFrame:
    return gold.silver_violations(_broken(spark, d))


@query(f"""WITH {BROKEN} SELECT count(*) AS row_count, count(*) - count(DISTINCT match_key) AS duplicate_keys, {_count("trim(home_team_id) = '' OR away_team_id IS NULL")} AS blank_team, {_count('home_team_id = away_team_id')} AS same_team, {_count('home_goals IS NULL OR away_goals IS NULL')} AS missing_score,
    {_count('home_goals < 0 OR away_goals < 0')} AS negative_goals, {_count(f'home_goals IS NOT NULL AND away_goals IS NOT NULL AND full_time_result IS DISTINCT FROM {_TRUE_RESULT}')} AS wrong_result, {_count('match_date IS NULL')} AS missing_date FROM br""")
def violations_historical(spark: SparkSession, d: str) -> DataFrame:
    return gold.historical_violations(_broken(spark, d).withColumnsRenamed({"match_key": "match_id", "home_team_id": "home_team", "away_team_id": "away_team"}))


@query(f"""WITH {M}, {H}, v AS (SELECT match_key, team_id, opponent_id, result, points, CASE WHEN CAST(match_key AS BIGINT) % 40 = 0 THEN 'neutral' ELSE venue END AS venue FROM hp), u AS (SELECT * FROM v UNION ALL SELECT match_key, team_id, team_id, result, points + 1, venue FROM v WHERE CAST(match_key AS BIGINT) % 30 = 0)
    SELECT count(*) AS row_count, {_count("venue NOT IN ('home', 'away')")} AS bad_venue, count(*) - count(DISTINCT (match_key, team_id)) AS duplicate_keys, {_count('team_id = opponent_id')} AS same_team, {_count("points <> CASE result WHEN 'W' THEN 3 WHEN 'D' THEN 1 ELSE 0 END")} AS bad_points FROM u""")
def violations_history(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("match_key").cast("long")
    h = form.team_history(matches(spark, d)).withColumn("venue", F.when(k % 40 == 0, "neutral").otherwise(F.col("venue")))
    return gold.history_violations(h.unionByName(h.filter(k % 30 == 0).withColumns({"opponent_id": F.col("team_id"), "points": F.col("points") + 1})))


@query(f"""WITH {WIDE}, b AS (SELECT match_key, CASE WHEN k % 50 = 0 THEN -1 ELSE home_matches_played_before END AS home_matches_played_before, away_matches_played_before, CASE WHEN k % 60 = 0 THEN 16 ELSE home_points_last_5 END AS home_points_last_5, away_points_last_5,
      CASE WHEN k % 70 = 0 THEN 6 ELSE home_wins_last_5 END + home_draws_last_5 + home_losses_last_5 AS hr, away_wins_last_5 + away_draws_last_5 + away_losses_last_5 AS ar FROM (SELECT *, CAST(match_key AS BIGINT) AS k FROM w)), u AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE CAST(match_key AS BIGINT) % 80 = 0)
    SELECT count(*) AS row_count, count(*) - count(DISTINCT match_key) AS duplicate_keys, {_count('home_matches_played_before < 0 OR away_matches_played_before < 0')} AS negative_played, {_count('home_points_last_5 > 15')} AS home_points_over, {_count('away_points_last_5 > 15')} AS away_points_over,
      {_count('hr > 5')} AS home_results_over, {_count('ar > 5')} AS away_results_over FROM u""")
def violations_form(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("match_key").cast("long")
    planted = {"home_matches_played_before": F.when(k % 50 == 0, -1).otherwise(F.col("home_matches_played_before")), "home_points_last_5": F.when(k % 60 == 0, 16).otherwise(F.col("home_points_last_5")), "home_wins_last_5": F.when(k % 70 == 0, 6).otherwise(F.col("home_wins_last_5"))}
    f = _match_form(spark, d).withColumns(planted)
    return gold.form_violations(f.unionByName(f.filter(k % 80 == 0)))


_FLAGS = " OR ".join(f"{s}_is_cold_start <> ({s}_matches_played_before = 0) OR {s}_has_limited_history <> ({s}_matches_played_before < 5)" for s in ("home", "away"))
_EDGE = "CASE WHEN split = '{0}' THEN kickoff_utc END"


@query(f"""WITH RECURSIVE {MODEL}, b AS (SELECT match_key, kickoff_utc, CASE WHEN split = 'test' THEN 'none' ELSE split END AS split, CASE WHEN k % 50 = 0 THEN 3 ELSE target END AS target, CASE WHEN k % 60 = 0 THEN 1.5 ELSE home_expected_score END AS x, away_expected_score AS y, home_matches_played_before, away_matches_played_before,
      home_is_cold_start, away_is_cold_start, home_has_limited_history, CASE WHEN k % 70 = 0 THEN NOT away_has_limited_history ELSE away_has_limited_history END AS away_has_limited_history FROM (SELECT *, CAST(match_key AS BIGINT) AS k FROM md)), u AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE CAST(match_key AS BIGINT) % 80 = 0)
    SELECT count(*) AS row_count, count(*) - count(DISTINCT match_key) AS duplicate_keys, {_count('target NOT IN (0, 1, 2)')} AS bad_target, {_count('x NOT BETWEEN 0 AND 1 OR y NOT BETWEEN 0 AND 1')} AS bad_expectation, {_count('abs(x + y - 1) > 1e-9')} AS expectation_sum,
      {', '.join(f"CAST(count(nullif(split = '{s}', false)) = 0 AS INT) AS no_{s}" for s in gold.SPLITS)}, coalesce(CAST(max({_EDGE.format('train')}) >= min({_EDGE.format('validation')}) AS INT), 0) AS train_overlaps, coalesce(CAST(max({_EDGE.format('validation')}) >= min({_EDGE.format('test')}) AS INT), 0) AS validation_overlaps, {_count(_FLAGS)} AS bad_flag FROM u""")
def violations_model(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("match_key").cast("long")
    planted = {"split": F.when(F.col("split") == "test", "none").otherwise(F.col("split")), "target": F.when(k % 50 == 0, 3).otherwise(F.col("target")), "home_expected_score": F.when(k % 60 == 0, 1.5).otherwise(F.col("home_expected_score")), "away_has_limited_history": (k % 70 == 0) != F.col("away_has_limited_history")}
    m = _model(spark, d).withColumns(planted)
    return gold.model_violations(m.unionByName(m.filter(k % 80 == 0)))


@query(f"WITH {BROKEN} SELECT {', '.join(f'{_count(f"{c} IS NULL")} AS {c}' for c in ('match_key', 'match_date', 'home_goals', 'away_goals', 'full_time_result'))} FROM br")
def null_counts(spark: SparkSession, d: str) -> DataFrame:
    return gold.null_counts(_broken(spark, d).select("match_key", "match_date", "home_goals", "away_goals", "full_time_result"))


@query(f"""WITH {M}, p AS (SELECT match_key AS match_id, season AS season_partition, home_team_id, away_team_id, match_date FROM m UNION ALL SELECT match_key, CAST(CAST(season AS INT) + 1 AS VARCHAR), home_team_id, away_team_id, match_date FROM m WHERE CAST(match_key AS BIGINT) % 100 = 0),
    x AS (SELECT match_id, count(DISTINCT season_partition) AS parts FROM p GROUP BY 1), t AS (SELECT season_partition, count(DISTINCT team) AS teams FROM (SELECT season_partition, home_team_id AS team FROM p UNION SELECT season_partition, away_team_id FROM p) GROUP BY 1)
    SELECT p.season_partition, count(*) AS row_count, count(DISTINCT p.match_id) AS ids, min(match_date) AS first_date, max(match_date) AS last_date, any_value(teams) AS teams, {_count('parts > 1')} AS in_other_partitions FROM p JOIN x USING (match_id) JOIN t USING (season_partition) GROUP BY p.season_partition""")
def audit_seasons(spark: SparkSession, d: str) -> DataFrame:
    """Partitions of bronze, with matches planted in two of them."""
    m = matches(spark, d).select(F.col("match_key").alias("match_id"), F.col("season").alias("season_partition"), F.col("home_team_id").alias("home_team"), F.col("away_team_id").alias("away_team"), "match_date")
    twice = m.filter("match_id % 100 = 0").withColumn("season_partition", (F.col("season_partition").cast("int") + 1).cast("string"))
    return layers.audit_seasons(m.unionByName(twice))


@query(f"WITH {M} SELECT season, count(*) AS row_count, count(DISTINCT match_key) AS ids, min(match_date) AS first_date, max(match_date) AS last_date, count(nullif(status = 'FINISHED', false)) AS finished, count(nullif(status <> 'FINISHED', false)) AS not_finished FROM m GROUP BY season")
def bronze_audit(spark: SparkSession, d: str) -> DataFrame:
    done = F.col("status") == "FINISHED"
    return matches(spark, d).groupBy("season").agg(F.count("*").alias("row_count"), F.countDistinct("match_key").alias("ids"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"), F.count_if(done).alias("finished"), F.count_if(~done).alias("not_finished"))


def _rounded(df: DataFrame, keep: list[str], digits: int = 9) -> DataFrame:
    return df.select(*keep, *[F.round(c, digits).alias(c) for c in probability.P])


TRAIN = "n AS (SELECT count(nullif(target = 0, false))::DOUBLE AS n0, count(nullif(target = 1, false))::DOUBLE AS n1, count(nullif(target = 2, false))::DOUBLE AS n2 FROM sp WHERE split = 'train')"


@query(f"""WITH {SPLIT}, {TRAIN}, b AS (SELECT CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS k FROM n)
    SELECT match_key, {', '.join(f"round(CASE WHEN k = {i} THEN 1 - 2e-9 ELSE 1e-9 END, 9) AS {p}" for i, p in enumerate(probability.P))} FROM sp, b WHERE split = 'test'""")
def baseline_majority(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    return _rounded(probability.with_constant(s.filter("split = 'test'"), probability.majority(s.filter("split = 'train'"))), ["match_key"])


@query(f"""WITH {SPLIT}, {TRAIN} SELECT match_key, {', '.join(f"round((n{i} + 1.0) / (n0 + n1 + n2 + 3.0), 9) AS {p}" for i, p in enumerate(probability.P))} FROM sp, n WHERE split = 'test'""")
def baseline_frequency(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d)
    return _rounded(probability.with_constant(s.filter("split = 'test'"), probability.frequency(s.filter("split = 'train'"))), ["match_key"])


#: An expected score by integer arithmetic, so that both engines have the same.
EXPECTED = "((CAST(match_key AS BIGINT) * 37) % 1000) / 1000.0"
RAW = f"greatest(1e-9, least(1.0, (1 - {EXPECTED}) * 0.75)) AS r0, 0.25 AS r1, greatest(1e-9, least(1.0, {EXPECTED} * 0.75)) AS r2"
SCORED = f"{SPLIT}, sc AS (SELECT match_key, season, split, target, r0 / (r0 + r1 + r2) AS p0, r1 / (r0 + r1 + r2) AS p1, r2 / (r0 + r1 + r2) AS p2 FROM (SELECT *, {RAW} FROM sp))"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    expected = (F.col("match_key").cast("long") * 37 % 1000).cast("double") / 1000.0
    return _split(spark, d).withColumns(dict(zip(probability.P, probability.elo_outcome(expected), strict=True)))


@query(f"WITH {SCORED} SELECT match_key, round(p0, 9) AS {probability.P[0]}, round(p1, 9) AS {probability.P[1]}, round(p2, 9) AS {probability.P[2]} FROM sc")
def baseline_elo(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_scored(spark, d), ["match_key"])


def _metric_sql(source: str, by: str) -> str:
    cells = ", ".join(f"count(nullif(target = {t} AND g = {k}, false))::DOUBLE AS c{t}{k}" for t in range(3) for k in range(3))
    recall = [f"CASE WHEN c{k}0 + c{k}1 + c{k}2 > 0 THEN c{k}{k} / (c{k}0 + c{k}1 + c{k}2) END" for k in range(3)]
    f1 = [f"CASE WHEN c{k}0 + c{k}1 + c{k}2 + c0{k} + c1{k} + c2{k} > 0 THEN 2 * c{k}{k} / (c{k}0 + c{k}1 + c{k}2 + c0{k} + c1{k} + c2{k}) END" for k in range(3)]
    return f"""SELECT {by}, row_count, round((c00 + c11 + c22) / row_count, 6) AS accuracy, round(list_avg(list_filter([{', '.join(recall)}], lambda x: x IS NOT NULL)), 6) AS balanced_accuracy, round(list_avg(list_filter([{', '.join(f1)}], lambda x: x IS NOT NULL)), 6) AS macro_f1,
      round(log_loss, 6) AS log_loss, round(brier_score, 6) AS brier_score, round(rps, 6) AS ranked_probability_score FROM (SELECT {by}, count(*) AS row_count, {cells}, avg(-ln(CASE target WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS log_loss,
      avg((p0 - (target = 0)::INT) ** 2 + (p1 - (target = 1)::INT) ** 2 + (p2 - (target = 2)::INT) ** 2) AS brier_score, avg(((p0 - (target = 0)::INT) ** 2 + (p0 + p1 - (target = 0)::INT - (target = 1)::INT) ** 2) / 2) AS rps
      FROM (SELECT *, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS g FROM {source} WHERE target IS NOT NULL) GROUP BY {by})"""


def _round_metrics(df: DataFrame, keep: list[str]) -> DataFrame:
    return df.select(*keep, "row_count", *[F.round(c, 6).alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "log_loss", "brier_score", "ranked_probability_score")])


@query(f"WITH {SCORED} {_metric_sql('sc', 'split')}")
def metrics_by_split(spark: SparkSession, d: str) -> DataFrame:
    return _round_metrics(probability.metrics(_scored(spark, d), ["split"]), ["split"])


LONG = f"{SCORED}, lg AS (SELECT split, 'away_win' AS class_label, p0 AS p, (target = 0)::INT::DOUBLE AS y FROM sc WHERE target IS NOT NULL UNION ALL SELECT split, 'draw', p1, (target = 1)::INT::DOUBLE FROM sc WHERE target IS NOT NULL UNION ALL SELECT split, 'home_win', p2, (target = 2)::INT::DOUBLE FROM sc WHERE target IS NOT NULL)"
EDGES = "[" + ", ".join(repr(e) for e in probability.bin_edges(10)) + "]::DOUBLE[]"
TABLE = f"{LONG}, rb AS (SELECT split, class_label, least(len(list_filter({EDGES}, lambda e: e <= p)) - 1, 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM lg GROUP BY ALL), rt AS (SELECT g.split, g.class_label, b.bin, coalesce(rb.n, 0) AS n, mp, my FROM (SELECT DISTINCT split, class_label FROM lg) g CROSS JOIN (SELECT range::BIGINT AS bin FROM range(10)) b LEFT JOIN rb ON rb.split = g.split AND rb.class_label = g.class_label AND rb.bin = b.bin)"


def _table(spark: SparkSession, d: str) -> DataFrame:
    return probability.reliability(probability.one_vs_rest(_scored(spark, d), ["split"]), ["split", "class_label"])


@query(f"WITH {TABLE} SELECT split, class_label, bin, n, round(mp, 6) AS mean_probability, round(my, 6) AS observed_frequency FROM rt")
def reliability_by_class(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, d).select("split", "class_label", "bin", "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("observed_frequency", 6).alias("observed_frequency"))


@query(f"WITH {TABLE} SELECT split, class_label, round(sum(abs(mp - my) * n) / sum(n), 6) AS expected_calibration_error, round(max(abs(mp - my)), 6) AS maximum_calibration_error, round(sum(mp * n) / sum(n) - sum(my * n) / sum(n), 6) AS bias, count(nullif(n > 0, false)) AS populated_bins FROM rt GROUP BY split, class_label")
def calibration_summary(spark: SparkSession, d: str) -> DataFrame:
    s = probability.calibration_summary(_table(spark, d), ["split", "class_label"])
    return s.select("split", "class_label", F.round("expected_calibration_error", 6).alias("expected_calibration_error"), F.round("maximum_calibration_error", 6).alias("maximum_calibration_error"), F.round("bias", 6).alias("bias"), "populated_bins")


SURE = f"{SCORED}, cf AS (SELECT split, greatest(p0, p1, p2) AS p, ((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = target)::INT::DOUBLE AS y FROM sc WHERE target IS NOT NULL), cb AS (SELECT split, least(len(list_filter({EDGES}, lambda e: e <= p)) - 1, 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM cf GROUP BY ALL)"


@query(f"WITH {SURE} SELECT split, round(sum(mp * n) / sum(n), 6) AS mean_confidence, round(sum(my * n) / sum(n), 6) AS accuracy, round(sum((mp - my) * n) / sum(n), 6) AS over_confidence, round(sum(abs(mp - my) * n) / sum(n), 6) AS expected_calibration_error, round(max(abs(mp - my)), 6) AS maximum_calibration_error, count(*) AS populated_bins FROM cb GROUP BY split")
def confidence_calibration(spark: SparkSession, d: str) -> DataFrame:
    c = probability.confidence_summary(_scored(spark, d), ["split"])
    return c.select("split", *[F.round(n, 6).alias(n) for n in ("mean_confidence", "accuracy", "over_confidence", "expected_calibration_error", "maximum_calibration_error")], "populated_bins")


def _two_models(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d)
    return s.withColumns({f"q{k}": F.lit(v) for k, v in enumerate((0.2, 0.3, 0.5))})


def _aligned(spark: SparkSession, d: str, split: str) -> DataFrame:
    """The ratings' probabilities against a constant, aligned by key."""
    s = _two_models(spark, d).filter((F.col("split") == split) & F.col("target").isNotNull())
    second = s.select("match_key", "target", *[F.col(f"q{k}").alias(c) for k, c in enumerate(probability.P)])
    return probability.align(s.select("match_key", "target", *probability.P), second)


BLENDED = f"{SCORED}, ws AS (SELECT range * 0.05::DOUBLE AS w FROM range(21)), bl AS (SELECT match_key, target, CAST(round(w, 2) AS DOUBLE) AS first_weight, w * p0 + (1 - w) * 0.2 AS p0, w * p1 + (1 - w) * 0.3 AS p1, w * p2 + (1 - w) * 0.5 AS p2 FROM sc, ws WHERE split = 'validation')"


@query(f"WITH {SCORED} SELECT match_key, round(0.3 * p0 + 0.7 * 0.2, 9) AS {probability.P[0]}, round(0.3 * p1 + 0.7 * 0.3, 9) AS {probability.P[1]}, round(0.3 * p2 + 0.7 * 0.5, 9) AS {probability.P[2]} FROM sc")
def blend(spark: SparkSession, d: str) -> DataFrame:
    s = _two_models(spark, d)
    mixed = probability.blend([F.col(c) for c in probability.P], [F.col(f"q{k}") for k in range(3)], F.lit(0.3))
    return s.select("match_key", *[F.round(m, 9).alias(c) for m, c in zip(mixed, probability.P, strict=True)])


@query(f"WITH {BLENDED} {_metric_sql('bl', 'first_weight')}")
def weight_search(spark: SparkSession, d: str) -> DataFrame:
    return _round_metrics(probability.weight_metrics(_aligned(spark, d, "validation"), tuple(round(k * 0.05, 2) for k in range(21))), ["first_weight"])


@query(f"WITH {BLENDED}, wm AS ({_metric_sql('bl', 'first_weight')}) SELECT * FROM wm ORDER BY log_loss, brier_score, first_weight LIMIT 1")
def best_weight(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.best(weight_search(spark, d), "first_weight")


@query(f"WITH {SCORED} SELECT match_key, target, round(p0, 9) AS first_away, 0.2::DOUBLE AS second_away FROM sc WHERE split = 'test' AND target IS NOT NULL")
def align_predictions(spark: SparkSession, d: str) -> DataFrame:
    a = _aligned(spark, d, "test")
    return a.select("match_key", "target", F.round(f"first_{probability.P[0]}", 9).alias("first_away"), F.col(f"second_{probability.P[0]}").alias("second_away"))


@query(f"""WITH {SCORED} SELECT match_key, (CASE WHEN b0 >= b1 AND b0 >= b2 THEN 0 WHEN b1 >= b2 THEN 1 ELSE 2 END)::BIGINT AS predicted_class, round(greatest(b0, b1, b2), 9) AS prediction_confidence, 0.4::DOUBLE AS first_model_weight, 0.6::DOUBLE AS second_model_weight, 'elo' AS first_model, 'constant' AS second_model
    FROM (SELECT match_key, 0.4 * p0 + 0.6 * 0.2 AS b0, 0.4 * p1 + 0.6 * 0.3 AS b1, 0.4 * p2 + 0.6 * 0.5 AS b2 FROM sc WHERE split = 'test' AND target IS NOT NULL)""")
def ensemble_frame(spark: SparkSession, d: str) -> DataFrame:
    e = probability.blended(_aligned(spark, d, "test"), 0.4, "elo", "constant")
    return e.select("match_key", "predicted_class", F.round("prediction_confidence", 9).alias("prediction_confidence"), "first_model_weight", F.round("second_model_weight", 9).alias("second_model_weight"), "first_model", "second_model")


@query(f"""WITH {SCORED}, b AS (SELECT match_key, target, CASE WHEN CAST(match_key AS BIGINT) % 50 = 0 THEN NULL ELSE p0 END AS p0, CASE WHEN CAST(match_key AS BIGINT) % 60 = 1 THEN 1.25 ELSE p1 END AS p1, CASE WHEN CAST(match_key AS BIGINT) % 70 = 2 THEN p2 / 2 ELSE p2 END AS p2 FROM sc),
      u AS (SELECT * FROM b UNION ALL SELECT match_key, 5, p0, p1, p2 FROM b WHERE CAST(match_key AS BIGINT) % 80 = 3)
    SELECT count(*) AS row_count, {_count('p0 IS NULL')} AS not_finite, {_count('p0 IS NOT NULL AND p1 > 1')} AS outside_unit, {_count('p0 IS NOT NULL AND abs(p0 + p1 + p2 - 1) > 1e-8')} AS not_one, count(*) - count(DISTINCT match_key) AS duplicate_keys, {_count('target NOT IN (0, 1, 2)')} AS bad_target FROM u""")
def violations_predictions(spark: SparkSession, d: str) -> DataFrame:
    k, (a, b, c) = F.col("match_key").cast("long"), probability.P
    planted = {a: F.when(k % 50 == 0, float("nan")).otherwise(F.col(a)), b: F.when(k % 60 == 1, 1.25).otherwise(F.col(b)), c: F.when(k % 70 == 2, F.col(c) / 2).otherwise(F.col(c))}
    s = _scored(spark, d).withColumns(planted)
    return probability.prediction_violations(s.unionByName(s.filter(k % 80 == 3).withColumn("target", F.lit(5).cast("long"))))


#: Probabilities from the ratings themselves, of every match.
RATED = f"""{ELO}, rs AS (SELECT m.match_key, m.season, CASE WHEN season = '{VALIDATION}' THEN 'validation' WHEN season = '{TEST}' THEN 'test' WHEN season < '{VALIDATION}' THEN 'train' ELSE 'future' END AS split, CAST(CASE full_time_result WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'H' THEN 2 END AS BIGINT) AS target,
    (1 - home_expected_score) * 0.75 AS p0, 0.25::DOUBLE AS p1, home_expected_score * 0.75 AS p2 FROM m JOIN el USING (match_key))"""


@query(f"WITH RECURSIVE {RATED} {_metric_sql('rs', 'split')}")
def elo_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the rating baseline, its expectations being those of the rating fold."""
    rated = _split(spark, d).join(_elo(spark, d).select("match_key", "home_expected_score"), "match_key")
    return _round_metrics(probability.metrics(rated.withColumns(dict(zip(probability.P, probability.elo_outcome(F.col("home_expected_score")), strict=True))), ["split"]), ["split"])


_BASE = f"""{SCORED}, {TRAIN}, bk AS (SELECT CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS k FROM n), bs AS (SELECT 'elo' AS model, split, target, p0, p1, p2 FROM sc WHERE split IN ('validation', 'test')
    UNION ALL SELECT 'frequency', split, target, (n0 + 1) / (n0 + n1 + n2 + 3), (n1 + 1) / (n0 + n1 + n2 + 3), (n2 + 1) / (n0 + n1 + n2 + 3) FROM sc, n WHERE split IN ('validation', 'test')
    UNION ALL SELECT 'majority', split, target, CASE WHEN k = 0 THEN 1 - 2e-9 ELSE 1e-9 END, CASE WHEN k = 1 THEN 1 - 2e-9 ELSE 1e-9 END, CASE WHEN k = 2 THEN 1 - 2e-9 ELSE 1e-9 END FROM sc, bk WHERE split IN ('validation', 'test'))"""


@query(f"WITH {_BASE} {_metric_sql('bs', 'model, split')}")
def baseline_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Three baselines on two splits: all six records in one job."""
    s = _split(spark, d).withColumn("home_expected_score", (F.col("match_key").cast("long") * 37 % 1000).cast("double") / 1000.0)
    return _round_metrics(probability.metrics(evaluation.baselines(s), ["model", "split"]), ["model", "split"])


_CAL = f"""{_BASE}, cl AS (SELECT model, 'away_win' AS class_label, p0 AS p, (target = 0)::INT::DOUBLE AS y FROM bs WHERE target IS NOT NULL UNION ALL SELECT model, 'draw', p1, (target = 1)::INT::DOUBLE FROM bs WHERE target IS NOT NULL UNION ALL SELECT model, 'home_win', p2, (target = 2)::INT::DOUBLE FROM bs WHERE target IS NOT NULL
      UNION ALL SELECT model, 'confidence', greatest(p0, p1, p2), ((CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END) = target)::INT::DOUBLE FROM bs WHERE target IS NOT NULL),
    ct AS (SELECT model, class_label, least(len(list_filter({EDGES}, lambda e: e <= p)) - 1, 9)::BIGINT AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my FROM cl GROUP BY ALL),
    cs AS (SELECT model, class_label, sum(abs(mp - my) * n) / sum(n) AS ece, max(abs(mp - my)) AS mce, sum(mp * n) / sum(n) AS p, sum(my * n) / sum(n) AS y FROM ct GROUP BY ALL)"""


@query(f"""WITH {_CAL} SELECT a.model, round(mean_class_ece, 6) AS mean_class_ece, round(maximum_class_mce, 6) AS maximum_class_mce, round(mean_absolute_bias, 6) AS mean_absolute_bias, round(c.p, 6) AS mean_confidence, round(c.y, 6) AS accuracy, round(c.p - c.y, 6) AS over_confidence, round(c.ece, 6) AS confidence_ece, round(c.mce, 6) AS confidence_mce
    FROM (SELECT model, avg(ece) AS mean_class_ece, max(mce) AS maximum_class_mce, avg(abs(p - y)) AS mean_absolute_bias FROM cs WHERE class_label <> 'confidence' GROUP BY model) a JOIN cs c ON c.model = a.model AND c.class_label = 'confidence'""")
def calibration_of_models(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d).withColumn("home_expected_score", (F.col("match_key").cast("long") * 37 % 1000).cast("double") / 1000.0)
    per_model = probability.calibration_of_models(evaluation.baselines(s))[2]
    return per_model.select("model", *[F.round(c, 6).alias(c) for c in per_model.columns if c != "model"])


@query(f"WITH {_CAL}, g AS (SELECT DISTINCT model, class_label FROM cl) SELECT g.model, g.class_label, b.bin, coalesce(n, 0) AS n, round(mp, 6) AS mean_probability, round(my, 6) AS observed_frequency FROM g CROSS JOIN (SELECT range::BIGINT AS bin FROM range(10)) b LEFT JOIN ct ON ct.model = g.model AND ct.class_label = g.class_label AND ct.bin = b.bin")
def calibration_bins_of_models(spark: SparkSession, d: str) -> DataFrame:
    s = _split(spark, d).withColumn("home_expected_score", (F.col("match_key").cast("long") * 37 % 1000).cast("double") / 1000.0)
    bins = probability.calibration_of_models(evaluation.baselines(s))[1]
    return bins.select("model", "class_label", "bin", "n", F.round("mean_probability", 6).alias("mean_probability"), F.round("observed_frequency", 6).alias("observed_frequency"))


@query(f"WITH {M} SELECT season, min(kickoff_utc) AS season_start, row_number() OVER (ORDER BY min(kickoff_utc)) AS position FROM m GROUP BY season")
def season_order(spark: SparkSession, d: str) -> DataFrame:
    return gold.season_order(matches(spark, d))


FOLDS = f"{M}, so AS (SELECT season, row_number() OVER (ORDER BY min(kickoff_utc)) AS pos FROM m GROUP BY season), ev AS (SELECT season AS es, pos AS last_pos, row_number() OVER (ORDER BY pos) AS fold_number FROM so WHERE pos > 2 AND pos > (SELECT max(pos) FROM so) - 4), fo AS (SELECT fold_number, es AS evaluation_season, CASE WHEN so.pos = last_pos THEN 'evaluation' ELSE 'training' END AS role, so.season FROM ev JOIN so ON so.pos <= last_pos)"


@query(f"WITH {FOLDS} SELECT * FROM fo")
def backtest_folds(spark: SparkSession, d: str) -> DataFrame:
    return gold.backtest_folds(matches(spark, d))


FOLD_SCORES = f"""{FOLDS}, ft AS (SELECT *, CAST(CASE full_time_result WHEN 'A' THEN 0 WHEN 'D' THEN 1 WHEN 'H' THEN 2 END AS BIGINT) AS target FROM m), fc AS (SELECT fold_number, count(nullif(target = 0, false))::DOUBLE AS n0, count(nullif(target = 1, false))::DOUBLE AS n1, count(nullif(target = 2, false))::DOUBLE AS n2 FROM ft JOIN fo ON fo.season = ft.season AND role = 'training' GROUP BY fold_number),
    fs AS (SELECT fo.fold_number, evaluation_season, target, (n0 + 1) / (n0 + n1 + n2 + 3) AS p0, (n1 + 1) / (n0 + n1 + n2 + 3) AS p1, (n2 + 1) / (n0 + n1 + n2 + 3) AS p2 FROM ft JOIN fo ON fo.season = ft.season AND role = 'evaluation' JOIN fc ON fc.fold_number = fo.fold_number)"""


@query(f"WITH {FOLD_SCORES} {_metric_sql('fs', 'fold_number, evaluation_season')}")
def backtest_frequency(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of every fold's own class frequencies on its evaluation season."""
    m = matches(spark, d).withColumn("target", C.target_of(F.col("full_time_result")))
    return _round_metrics(probability.metrics(evaluation.frequency_folds(m), ["fold_number", "evaluation_season"]), ["fold_number", "evaluation_season"])


@query(f"""WITH {FOLD_SCORES}, fm AS ({_metric_sql('fs', 'fold_number, evaluation_season')}) SELECT 'frequency' AS model, count(*) AS fold_count, {', '.join(f"round(avg({c}), 5) AS {c}_mean, round(stddev_samp({c}), 5) AS {c}_std" for c in ('accuracy', 'balanced_accuracy', 'macro_f1', 'log_loss', 'brier_score', 'ranked_probability_score'))} FROM fm""")
def backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    """Mean and deviation over the folds of each metric."""
    summary = evaluation.summarise_folds(backtest_frequency(spark, d).withColumn("model", F.lit("frequency")))
    return summary.select("model", "fold_count", *[F.round(c, 5).alias(c) for c in summary.columns if c not in ("model", "fold_count")])


@query(f"WITH {FOLDS}, b AS (SELECT fo.fold_number, max(CASE WHEN role = 'training' THEN kickoff_utc END) AS l, min(CASE WHEN role = 'evaluation' THEN kickoff_utc END) AS f FROM m JOIN fo ON fo.season = m.season GROUP BY 1) SELECT fold_number, CAST(l >= f AS INT) AS not_in_order FROM b")
def violations_folds(spark: SparkSession, d: str) -> DataFrame:
    m = matches(spark, d)
    rows = m.join(F.broadcast(gold.backtest_folds(m)), "season")
    edges = rows.groupBy("fold_number").agg(F.max(F.when(F.col("role") == "training", F.col("kickoff_utc"))).alias("l"), F.min(F.when(F.col("role") == "evaluation", F.col("kickoff_utc"))).alias("f"))
    return edges.select("fold_number", (F.col("l") >= F.col("f")).cast("int").alias("not_in_order"))


@query(f"WITH {SPLIT}, v AS (SELECT match_key, row_number() OVER (ORDER BY kickoff_utc, match_key) AS n, count(*) OVER () AS t FROM sp WHERE split = 'validation' AND target IS NOT NULL) SELECT match_key, CASE WHEN n <= floor(t * 0.6) THEN 'tuning' ELSE 'calibration' END AS part FROM v")
def validation_partition(spark: SparkSession, d: str) -> DataFrame:
    return gold.chronological_partition(_split(spark, d).filter("split = 'validation' and target is not null"), 0.6).select("match_key", "part")


@query(f"""WITH {SPLIT}, l AS (SELECT match_key, kickoff_utc, row_number() OVER (ORDER BY kickoff_utc, match_key) AS n, count(*) OVER () AS t FROM sp WHERE target IS NOT NULL), f AS (SELECT min(kickoff_utc) AS k FROM l WHERE n = t - greatest(30, ceil(t * 0.15)) + 1)
    SELECT match_key, CASE WHEN kickoff_utc >= k THEN 'calibration' ELSE 'training' END AS part FROM l, f""")
def calibration_partition(spark: SparkSession, d: str) -> DataFrame:
    return gold.calibration_partition(_split(spark, d).filter("target is not null")).select("match_key", "part")


@query(f"WITH {SCORED} SELECT match_key, (CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END)::BIGINT AS predicted_class, round(greatest(p0, p1, p2), 9) AS prediction_confidence, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'away_win' WHEN p1 >= p2 THEN 'draw' ELSE 'home_win' END AS predicted_outcome FROM sc WHERE target IS NULL")
def prediction_output(spark: SparkSession, d: str) -> DataFrame:
    predicted = probability.prediction_frame(_scored(spark, d).filter("target is null"))
    return predicted.select("match_key", "predicted_class", F.round("prediction_confidence", 9).alias("prediction_confidence"), "predicted_outcome")


@query(f"WITH {SCORED}, c AS (SELECT greatest(p0, p1, p2) AS g, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'away_win' WHEN p1 >= p2 THEN 'draw' ELSE 'home_win' END AS predicted_outcome FROM sc WHERE target IS NULL) SELECT predicted_outcome, count(*) AS row_count, round(avg(g), 6) AS mean_confidence, round(min(g), 6) AS least_confidence, round(max(g), 6) AS most_confidence FROM c GROUP BY predicted_outcome")
def prediction_audit(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("prediction_confidence")
    return prediction_output(spark, d).groupBy("predicted_outcome").agg(F.count("*").alias("row_count"), F.round(F.avg(c), 6).alias("mean_confidence"), F.round(F.min(c), 6).alias("least_confidence"), F.round(F.max(c), 6).alias("most_confidence"))


@query(f"WITH {M} SELECT match_key, season FROM m WHERE full_time_result IS NULL")
def future_fixtures(spark: SparkSession, d: str) -> DataFrame:
    return matches(spark, d).filter("full_time_result is null").select("match_key", "season")


#: The model features of the reference, in its order.
FEATURES = (
    "home_matches_played_before", "away_matches_played_before", "home_is_cold_start", "away_is_cold_start", "home_has_limited_history", "away_has_limited_history",
    "home_points_last_5", "away_points_last_5", "form_points_difference", "home_goals_for_last_5", "away_goals_for_last_5", "recent_attack_difference",
    "home_goals_against_last_5", "away_goals_against_last_5", "recent_defence_difference", "home_goal_difference_last_5", "away_goal_difference_last_5", "recent_goal_difference_difference",
    "home_wins_last_5", "away_wins_last_5", "home_draws_last_5", "away_draws_last_5", "home_losses_last_5", "away_losses_last_5",
    "home_average_points_last_5", "away_average_points_last_5", "average_form_difference", "home_days_since_previous_match", "away_days_since_previous_match", "rest_days_difference",
    "home_elo_pre", "away_elo_pre", "elo_difference", "home_expected_score", "away_expected_score",
)
X = list(FEATURES)


def _features(spark: SparkSession, d: str, *kept: str) -> DataFrame:
    m = _model(spark, d)
    return m.select(*kept, "match_key", "kickoff_utc", "split", "target", *[gold.feature(c).alias(c) for c in FEATURES])


_AS_FEATURE = ", ".join(f"round(coalesce(CAST({c} AS DOUBLE), 0.0), 6) AS {c}" for c in FEATURES if c not in form.DIFFERENCES)
_GAP_FEATURE = ", ".join(f"round(coalesce(CAST(home_{c} - away_{c} AS DOUBLE), 0.0), 6) AS {name}" for name, c in form.DIFFERENCES.items())


@query(f"WITH RECURSIVE {MODEL} SELECT match_key, {_AS_FEATURE}, {_GAP_FEATURE} FROM md")
def model_features(spark: SparkSession, d: str) -> DataFrame:
    """The 35 features as a model sees them."""
    return _features(spark, d).select("match_key", *[F.round(c, 6).alias(c) for c in FEATURES])


@query()
def logistic_grid(spark: SparkSession, d: str) -> DataFrame:
    return models.logistic_grid(_features(spark, d), X).select("c", "class_weight", F.round("log_loss", 4).alias("log_loss"), F.round("brier_score", 4).alias("brier_score"))


@query()
def logistic_coefficients(spark: SparkSession, d: str) -> DataFrame:
    return models.logistic_coefficients(_features(spark, d).filter("split = 'train' and target is not null"), X)


@query()
def boosting_grid(spark: SparkSession, d: str) -> DataFrame:
    return models.boosting_grid(_features(spark, d), X)


@query()
def boosting_importance(spark: SparkSession, d: str) -> DataFrame:
    return models.boosting_importance(_features(spark, d), X)


@query()
def backtest_models(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of logistic regression, boosting and class frequencies in every fold."""
    rows = _features(spark, d, "season").filter("target is not null")
    learned = models.backtest(evaluation.folds_of(rows), X)
    kept = ["fold_number", "evaluation_season", "model"]
    scored = learned.unionByName(evaluation.frequency_folds(rows).select(*learned.columns))
    return _round_metrics(probability.metrics(scored, kept), kept)


@query()
def production_predict(spark: SparkSession, d: str) -> DataFrame:
    return models.production_predict(_features(spark, d), X)
