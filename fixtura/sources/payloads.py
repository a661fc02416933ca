"""Nested JSON of a match API as flat rows, with explicit schemas; what is missing is null.

Values are taken as text from the JSON and cast without failing, so a score that is no whole number
or an object that is missing gives null. Entries that are no objects are skipped; a list that is no
list is an error; an empty list gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions import match_columns as C

#: Fixed value: the source that rows of this API carry.
SOURCE = "football-data.org"



def _season(at: str) -> Column:
    return C.season_label(F.expr(f"try_cast(substring({at}, 1, 4) AS int)"))


def _text(json: Column, path: str) -> Column:
    return F.get_json_object(json, f"$.{path}")


def _entries(payload: Column, name: str) -> Column:
    """The entries of a list of a payload as JSON texts."""
    found = F.get_json_object(payload, f"$.{name}")
    listed = F.from_json(found, "array<string>")
    wrong = found.isNotNull() & ~F.ltrim(found).startswith("[")
    return F.when(wrong, F.raise_error(F.lit(f"the payload has no valid list of {name}")).cast("array<string>")).otherwise(listed)


def _objects(df: DataFrame, kept: list[str], entries: Column, name: str) -> DataFrame:
    return df.select(*kept, F.explode(entries).alias(name)).filter(F.ltrim(name).startswith("{"))


#: Column, path in an entry and kind of every column of a match.
MATCH = (
    ("api_match_id", "id", "long"), ("season_start", "season.startDate", "text"), ("season_end", "season.endDate", "text"), ("kickoff_utc", "utcDate", "time"), ("status", "status", "text"), ("matchday", "matchday", "long"),
    ("stage", "stage", "text"), ("group", "group", "text"), ("home_team_id", "homeTeam.id", "long"), ("home_team", "homeTeam.name", "text"), ("home_team_short_name", "homeTeam.shortName", "text"), ("home_team_tla", "homeTeam.tla", "text"),
    ("away_team_id", "awayTeam.id", "long"), ("away_team", "awayTeam.name", "text"), ("away_team_short_name", "awayTeam.shortName", "text"), ("away_team_tla", "awayTeam.tla", "text"), ("home_goals", "score.fullTime.home", "long"),
    ("away_goals", "score.fullTime.away", "long"), ("winner", "score.winner", "text"), ("duration", "score.duration", "text"), ("last_updated", "lastUpdated", "time"),
)
#: The same of a row of standings.
STANDING = (
    ("position", "position", "long"), ("team_id", "team.id", "long"), ("team", "team.name", "text"), ("team_short_name", "team.shortName", "text"), ("team_tla", "team.tla", "text"), ("played_games", "playedGames", "long"), ("form", "form", "text"),
    ("won", "won", "long"), ("draw", "draw", "long"), ("lost", "lost", "long"), ("points", "points", "long"), ("goals_for", "goalsFor", "long"), ("goals_against", "goalsAgainst", "long"), ("goal_difference", "goalDifference", "long"),
)
COMPETITION = (("competition_id", "competition.id", "long"), ("competition_code", "competition.code", "text"), ("competition", "competition.name", "text"))


def _values(json: Column, listed: tuple) -> dict[str, Column]:
    kinds = {"long": lambda c: c.try_cast("bigint"), "time": F.try_to_timestamp, "text": lambda c: c}
    return {name: kinds[kind](_text(json, path)) for name, path, kind in listed}


def flatten_matches(payloads: DataFrame, kept: list[str] | None = None, ingested_at: Column | None = None) -> DataFrame:
    """One row per match of each payload (column `payload`), 29 columns beside those kept."""
    kept = kept or []
    own = _values(F.col("payload"), COMPETITION)
    head = payloads.select(*kept, *[v.alias(c) for c, v in own.items()], _entries(F.col("payload"), "matches").alias("entries"))
    each = _objects(head, [*kept, *own], F.col("entries"), "m")
    rows = each.withColumns(_values(F.col("m"), MATCH))
    result = C.result_of(F.col("home_goals"), F.col("away_goals"))
    rows = rows.withColumns({"match_id": F.concat(F.lit(f"{SOURCE}:"), F.col("api_match_id").cast("string")), "season": _season("season_start"), "full_time_result": result, "source": F.lit(SOURCE), "ingested_at": F.current_timestamp() if ingested_at is None else ingested_at})
    names = [n for n, _, _ in MATCH]
    at = names.index("season_start")
    score = names.index("away_goals") + 1
    return rows.select(*kept, "match_id", "api_match_id", *own, "season", *names[at:score], "full_time_result", *names[score:], "source", "ingested_at")


def flatten_standings(payloads: DataFrame, kept: list[str] | None = None, ingested_at: Column | None = None) -> DataFrame:
    """Two unnestings: groups of a payload, rows of a group; 23 columns beside those kept."""
    kept = kept or []
    own = _values(F.col("payload"), COMPETITION) | {"season": C.season_label(F.substring(_text(F.col("payload"), "season.startDate"), 1, 4).try_cast("int"))}
    head = payloads.select(*kept, *[v.alias(c) for c, v in own.items()], _entries(F.col("payload"), "standings").alias("entries"))
    groups = _objects(head, [*kept, *own], F.col("entries"), "g")
    typed = groups.select(*kept, *own, _text(F.col("g"), "type").alias("standing_type"), _text(F.col("g"), "stage").alias("stage"), _text(F.col("g"), "group").alias("group"), F.from_json(_text(F.col("g"), "table"), "array<string>").alias("table"))
    rows = _objects(typed, [*kept, *own, "standing_type", "stage", "group"], F.col("table"), "r").withColumns(_values(F.col("r"), STANDING))
    return rows.select(*kept, *own, "standing_type", "stage", "group", *[n for n, _, _ in STANDING], F.lit(SOURCE).alias("source"), (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"))
