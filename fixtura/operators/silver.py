"""Bronze to silver: canonical projection, team aliases, keys, deduplication and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fixtura.functions import match_columns as C
from fixtura.operators.joins import join_lookup, require_unique

COMMON = ["season", "competition", "kickoff_utc", "match_date", "status", "home_team", "away_team", "home_goals", "away_goals", "full_time_result", "source", "ingested_at"]
#: Priority of the providers.
PRIORITY = {"football-data.org": 2, "football-data.co.uk": 1}


class UnknownTeams(ValueError):
    """Names that no alias covers."""


#: Columns of a results file and what they are called here, in the order of the layer.
SOURCE_COLUMNS = {
    "Date": "match_date", "Time": "kickoff_time", "HomeTeam": "home_team", "AwayTeam": "away_team", "FTHG": "home_goals", "FTAG": "away_goals", "FTR": "full_time_result",
    "HTHG": "half_time_home_goals", "HTAG": "half_time_away_goals", "HTR": "half_time_result", "HS": "home_shots", "AS": "away_shots", "HST": "home_shots_on_target", "AST": "away_shots_on_target",
    "HF": "home_fouls", "AF": "away_fouls", "HC": "home_corners", "AC": "away_corners", "HY": "home_yellow_cards", "AY": "away_yellow_cards", "HR": "home_red_cards", "AR": "away_red_cards",
}
#: Columns without which a results file is refused.
REQUIRED = ("match_date", "home_team", "away_team", "home_goals", "away_goals", "full_time_result")
TEXTS = ("kickoff_time", "half_time_result")


def normalise_historical(raw: DataFrame, start_year: int | Column, ingested_at: Column | None = None, competition: str = "Premier League", source: str = "football-data.co.uk") -> DataFrame:
    """Text columns of a results file as the typed columns of the layer; optional ones are kept where
    the file has them, and what cannot be read is null. The season is that of `start_year`."""
    named = raw.withColumnsRenamed({k: v for k, v in SOURCE_COLUMNS.items() if k in raw.columns})
    if missing := sorted(set(REQUIRED) - set(named.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    text = lambda c: C.strip_space(F.col(c).cast("string"))

    def typed(c: str) -> Column:
        if c == "match_date":
            return C.parse_match_date(text(c))
        if c in ("home_team", "away_team"):
            return text(c)
        if c == "full_time_result":
            return F.upper(text(c))
        return F.col(c) if c in TEXTS else F.expr(f"try_cast(nullif(trim({c}), '') AS bigint)")

    year = F.lit(start_year) if isinstance(start_year, int) else start_year
    kept = [c for c in SOURCE_COLUMNS.values() if c in named.columns]
    out = named.select(*[typed(c).alias(c) for c in kept], C.season_label(year).alias("season"), F.lit(competition).alias("competition"), F.lit(source).alias("source"), (F.current_timestamp() if ingested_at is None else ingested_at).alias("ingested_at"))
    return out.select(C.match_key(F.col("season"), F.col("match_date"), F.col("home_team"), F.col("away_team")).alias("match_id"), "season", "competition", *kept, "source", "ingested_at")


def prepare_historical(df: DataFrame) -> DataFrame:
    return df.withColumns({"kickoff_utc": F.col("match_date").cast("timestamp_ntz"), "status": F.lit("FINISHED")}).select(*COMMON)


def prepare_current(df: DataFrame, competition: str = "Premier League") -> DataFrame:
    return df.withColumns({"match_date": F.to_date("kickoff_utc"), "competition": F.coalesce("competition", F.lit(competition))}).select(*COMMON)


def find_unknown_teams(df: DataFrame, aliases: DataFrame, columns: tuple[str, ...] = ("home_team", "away_team")) -> DataFrame:
    """(team) of every name that no alias covers; `aliases` has alias (normalised) and canonical."""
    names = df.select(F.explode(F.array(*columns)).alias("team")).filter("team is not null").distinct()
    return names.withColumn("alias", C.normalise_alias(F.col("team"))).join(aliases, "alias", "left_anti").select("team")


def canonicalise_teams(df: DataFrame, aliases: DataFrame, strict: bool = False) -> DataFrame:
    """Both teams by their canonical names, with slugs as ids (m:1: an alias of two teams is an error)."""
    if strict and (unknown := [r[0] for r in find_unknown_teams(df, aliases).orderBy("team").limit(20).collect()]):
        raise UnknownTeams(f"unknown teams: {', '.join(unknown)}")
    aliases = require_unique(aliases.select("alias", "canonical"), ["alias"], "an alias stands for more than one team")
    for side in ("home", "away"):
        lookup = aliases.select(F.col("alias").alias(f"_{side}"), F.col("canonical").alias(f"_{side}_name"))
        df = join_lookup(df.withColumn(f"_{side}", C.normalise_alias(F.col(f"{side}_team"))), lookup, [f"_{side}"])
        df = df.withColumns({f"{side}_team": F.col(f"_{side}_name"), f"{side}_team_id": C.team_slug(F.col(f"_{side}_name"))}).drop(f"_{side}", f"_{side}_name")
    return df


def canonical_name(name: str, aliases: dict[str, str]) -> str:
    """The canonical name of one team; an unknown name is an error."""
    key = " ".join(name.split()).lower()
    if key not in aliases:
        raise UnknownTeams(f"unknown team: {name}")
    return aliases[key]


def add_match_keys(df: DataFrame) -> DataFrame:
    return df.withColumn("match_key", C.match_key(F.col("season"), F.col("competition"), F.col("match_date"), F.col("home_team_id"), F.col("away_team_id")))


def source_priority() -> Column:
    rank = F.lit(0)
    for source, p in PRIORITY.items():
        rank = F.when(F.col("source") == source, p).otherwise(rank)
    return rank


def deduplicate(df: DataFrame, key: str = "match_key") -> DataFrame:
    """The record of highest priority, then freshest, of each key (nulls count as freshest)."""
    w = Window.partitionBy(key).orderBy(source_priority().desc_nulls_first(), F.col("ingested_at").desc_nulls_first())
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def add_outcomes(df: DataFrame) -> DataFrame:
    r = F.col("full_time_result")
    return df.withColumns({
        "home_points": F.when(r == "H", 3).when(r == "D", 1).when(r == "A", 0).cast("long"),
        "away_points": F.when(r == "A", 3).when(r == "D", 1).when(r == "H", 0).cast("long"),
        "home_goal_difference": F.col("home_goals") - F.col("away_goals"),
    })


def team_dimension(df: DataFrame) -> DataFrame:
    sides = F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_team").alias("team_name")) for s in ("home", "away")])
    return df.select(F.explode(sides).alias("t")).select("t.*").distinct()


def union_relaxed(*frames: DataFrame) -> DataFrame:
    """Union by name; columns that a frame lacks are null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def chronological(df: DataFrame, *before: str) -> DataFrame:
    """In order of kickoff, then key (range-partitioned by Spark, no single task)."""
    return df.orderBy(*before, "kickoff_utc", "match_key")
