"""The layers on disk: ingestion into bronze, typed scans of each layer, and sinks with their reports.

Tables are written by Spark; reports are small JSON objects, each computed in one aggregation.
"""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.functions.match_columns import normalise_alias
from fixtura.operators import evaluation, gold, silver
from fixtura.sources import payloads
from fixtura.sources.client import MatchApi, fetch
from fixtura.sources.files import SourceError, canonical_json, read_csv, save_payload, save_raw, sha256_of, write_csv, write_parquet, write_report

#: Where season files are found, and of which division.
BASE, DIVISION = "https://www.football-data.co.uk/mmz4281", "E0"
#: The names of models in prediction files, where they are not the models' own.
FILE_NAMES = {"logistic_regression": "logistic", "hist_gradient_boosting": "hgb", "hist_gradient_boosting_calibrated": "hgb_calibrated", "probability_ensemble": "ensemble"}
#: The models whose calibration is compared.
CALIBRATED_MODELS = ("frequency", "elo", "logistic_regression", "hist_gradient_boosting", "hist_gradient_boosting_calibrated")


def season_code(start_year: int) -> str:
    return f"{start_year % 100:02}{(start_year + 1) % 100:02}"


def season_label(start_year: int) -> str:
    return f"{start_year}/{(start_year + 1) % 100:02}"


def season_url(start_year: int) -> str:
    return f"{BASE}/{season_code(start_year)}/{DIVISION}.csv"


def _now(at: datetime | None) -> datetime:
    return (at or datetime.now(UTC)).astimezone(UTC)


# scans


def read_table(spark: SparkSession, path: str, name: str, required: tuple[str, ...] | list[str] = (), filled: bool = False) -> DataFrame:
    """A table of a layer; a missing file, missing columns or (if `filled`) no rows are errors that name it."""
    if not Path(path).exists():
        raise SourceError(f"{name}: nothing at {path}")
    df = gold.require_columns(spark.read.parquet(path), list(required), name)
    if filled and df.isEmpty():
        raise SourceError(f"{name}: the table is empty")
    return df


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) from a YAML mapping of canonical names to lists of aliases; the canonical name
    is an alias of itself. Anything but such a mapping, and an alias of two teams, is an error."""
    import yaml

    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    value = value.get("teams", value) if isinstance(value, dict) else value
    if not isinstance(value, dict):
        raise SourceError(f"{path}: no mapping of teams")
    rows = []
    for canonical, aliases in value.items():
        if not isinstance(canonical, str) or not isinstance(aliases, list) or not all(isinstance(a, str) for a in aliases):
            raise SourceError(f"{path}: {canonical!r} has no list of names")
        rows += [(name, canonical) for name in [canonical, *aliases]]
    return silver.require_unique(spark.createDataFrame(rows, "name string, canonical string").select(normalise_alias(F.col("name")).alias("alias"), "canonical"), ["alias"], "an alias stands for more than one team")


def bronze_files(root: str) -> list[Path]:
    """The season files of bronze, in order of season."""
    return sorted(Path(root, "historical_matches").glob("season=*/matches.parquet"))


def prediction_path(folder: str, model: str, split: str) -> str:
    return f"{folder}/{FILE_NAMES.get(model, model)}_{split}.parquet"


def prediction_files(folder: str) -> dict[str, Path]:
    """Those of the known prediction files that exist; none is an error."""
    listed = {model: Path(prediction_path(folder, model, "test")) for model in CALIBRATED_MODELS}
    found = {model: path for model, path in listed.items() if path.exists()}
    if not found:
        raise SourceError(f"no predictions in {folder}")
    return found


def read_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """All prediction files as one table with a column `model`; an empty file is an error."""
    frames = [read_table(spark, str(path), model, ("match_key", "target"), filled=True).select("match_key", "target", *evaluation.P).withColumn("model", F.lit(model)) for model, path in prediction_files(folder).items()]
    return silver.union_relaxed(*frames)


# ingestion


def ingest_season(spark: SparkSession, start_year: int, bronze: str, opener=None, at: datetime | None = None) -> dict:  # noqa: ANN001
    """Downloads one season, keeps it as it came, checks it and writes it as Parquet; its manifest entry."""
    url, code, when = season_url(start_year), season_code(start_year), _now(at)
    body = fetch(url, **({"opener": opener} if opener else {}))
    raw = save_raw(body, f"{bronze}/raw/historical", f"season={code}.csv")
    table = silver.normalise_historical(read_csv(spark, str(raw), tuple(k for k, v in silver.SOURCE_COLUMNS.items() if v in silver.REQUIRED)), start_year, F.lit(when)).orderBy("match_date", "home_team", "away_team")
    row = gold.historical_violations(table)
    gold.require_clean(row, f"season {code}")
    path = f"{bronze}/historical_matches/season={code}/matches.parquet"
    write_parquet(table, path)
    return {"season": season_label(start_year), "season_code": code, "source_url": url, "raw_csv_path": str(raw), "parquet_path": path, "row_count": row.first()["row_count"], "file_sha256": sha256_of(body), "ingested_at": when.isoformat()}


def ingest_seasons(spark: SparkSession, first: int, last: int, bronze: str, opener=None) -> list[dict]:  # noqa: ANN001
    """Seasons from first to last, both included, and the manifest over them."""
    if first > last:
        raise ValueError("the first season comes after the last")
    entries = [ingest_season(spark, year, bronze, opener) for year in range(first, last + 1)]
    write_manifest(entries, bronze)
    return entries


def write_manifest(entries: list[dict], bronze: str) -> Path:
    report = {"generated_at": _now(None).isoformat(), "season_count": len(entries), "total_rows": sum(e["row_count"] for e in entries), "seasons": entries}
    return write_report(report, f"{bronze}/historical_manifest.json")


def ingest_current(spark: SparkSession, api: MatchApi, competition: str, bronze: str, at: datetime | None = None) -> dict:
    """Matches and standings of a competition: raw payloads, checked snapshots, and their manifest."""
    when = _now(at)
    given = {"matches": api.matches(competition), "standings": api.standings(competition)}
    raw = {name: save_payload(payload, f"{bronze}/raw/current", name, when) for name, payload in given.items()}
    one = {name: spark.createDataFrame([(canonical_json(payload).decode(),)], "payload string") for name, payload in given.items()}
    matches = payloads.flatten_matches(one["matches"], ingested_at=F.lit(when)).orderBy("kickoff_utc", "api_match_id")
    standings = payloads.flatten_standings(one["standings"], ingested_at=F.lit(when)).orderBy("standing_type", "position")
    gold.require_clean(current_violations(matches), "current matches")
    gold.require_clean(standing_violations(standings), "current standings")
    paths = {"matches": f"{bronze}/current/matches.parquet", "standings": f"{bronze}/current/standings.parquet"}
    write_parquet(matches, paths["matches"])
    write_parquet(standings, paths["standings"])
    manifest = {"competition": competition, "ingested_at": when.isoformat(), "source": payloads.SOURCE, "match_rows": matches.count(), "standing_rows": standings.count(), "raw": {k: str(p) for k, p in raw.items()}, "sha256": {k: sha256_of(canonical_json(v)) for k, v in given.items()}, "parquet": paths}
    write_report(manifest, f"{bronze}/current_manifest.json")
    return manifest


def current_violations(matches: DataFrame) -> DataFrame:
    """Rules of a snapshot of matches: ids there and once, a kickoff, two teams, a score where finished."""
    done = F.col("status") == "FINISHED"
    return matches.agg(
        F.count("*").alias("row_count"), F.count_if(F.col("api_match_id").isNull()).alias("missing_id"), (F.count("api_match_id") - F.countDistinct("api_match_id")).alias("duplicate_keys"), F.count_if(F.col("kickoff_utc").isNull()).alias("missing_kickoff"),
        F.count_if(F.col("home_team_id") == F.col("away_team_id")).alias("same_team"), F.count_if(done & (F.col("home_goals").isNull() | F.col("away_goals").isNull())).alias("missing_score"), F.count_if((F.col("home_goals") < 0) | (F.col("away_goals") < 0)).alias("negative_goals"),
    )


def standing_violations(standings: DataFrame) -> DataFrame:
    """Rules of a snapshot of standings: a team and a position in each row, once per type and group,
    games that add up."""
    games = F.col("won") + F.col("draw") + F.col("lost")
    return standings.agg(
        F.count("*").alias("row_count"), F.count_if(F.col("team_id").isNull() | F.col("position").isNull()).alias("missing_id"), (F.count("*") - F.countDistinct(F.struct("standing_type", F.coalesce("group", F.lit("")), F.coalesce("team_id", F.lit(-1))))).alias("duplicate_keys"),
        F.count_if(games != F.col("played_games")).alias("games_off"), F.count_if(F.col("goals_for") - F.col("goals_against") != F.col("goal_difference")).alias("difference_off"),
    )


# audit of bronze


def audit_seasons(matches: DataFrame) -> DataFrame:
    """Per partition: rows, distinct ids, teams, and dates; and ids that stand in other partitions too."""
    across = matches.groupBy("match_id").agg(F.countDistinct("season_partition").alias("_parts"))
    marked = matches.join(across, "match_id", "left")
    teams = F.array_distinct(F.flatten(F.array(F.collect_set("home_team"), F.collect_set("away_team"))))
    return marked.groupBy("season_partition").agg(F.count("*").alias("row_count"), F.countDistinct("match_id").alias("ids"), F.min("match_date").alias("first_date"), F.max("match_date").alias("last_date"), F.size(teams).cast("long").alias("teams"), F.count_if(F.col("_parts") > 1).alias("in_other_partitions"))


def audit_bronze(spark: SparkSession, bronze: str) -> dict:
    """The audit report: seasons, and the snapshots' finished matches and rows of the total table."""
    if not bronze_files(bronze):
        raise SourceError(f"no season under {bronze}")
    part = F.regexp_extract(F.input_file_name(), "season=([0-9]+)", 1)
    frames = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{bronze}/historical_matches").withColumn("season_partition", part)
    seasons = [r.asDict() for r in audit_seasons(frames).orderBy("season_partition").collect()]
    if any(s["in_other_partitions"] or s["ids"] != s["row_count"] for s in seasons):
        raise gold.DataQualityError("bronze: a match comes twice")
    report: dict = {"generated_at": _now(None).isoformat(), "seasons": seasons, "total_rows": sum(s["row_count"] for s in seasons)}
    current = f"{bronze}/current/matches.parquet"
    if Path(current).exists():
        matches, standings = read_table(spark, current, "current matches"), read_table(spark, f"{bronze}/current/standings.parquet", "current standings")
        gold.require_clean(current_violations(matches), "current matches")
        gold.require_clean(standing_violations(standings), "current standings")
        done = F.col("status") == "FINISHED"
        row = matches.agg(F.count("*").alias("rows"), F.count_if(done).alias("finished"), F.count_if(~done).alias("open")).first()
        report["current"] = row.asDict() | {"total_standing_rows": standings.filter("standing_type = 'TOTAL'").count()}
    write_report(report, f"{bronze}/audit.json")
    return report


def audit_text(report: dict) -> str:
    lines = [f"{report['total_rows']} rows in {len(report['seasons'])} seasons"]
    lines += [f"{s['season_partition']}: {s['row_count']} rows, {s['teams']} teams, {s['first_date']} to {s['last_date']}" for s in report["seasons"]]
    if "current" in report:
        c = report["current"]
        lines.append(f"current: {c['finished']} finished, {c['open']} open, {c['total_standing_rows']} standings")
    return "\n".join(lines)


# sinks of the other layers


def _row(df: DataFrame, **what: Column) -> dict:
    return df.agg(*[c.alias(n) for n, c in what.items()]).first().asDict()


def write_silver(matches: DataFrame, teams: DataFrame, folder: str) -> dict:
    write_parquet(matches, f"{folder}/matches.parquet")
    write_parquet(teams, f"{folder}/teams.parquet")
    report = _row(matches, row_count=F.count("*"), seasons=F.countDistinct("season"), first_date=F.min("match_date"), last_date=F.max("match_date"))
    report |= {"team_count": teams.count(), "rows_by_source": {r[0]: r[1] for r in matches.groupBy("source").count().collect()}, "generated_at": _now(None).isoformat()}
    write_report(report, f"{folder}/silver_report.json")
    return report


def write_form(team_form: DataFrame, match_form: DataFrame, folder: str) -> dict:
    write_parquet(team_form, f"{folder}/team_form.parquet")
    write_parquet(match_form, f"{folder}/match_form.parquet")
    report = _row(team_form, team_rows=F.count("*"), teams=F.countDistinct("team_id"), first_kickoff=F.min("kickoff_utc"), last_kickoff=F.max("kickoff_utc")) | {"match_rows": match_form.count(), "generated_at": _now(None).isoformat()}
    write_report(report, f"{folder}/form_report.json")
    return report


def write_elo(history: DataFrame, match_elo: DataFrame, folder: str, parameters: dict) -> dict:
    """Both tables, and ratings over both sides: their range, and how many teams are rated."""
    write_parquet(history, f"{folder}/elo_history.parquet")
    write_parquet(match_elo, f"{folder}/match_elo.parquet")
    sides = match_elo.select(F.explode(F.array(*[F.struct(F.col(f"{s}_team_id").alias("team_id"), F.col(f"{s}_elo_pre").alias("rating")) for s in ("home", "away")])).alias("t")).select("t.*")
    report = _row(sides, teams=F.countDistinct("team_id"), least_rating=F.min("rating"), greatest_rating=F.max("rating")) | {"match_rows": match_elo.count(), "parameters": parameters, "generated_at": _now(None).isoformat()}
    write_report(report, f"{folder}/elo_report.json")
    return report


def write_model_dataset(dataset: DataFrame, folder: str, validation: str, test: str) -> dict:
    write_parquet(dataset, f"{folder}/model_dataset.parquet")
    splits = dataset.groupBy("split").agg(F.count("*").alias("row_count"), F.min("kickoff_utc").alias("first_kickoff"), F.max("kickoff_utc").alias("last_kickoff"), F.countDistinct("season").alias("seasons"))
    targets = dataset.groupBy("split", "target").agg(F.count("*").alias("row_count"))
    write_parquet(splits, f"{folder}/split_summary.parquet")
    write_parquet(targets, f"{folder}/target_distribution.parquet")
    report = _row(dataset, row_count=F.count("*"), labelled_rows=F.count("target"), column_count=F.lit(len(dataset.columns))) | {"validation_season": validation, "test_season": test, "splits": {r["split"]: r["row_count"] for r in splits.collect()}, "generated_at": _now(None).isoformat()}
    write_report(report, f"{folder}/model_dataset_report.json")
    return report


def write_predictions(scored: DataFrame, folder: str, model: str, split: str) -> str:
    path = prediction_path(folder, model, split)
    write_parquet(scored, path)
    return path


def write_records(records: DataFrame, folder: str, name: str, **more: object) -> list[dict]:
    """A small table of metric records (models by splits or folds) as Parquet, CSV and JSON, the best first."""
    write_parquet(records.coalesce(1), f"{folder}/{name}.parquet")
    write_csv(records.coalesce(1), f"{folder}/{name}_csv")
    rows = [r.asDict() for r in records.collect()]
    write_report({"generated_at": _now(None).isoformat(), "records": rows, "best": rows[0] if rows else None, **more}, f"{folder}/{name}.json")
    return rows


def write_future(predictions: DataFrame, folder: str, audit: dict) -> None:
    write_parquet(predictions, f"{folder}/future_predictions.parquet")
    write_csv(predictions, f"{folder}/future_predictions_csv")
    write_report(audit | {"generated_at": _now(None).isoformat()}, f"{folder}/future_predictions_audit.json")
