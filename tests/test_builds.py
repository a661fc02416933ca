"""The named pipelines end to end over a league of eight teams, and what they check."""

import json
import random
from datetime import date, datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fixtura.operators import bundle, evaluation, gold, models, probability, silver
from fixtura.operators.joins import CardinalityError, checked_join, key_differences
from fixtura.plans import build, pipeline
from fixtura.settings import configure_logging, health, read_settings
from fixtura.sources import layers
from fixtura.sources.files import SourceError

TEAMS = [f"Town {c}" for c in "ABCDEFGH"]
FEATURES = ["home_points_last_5", "away_points_last_5", "form_points_difference", "home_elo_pre", "away_elo_pre", "home_expected_score"]


def season_csv(year):
    rng, rows = random.Random(year), ["Date,Time,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HS,Referee"]
    pairs = [(a, b) for a in TEAMS for b in TEAMS if a != b]
    rng.shuffle(pairs)
    for k, (a, b) in enumerate(pairs):
        h, w = rng.randrange(4) + (TEAMS.index(a) < 4), rng.randrange(4)
        day = date(year, 8, 10) + timedelta(days=4 * k)
        rows.append(f"{day:%d/%m/%Y},15:00,{a}, {b.lower()} ,{h},{w},{'H' if h > w else 'A' if h < w else 'D'},{k},x")
    return "\n".join(rows).encode()


def opener(request, timeout):
    url = request.full_url
    if url.endswith("/matches"):
        team = lambda k: {"id": k, "name": TEAMS[k]}
        return json.dumps({"competition": {"id": 1, "code": "PL", "name": "Premier League"}, "matches": [{"id": 900 + k, "utcDate": f"2025-08-{10 + k}T14:00:00Z", "status": "TIMED", "season": {"startDate": "2025-08-01"}, "homeTeam": team(k), "awayTeam": team(k + 4)} for k in range(4)]}).encode()
    if url.endswith("/standings"):
        return json.dumps({"competition": {"code": "PL"}, "season": {"startDate": "2025-08-01"}, "standings": [{"type": "TOTAL", "table": [{"position": 1, "team": {"id": 0, "name": "Town A"}, "playedGames": 2, "won": 1, "draw": 1, "lost": 0, "points": 4, "goalsFor": 3, "goalsAgainst": 1, "goalDifference": 2}]}]}).encode()
    return season_csv(2000 + int(url.split("/")[-2][:2]))


@pytest.fixture(scope="module")
def builds(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("layers")
    (root / "aliases.yaml").write_text("teams:\n" + "".join(f"  {t}: ['{t} FC']\n" for t in TEAMS))
    at = read_settings({"FIXTURA_" + k.upper(): f"{root}/{k}" for k in ("bronze", "silver", "gold", "artifacts")} | {"FIXTURA_API_TOKEN": "t"}).make_folders()
    return build.Builds(spark, at, f"{root}/aliases.yaml", (2022, 2024), opener, FEATURES, ((8, 0.2, 4, 5, 1.0),), (0.1, 1.0))


def test_full_pipeline(spark, builds):
    run = build.run_named(builds, "full")
    assert [o.status for o in run.outcomes] == ["success"] * 13
    folder = Path(builds.at.artifacts)
    assert json.loads((folder / "runs/latest.json").read_text())["run_id"] == run.run_id
    future = spark.read.parquet(f"{builds.predictions}/future_predictions.parquet")
    assert future.count() == 4 and gold.null_counts(future).first().asDict() == dict.fromkeys(future.columns, 0)
    for day, models_ in (("day_3", 6), ("day_4", 7)):
        table = json.loads((folder / f"reports/{day}_model_comparison.json").read_text())["records"]
        assert len(table) == models_ and [r["log_loss"] for r in table] == sorted(r["log_loss"] for r in table)
    dataset = spark.read.parquet(f"{builds.at.gold}/model_dataset.parquet")
    assert {r[0]: r[1] for r in dataset.groupBy("split").count().collect()} == {"train": 56, "validation": 56, "test": 56, "future": 4}
    report = json.loads((Path(builds.at.gold) / "elo_report.json").read_text())
    assert report["teams"] == 8 and report["least_rating"] < 1500 < report["greatest_rating"]
    audit = layers.audit_bronze(spark, builds.at.bronze)
    assert audit["total_rows"] == 168 and audit["current"] == {"rows": 4, "finished": 0, "open": 4, "total_standing_rows": 1} and "168 rows in 3 seasons" in layers.audit_text(audit)
    rows = builds.calibration(5)
    assert {r["model"] for r in rows} == set(layers.CALIBRATED_MODELS)
    assert Path(builds.predictions, "hgb_calibrated_test.parquet").exists()


def test_bundle_round_trip_and_artifact_checks(builds):
    path, manifest, report = f"{builds.production}/bundle.pickle", f"{builds.production}/manifest.json", f"{builds.reports}/production_training.json"
    loaded = bundle.load_bundle(path)
    assert loaded.feature_names == tuple(FEATURES) and sum(loaded.weights) == pytest.approx(1)
    rows = bundle.future_rows(builds._dataset())
    assert bundle.predict(loaded, rows, ["match_key"]).count() == 4
    with pytest.raises(gold.DataQualityError, match="home_elo_pre"):
        bundle.predict(loaded, rows.drop("home_elo_pre"), ["match_key"])
    good = bundle.check_artifacts(path, manifest, report)
    changes = [({"feature_names": []}, ValueError), ({"feature_count": "six"}, TypeError), ({"feature_names": FEATURES[::-1]}, ValueError), ({"class_labels": [0, 1, 1]}, ValueError), ({"class_names": "none"}, TypeError), ({"ensemble_weights": {"a": 0.4, "b": 0.4}}, ValueError), ({"ensemble_weights": {"a": "1"}}, TypeError), ({"ensemble_weights": []}, TypeError), ({"bundle_path": "elsewhere"}, ValueError), ({"bundle_path": 3}, TypeError)]
    for change, error in changes:
        Path(manifest).write_text(json.dumps(good | change))
        with pytest.raises(error):
            bundle.check_artifacts(path, manifest, report)
    for text, error in (("{", ValueError), ("[]", TypeError), ("{}", ValueError)):
        Path(manifest).write_text(text)
        with pytest.raises(error):
            bundle.check_artifacts(path, manifest, report)
    Path(manifest).write_text(json.dumps(good))
    with pytest.raises(FileNotFoundError):
        bundle.check_artifacts(path + "x", manifest, report)
    assert bundle.contract_hash(["a", "b"]) != bundle.contract_hash(["b", "a"])


def test_reports_that_lack_something():
    assert bundle.selected_weights({"selected_weights": {bundle.LOGISTIC: 0.25, bundle.BOOSTING: 0.75}}) == (0.25, 0.75)
    for bad in ({}, {"selected_weights": {bundle.LOGISTIC: "1", bundle.BOOSTING: 0}}):
        with pytest.raises(TypeError):
            bundle.selected_weights(bad)
    assert bundle.logistic_configuration({"selected_parameters": {"regularisation_strength": 2, "class_weight": "none"}}) == (2.0, False)
    with pytest.raises(ValueError):
        bundle.logistic_configuration({"selected_parameters": {"regularisation_strength": 2, "class_weight": "odd"}})
    with pytest.raises(ValueError, match="max_iter"):
        bundle.boosting_configuration({"selected_parameters": {"learning_rate": 0.1}})
    with pytest.raises(TypeError, match="log_loss"):
        evaluation.metric_record({"test_metrics": dict.fromkeys(evaluation.METRICS[:3], 1.0)}, "m")
    assert probability.parse_numbers("1,0.5,0,0.5") == (0.0, 0.5, 1.0) and probability.parse_strengths("10, 0.1") == (0.1, 10.0)
    for parse, text in ((probability.parse_numbers, "1.5"), (probability.parse_strengths, "0"), (probability.parse_numbers, " , ")):
        with pytest.raises(ValueError):
            parse(text)
    with pytest.raises(ValueError):
        probability.check_weights(0.5, 0.4)


def test_sources_that_are_missing_or_wrong(spark, builds, tmp_path):
    with pytest.raises(SourceError, match="silver"):
        layers.read_table(spark, f"{tmp_path}/none.parquet", "silver matches")
    for text in ("[1]", "teams: {A: b}", "teams: {1: [a]}"):
        (tmp_path / "a.yaml").write_text(text)
        with pytest.raises(SourceError):
            layers.read_aliases(spark, f"{tmp_path}/a.yaml")
    (tmp_path / "a.yaml").write_text("A: [x]\nB: [' X ']\n")
    with pytest.raises(CardinalityError):
        layers.read_aliases(spark, f"{tmp_path}/a.yaml")
    with pytest.raises(ValueError):
        layers.ingest_seasons(spark, 2024, 2023, str(tmp_path))
    assert layers.season_url(1999).endswith("/9900/E0.csv")
    with pytest.raises(SourceError):
        layers.prediction_files(str(tmp_path))
    with pytest.raises(ValueError, match="unknown pipeline"):
        build.run_named(builds, "odd")
    with pytest.raises(silver.UnknownTeams):
        silver.canonical_name("Nobody", {"town a": "Town A"})
    assert silver.canonical_name("  TOWN  a", {"town a": "Town A"}) == "Town A"
    assert all(health(builds.at).values()) and not health(builds.at, ("no_such_module",))["no_such_module"]
    with pytest.raises(gold.DataQualityError, match="no labelled rows"):
        gold.split_rows(builds._dataset(), "future", FEATURES)
    log = configure_logging("debug", f"{tmp_path}/x/log.txt")
    log.info("hello")
    assert len(configure_logging().handlers) == 1 and "hello" in (tmp_path / "x/log.txt").read_text()


def test_joins_that_assert_their_cardinality(spark):
    one = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, x string")
    two = spark.createDataFrame([(1, "c"), (1, "d"), (None, "n"), (None, "m")], "k int, y string")
    with pytest.raises(Exception, match="keys: k"):
        checked_join(one, two, "k", "left", "m:1", "keys").collect()
    assert checked_join(two, one, "k", "left", "m:1").count() == 4
    with pytest.raises(Exception, match="not unique"):
        checked_join(two, one, "k", "inner", "1:1").collect()
    assert key_differences(one.dropna(), two.dropna(), ["k"]) == {"only_first": [(2,)], "only_second": []}
    p = spark.createDataFrame([("a", 0, 0.2, 0.3, 0.5), ("b", 1, 0.2, 0.3, 0.5)], "match_key string, target long, probability_away_win double, probability_draw double, probability_home_win double")
    assert probability.align(p, p.orderBy("match_key", ascending=False)).count() == 2
    for other, message in ((p.withColumn("target", F.lit(2).cast("long")), "targets differ"), (p.limit(1), "only one model"), (p.union(p), "predictions of a row")):
        with pytest.raises(Exception, match=message):
            probability.align(p, other).collect()
    aliases = spark.createDataFrame([("x", "A"), ("x", "B")], "alias string, canonical string")
    with pytest.raises(CardinalityError):
        silver.canonicalise_teams(spark.createDataFrame([("x", "x")], "home_team string, away_team string"), aliases)


def test_folds_and_partitions(spark):
    rows = [(f"m{k:03}", f"20{20 + k // 30}", datetime(2020 + k // 30, 1, 1) + timedelta(days=k % 30), k % 3, (k % 3) * 1.0) for k in range(120)]
    df = spark.createDataFrame(rows, "match_key string, season string, kickoff_utc timestamp, target long, x double")
    numbered = {r.match_key: r._n for r in gold.number_in_time(df.repartition(5)).collect()}
    assert numbered == {f"m{k:03}": k + 1 for k in range(120)}
    with pytest.raises(Exception, match="fewer than 30"):
        gold.chronological_partition(df.limit(20), 0.6).collect()
    scored = models.backtest(evaluation.folds_of(df), ["x"], boosting=(3, 0.2, 3, 5, 1.0))
    got = {(r.fold_number, r.model): r.row_count for r in probability.metrics(scored, ["fold_number", "model"]).collect()}
    assert got == {(n, m): 30 for n in (1, 2) for m in ("logistic_regression", "hist_gradient_boosting")}
    early, late = df.filter("season < '2022'"), df.filter("season >= '2022'")
    assert gold.fold_violations(early, late).first().asDict() == {"row_count": 60, "no_evaluation": 0, "not_in_order": 0}
    assert gold.fold_violations(late, early).first().not_in_order == 1 and gold.fold_violations(early, late.limit(0)).first().no_evaluation == 1
    assert evaluation.labelled(scored).count() == 120
    with pytest.raises(Exception, match="out of range"):
        evaluation.labelled(scored.withColumn("target", F.lit(7).cast("long"))).collect()


def test_components_are_rated_apart(spark):
    from fixtura.operators import elo

    day = lambda k: datetime(2020, 1, 1) + timedelta(days=k)
    chain = [(f"k{i:02}", day(i), f"t{i:02}", f"t{i + 1:02}", 1, 0, "FINISHED") for i in range(12)] + [(f"z{i}", day(i), "y", "z", i % 2, 0, "FINISHED") for i in range(3)] + [("n0", day(0), None, "solo", 1, 0, "FINISHED")]
    df = spark.createDataFrame(chain, "match_key string, kickoff_utc timestamp, home_team_id string, away_team_id string, home_goals long, away_goals long, status string")
    found = [{tuple(r) for r in elo.components(df, most_pairs=n).collect()} for n in (1000, 1)]
    assert {r[1] for r in found[0]} == {"t00", "y"} and found[0] == found[1] and len(found[0]) == 15
    got = {r.match_key: (r.home_elo_pre, r.away_elo_post) for r in elo.elo_history(df).collect()}
    want = elo.fold(df.filter("home_team_id is not null").toPandas(), elo.EloParameters())
    assert len(got) == 16 and all(got[r.match_key] == pytest.approx((r.home_elo_pre, r.away_elo_post)) for r in want.itertuples())
    assert elo.elo_history(df.limit(0)).count() == 0


def test_runs_record_what_was_printed():
    run = pipeline.run_stages("x", [pipeline.Stage("a", lambda: print("hello")), pipeline.Stage("b", lambda: 1 / 0, optional=True)], continue_after_optional=False)
    assert run.outcomes[0].printed == "hello\n" and run.broken == "b"
    with pytest.raises(ValueError):
        pipeline.run_stages("x", [])
