"""What a cut would lose: each test holds an operator to the whole of its job."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from fixtura.operators import form, models
from fixtura.plans import catalogue

from .conftest import SF


def labelled(spark, n=600):
    rng = np.random.default_rng(1)
    rows = [(f"m{k:04}", datetime(2000, 1, 1) + timedelta(days=k), "train" if k < n // 2 else "validation" if k < 3 * n // 4 else "test", k % 3, float(k % 3 + rng.normal())) for k in range(n)]
    return spark.createDataFrame(rows, "match_key string, kickoff_utc timestamp, split string, target long, x double")


def test_the_bound_is_for_fitting_only(spark, monkeypatch):
    df = labelled(spark)
    whole = df.filter("split = 'validation'").toPandas()
    monkeypatch.setattr(models, "MOST_ROWS", 90)
    last = df.filter("split = 'train'").toPandas().tail(90)
    xy = lambda f: (f[["x"]].to_numpy(float), f["target"].to_numpy(int))
    x, y = xy(whole)
    want = models.log_loss(models.Logistic(0.1).fit(*xy(last)).predict(x), y)
    assert [r.log_loss for r in models.logistic_grid(df, ["x"], (0.1,)).filter("class_weight = 'none'").collect()] == [pytest.approx(want)]
    cut = int(len(whole) * 0.6)
    want = models.log_loss(models.Boosting(5, 0.1, 4, 5, 1.0).fit(*xy(last)).predict(x[:cut]), y[:cut])
    assert models.boosting_grid(df, ["x"], ((5, 0.1, 4, 5, 1.0),)).first().log_loss == pytest.approx(want, abs=1e-5)


def test_models_see_the_features_and_grids_of_the_reference(spark):
    assert len(catalogue.X) == 35 and len(models.BOOSTING) == 6 and {g[0] for g in models.BOOSTING} == {200, 300, 400, 500}
    df = catalogue._features(spark, SF)
    assert df.columns[4:] == catalogue.X
    rows = df.collect()
    assert len({r.match_key for r in rows}) == len(rows)
    for r in rows:
        assert all(r[c] is not None for c in catalogue.X)
        assert r.form_points_difference == r.home_points_last_5 - r.away_points_last_5 and r.elo_difference == pytest.approx(r.home_elo_pre - r.away_elo_pre)
        assert r.home_average_points_last_5 == pytest.approx(r.home_points_last_5 / max(1, min(5, r.home_matches_played_before)))
    assert any(r.home_days_since_previous_match > 0 for r in rows) and any(r.away_losses_last_5 > 0 for r in rows)


def test_form_after_many_scheduled_fixtures(spark):
    day = lambda k: datetime(2000, 1, 1) + timedelta(days=k)
    schema = "match_key string, season string, kickoff_utc timestamp, status string, home_team_id string, away_team_id string, home_goals long, away_goals long, full_time_result string"
    rows = [(f"a{k:02}", "2000", day(k), "FINISHED", "x", "y", 1, 0, "H") for k in range(7)] + [(f"b{k:02}", "2000", day(10 + k), "TIMED", "x", "y", None, None, None) for k in range(30)]
    rows += [("c00", "2000", day(50), "FINISHED", "x", "y", 0, 0, "D"), ("c01", "2000", day(51), "TIMED", "x", "y", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = {(r[0], r[1]): r[2] for r in form.form_as_of(df, form.team_history(df)).collect()}
    assert [got[f"a{k:02}", "home"] for k in range(7)] == [0, 3, 6, 9, 12, 15, 15]
    assert {got[f"b{k:02}", "home"] for k in range(30)} == {15} == {got["c00", "home"]}
    assert got["c01", "home"] == 13 and got["c01", "away"] == 1
