from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest

from fixtura.functions import match_columns as C
from fixtura.operators import elo, form, gold, models, probability, silver
from pyspark.sql import functions as F

from .conftest import SF

MATCHES = "match_key string, season string, kickoff_utc timestamp, status string, home_team_id string, away_team_id string, home_goals long, away_goals long, full_time_result string"


def three(spark):
    return spark.createDataFrame([
        ("m1", "2024/25", datetime.fromisoformat("2024-08-01"), "FINISHED", "arsenal", "chelsea", 2, 0, "H"), ("m2", "2024/25", datetime.fromisoformat("2024-08-08"), "FINISHED", "chelsea", "arsenal", 1, 1, "D"),
        ("m3", "2024/25", datetime.fromisoformat("2024-08-15"), "FINISHED", "arsenal", "chelsea", 0, 3, "A"),
    ], MATCHES)


def test_form(spark):
    got = form.rolling_form(form.rest_days(form.team_history(three(spark)))).filter("team_id = 'arsenal'").orderBy("match_key").collect()
    assert [r.rest_days for r in got] == [None, 7, 7]
    last = got[-1]
    assert (last.matches_played_before, last.points_last_5, last.goals_for_last_5, last.goals_against_last_5, last.wins_last_5, last.draws_last_5, last.losses_last_5) == (2, 4, 3, 1, 1, 1, 0)
    assert form.rolling_form(form.team_history(three(spark)), 1).filter("team_id = 'arsenal' and match_key = 'm3'").first().points_last_5 == 1
    with pytest.raises(ValueError):
        form.rolling_form(three(spark), 0)


def test_elo(spark):
    frame = three(spark).toPandas()
    frame.loc[2, ["status", "home_goals", "away_goals"]] = ["TIMED", None, None]
    out = elo.fold(frame, elo.EloParameters())
    assert list(out["actual_home"])[:2] == [1.0, 0.5] and pd.isna(out["actual_home"].iloc[2])
    assert out.iloc[2]["home_elo_pre"] == out.iloc[2]["home_elo_post"]
    assert elo.elo_invariants(elo.elo_history(three(spark))).first().asDict() == {"row_count": 3, "duplicate_keys": 0, "outside_unit": 0, "not_one": 0, "not_conserved": 0}
    with pytest.raises(ValueError):
        elo.EloParameters(k=0)


def test_labels_and_slugs(spark):
    row = spark.range(1).select(C.season_label(F.lit(2019)).alias("a"), C.season_code(F.lit(2025)).alias("b"), C.team_slug(F.lit("  Brighton &  Hove\tAlbion F.C. ")).alias("c"), C.result_of(F.lit(1), F.lit(None).cast("int")).alias("d")).first()
    assert tuple(row) == ("2019/20", "2526", "brighton-and-hove-albion-fc", None)


def test_metrics(spark):
    df = spark.createDataFrame([("a", t, 1 / 3, 1 / 3, 1 / 3) for t in range(3)] + [("b", t, *[float(t == k) for k in range(3)]) for t in range(3)], "model string, target long, probability_away_win double, probability_draw double, probability_home_win double")
    got = {r.model: r for r in probability.metrics(df, ["model"]).collect()}
    assert got["a"].brier_score == pytest.approx(2 / 3) and got["b"].accuracy == 1 and got["b"].log_loss == pytest.approx(0)
    bins = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.5, 0.999, 1.0)], "p double").select(probability.bin_of(F.col("p"))).collect()
    assert [b[0] for b in bins] == [0, 1, 5, 9, 9]
    with pytest.raises(ValueError):
        probability.bin_edges(1)


def test_models():
    rng = np.random.default_rng(42)
    y = np.repeat([0, 1, 2], 60)
    x = rng.normal(0, 0.4, (180, 2)) + (y[:, None] - 1) * 2
    prior = np.log(3)
    for model in (models.Logistic(0.1), models.Logistic(1.0, True), models.Boosting(30, 0.1, 7, 5)):
        p = model.fit(x, y).predict(x)
        assert np.allclose(p.sum(1), 1) and models.log_loss(p, y) < prior / 2
    boosted = models.Boosting(20, 0.1, 7, 5).fit(x, y)
    assert models.log_loss(models.Sigmoid().fit(boosted.raw(x), y).predict(boosted.raw(x)), y) < prior / 2
    assert models.permutation_importance(boosted.predict, x, y, 3).shape == (2, 2)
    with pytest.raises(ValueError):
        models.Logistic().fit(x[:60], y[:60])


def test_unknown_teams_and_dirty_layers(spark):
    aliases = spark.createDataFrame([("arsenal", "Arsenal")], "alias string, canonical string")
    df = spark.createDataFrame([(" ARSENAL\t", "Nobody")], "home_team string, away_team string")
    assert [r[0] for r in silver.find_unknown_teams(df, aliases).collect()] == ["Nobody"]
    with pytest.raises(silver.UnknownTeams, match="Nobody"):
        silver.canonicalise_teams(df, aliases, strict=True)
    bad = three(spark).withColumn("match_date", F.to_date("kickoff_utc")).withColumn("away_team_id", F.col("home_team_id"))
    with pytest.raises(gold.DataQualityError, match="same_team"):
        gold.require_clean(gold.silver_violations(bad), "silver")


@pytest.mark.parametrize("name", ["rolling_form", "match_form", "dedup_matches", "reliability_by_class", "weight_search", "p4_found"])
def test_oracles(spark, name):
    import os

    import __spark_entry__ as entry

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    ours = entry.queries()[name](spark, SF)
    theirs = con.execute(entry.oracle_sql()[name]).fetchall()
    names = [c[0] for c in con.execute(entry.oracle_sql()[name]).description]
    key = lambda rows: sorted(tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(ours.select(*names).collect()) == key(theirs)
