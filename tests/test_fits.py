"""Fits of outcome models: rows stay on executors, and trees count what they must only once."""

from datetime import datetime, timedelta

import numpy as np
import pytest

from fixtura.operators import evaluation, models


@pytest.fixture
def rows(spark, monkeypatch):
    """(frame, same rows in pandas) of 240 matches; collecting rows as pandas or all at once fails."""
    rng = np.random.default_rng(3)
    day = lambda k: datetime(2015, 1, 1) + timedelta(days=k)
    made = [(f"m{k:04}", f"20{15 + k // 60}", day(k), "train" if k < 120 else "validation", k % 3 if k < 230 else None, float(k % 3 + rng.normal()), float(rng.normal())) for k in range(240)]
    df = spark.createDataFrame(made, "match_key string, season string, kickoff_utc timestamp, split string, target long, x double, z double").repartition(3)
    whole = df.toPandas().sort_values("match_key")

    def refused(*_):  # noqa: ANN202
        raise AssertionError("rows were collected on the driver")

    monkeypatch.setattr(type(df), "toPandas", refused)
    return df, whole


def xy(frame):
    frame = frame[frame.target.notna()]
    return frame[["x", "z"]].to_numpy(float), frame.target.to_numpy(int)


def test_f4_grid_of_logistic_fits_without_rows_on_the_driver(rows):
    df, whole = rows
    got = {(r.c, r.class_weight): r.log_loss for r in models.logistic_grid(df, ["x", "z"], (0.1, 1.0)).collect()}
    train, valid = xy(whole[whole.split == "train"]), xy(whole[whole.split == "validation"])
    want = {(c, "balanced" if b else "none"): models.log_loss(models.Logistic(c, b).fit(*train).predict(valid[0]), valid[1]) for c in (0.1, 1.0) for b in (False, True)}
    assert got == {k: pytest.approx(v) for k, v in want.items()}


def test_f6_coefficients_without_rows_on_the_driver(rows):
    df, whole = rows
    w = models.Logistic(0.1).fit(*xy(whole)).w
    got = {(r.class_label, r.feature): r.coefficient for r in models.logistic_coefficients(df, ["x", "z"]).collect()}
    assert got == {(name, f): pytest.approx(w[j, k], abs=1e-5) for k, name in enumerate(("away_win", "draw", "home_win")) for j, f in enumerate("xz")}


def test_f7_production_without_rows_on_the_driver(rows):
    df, whole = rows
    boosting = (5, 0.1, 4, 5, 1.0)
    model, details = models.fit_production(df, ["x", "z"], boosting=boosting)
    assert details == {"labelled_rows": 230, "hgb_fit_rows": 195, "calibration_rows": 35, "training_cutoff": str(np.datetime64(whole[whole.target.notna()].kickoff_utc.max(), "us"))}
    x, y = xy(whole)
    early = models.Boosting(*boosting).fit(x[:195], y[:195])
    want = models.Blend(models.Logistic(0.1).fit(x, y), models.Calibrated(early, models.Sigmoid().fit(early.raw(x[195:]), y[195:])), 0.5)
    assert np.allclose(model.predict(x), want.predict(x))
    assert models.production_predict(df, ["x", "z"], boosting=boosting).count() == 10
    with pytest.raises(ValueError, match="no more than 300"):
        models.fit_production(df, ["x", "z"], least=300)


def test_f5_features_that_depend_on_each_other_are_counted_together(monkeypatch):
    rng, counted, bincount = np.random.default_rng(5), [], np.bincount
    a, b = rng.integers(0, 6, 6000), rng.integers(0, 6, 6000)
    x = np.stack([*(np.round(a * (k + 1) + b * (k % 3)) for k in range(20)), rng.normal(size=6000)], 1).astype(float)
    y = (a + b + rng.integers(0, 3, 6000)) % 3
    want = models.Boosting(1, 0.1, 5, 20).fit(x, y)
    monkeypatch.setattr(np, "bincount", lambda v, *more, **named: (counted.append(len(v)), bincount(v, *more, **named))[1])
    model = models.Boosting(11, 0.1, 5, 20).fit(x, y)
    first = sum(counted)
    counted.clear()
    models.Boosting(1, 0.1, 5, 20).fit(x, y)
    assert first - sum(counted) < 10 * 3 * 21 * 6000 * 3 / 4  # a quarter less than one pass over rows and features for each tree
    # sums of packs are those of each feature
    codes, g, h = want._codes(x), models._fixed(rng.uniform(-1, 1, 6000)), models._fixed(rng.uniform(0, 0.25, 6000))
    for part in (None, np.arange(0, 6000, 7)):
        table = models._Packs(codes, 64).sums(g, h, part)
        at = np.arange(6000) if part is None else part
        for j in range(21):
            assert [list(t) for t in table[:, j]] == [list(bincount(codes[j][at], v, 65)) for v in (g[at], h[at], np.ones(len(at)))]
    # what a tree gave its training rows is what it says of them again
    raw = np.tile(model.start, (len(x), 1))
    for round_ in model.trees:
        raw += model.rate * np.stack([model._walk(t, model._codes(x)) for t in round_], 1)
    assert np.allclose(raw, model.raw(x)) and models.log_loss(model.predict(x), y) < models.log_loss(np.tile(np.exp(model.start), (len(x), 1)), y)


def test_f3_importance_without_rows_on_the_driver(rows):
    df, whole = rows
    boosting = (5, 0.1, 4, 5, 1.0)
    model = models.Boosting(*boosting).fit(*xy(whole[whole.split == "train"]))
    x, y = xy(whole[whole.split == "validation"])
    cut = int(len(y) * 0.6)
    got = {r.feature: r.importance_mean for r in models.boosting_importance(df, ["x", "z"], boosting, 4).collect()}
    for j, name in enumerate("xz"):
        assert got[name] == pytest.approx(models.permutation_importance(model.predict, x[:cut], y[:cut], 4, 42 + j, [j])[0, 0])


def test_f2_folds_are_fitted_in_one_job(rows, monkeypatch):
    df, whole = rows
    calls, fit = [], models.fit_groups
    monkeypatch.setattr(models, "fit_groups", lambda groups, *more: (calls.append(len(groups)), fit(groups, *more))[1])
    scored = models.backtest(evaluation.folds_of(df.filter("target is not null")), ["x", "z"], boosting=(3, 0.2, 3, 5, 1.0))
    got = {(r.match_key, r.model): r.probability_draw for r in scored.collect()}
    assert calls == [2] and len(got) == 2 * (230 - 120)
    for season in ("2017", "2018"):
        model = models.Logistic(0.1).fit(*xy(whole[whole.season < season]))
        for r in whole[(whole.season == season) & whole.target.notna()].itertuples():
            assert got[r.match_key, "logistic_regression"] == pytest.approx(model.predict(np.array([[r.x, r.z]]))[0, 1])


@pytest.fixture
def counted(spark, rows):
    """(frame that counts the rows it makes, the counter, the rows in pandas)."""
    df, whole = rows
    made = spark.sparkContext.accumulator(0)

    def count(batches):  # noqa: ANN202
        for b in batches:
            made.add(len(b))
            yield b

    return df.mapInPandas(count, df.schema), made, whole


def test_f4_grid_of_logistic_fits_on_all_training_rows_made_once(counted, monkeypatch):
    df, made, whole = counted
    monkeypatch.setattr(models, "MOST_ROWS", 60)
    df = df.withColumn("same", models.F.lit(0.1))
    got = {(r.c, r.class_weight): (r.log_loss, r.brier_score) for r in models.logistic_grid(df, ["x", "z", "same"], (0.01, 100.0)).collect()}
    assert made.value == 240
    train, valid = xy(whole[whole.split == "train"]), xy(whole[whole.split == "validation"])
    for c in (0.01, 100.0):
        for b in (False, True):
            p = models.Logistic(c, b).fit(*train).predict(valid[0])
            assert got[c, "balanced" if b else "none"] == pytest.approx((models.log_loss(p, valid[1]), ((p - np.eye(3)[valid[1]]) ** 2).sum(1).mean()))
    with pytest.raises(ValueError, match="all three classes"):
        models.logistic_grid(df.filter("target != 1"), ["x", "z"], (0.1,))


def test_f3_importance_of_rows_made_once(counted):
    df, made, _ = counted
    assert models.boosting_importance(df, ["x", "z"], (3, 0.1, 4, 5, 1.0), 2).count() == 2
    assert made.value == 240


def test_f3_importance_walks_only_trees_that_ask_for_the_feature_and_once(monkeypatch):
    rng, walks, walk = np.random.default_rng(4), [], models.Boosting._walk
    x = np.c_[rng.normal(size=(3000, 4)), rng.integers(0, 3, 3000), np.zeros(3000)]
    y = (x[:, 4].astype(int) + (x[:, 0] > 0.5) + (x[:, 1] * x[:, 2] > 0)) % 3
    model = models.Boosting(12, 0.2, 7, 20).fit(x, y)
    want = [models.permutation_importance(model.predict, x, y, 5, 42 + j, [j])[0] for j in range(6)]
    monkeypatch.setattr(models.Boosting, "_walk", staticmethod(lambda *a: (walks.append(1), walk(*a))[1]))
    got = models._Importance(model, list(range(6)), 5).fit(x, y)
    assert np.allclose(got, want, atol=1e-12) and got[5].tolist() == [0, 0] and got[4, 0] > 0.1
    assert len(walks) < 36 + 6 * 5 * 36 / 2  # shuffling and scoring anew walks all trees 6 * 5 times


def test_f5_coefficients_of_all_labelled_rows(rows, monkeypatch):
    df, whole = rows
    monkeypatch.setattr(models, "MOST_ROWS", 60)
    w = models.Logistic(0.1).fit(*xy(whole)).w
    got = {(r.class_label, r.feature): r.coefficient for r in models.logistic_coefficients(df, ["x", "z"]).collect()}
    assert got == {(name, f): pytest.approx(w[j, k], abs=1e-5) for k, name in enumerate(("away_win", "draw", "home_win")) for j, f in enumerate("xz")}


@pytest.mark.parametrize("most", [60, 1000])
def test_f3_grid_of_boosting_fits_on_all_training_rows(rows, monkeypatch, most):
    df, whole = rows
    monkeypatch.setattr(models, "MOST_ROWS", most)
    grid = tuple((n, 0.1, 4, 5, 1.0) for n in (1, 2, 3, 4, 5))
    got = [r.log_loss for r in models.boosting_grid(df, ["x", "z"], grid).orderBy("iterations").collect()]
    train, (x, y) = xy(whole[whole.split == "train"]), xy(whole[whole.split == "validation"])
    cut = int(len(y) * 0.6)
    assert got == [pytest.approx(models.log_loss(models.Boosting(*g).fit(*train).predict(x[:cut]), y[:cut]), abs=1e-5) for g in grid]


def test_f3_trees_of_split_rows_are_those_of_all_rows_together(spark):
    rng = np.random.default_rng(8)
    x = np.c_[rng.normal(size=(4000, 3)), rng.integers(0, 5, 4000), np.full(4000, 0.1)]
    y = (x[:, 3].astype(int) + (x[:, 0] > 0) + rng.integers(0, 2, 4000)) % 3
    names = list("abcde")
    data = [(f"m{k:04}", datetime(2015, 1, 1) + timedelta(hours=k), int(t), *map(float, r)) for k, (r, t) in enumerate(zip(x, y, strict=True))]
    df = spark.createDataFrame(data, "match_key string, kickoff_utc timestamp, target long, " + ", ".join(f"{c} double" for c in names)).repartition(3)
    want = models.Boosting(6, 0.2, 9, 20).fit(x, y)
    got, line = models.fit_all(df, names, [models.Boosting(6, 0.2, 9, 20), models.Logistic(0.1, True)])
    assert [e.tolist() for e in got.edges] == [e.tolist() for e in want.edges]
    assert got.trees == want.trees and got.start.tolist() == want.start.tolist()
    assert np.allclose(line.predict(x), models.Logistic(0.1, True).fit(x, y).predict(x), atol=1e-8)
    # tasks without rows
    few = models.fit_all(df.limit(30).coalesce(1), names, [models.Boosting(2, 0.2, 3, 2)])[0]
    assert len(few.trees) == 2


def test_f4_importance_of_a_fit_on_all_training_rows(rows, monkeypatch):
    df, whole = rows
    monkeypatch.setattr(models, "MOST_ROWS", 60)
    boosting = (5, 0.1, 4, 5, 1.0)
    model = models.Boosting(*boosting).fit(*xy(whole[whole.split == "train"]))
    x, y = xy(whole[whole.split == "validation"])
    cut = int(len(y) * 0.6)
    got = {r.feature: r.importance_mean for r in models.boosting_importance(df, ["x", "z"], boosting, 4).collect()}
    for j, name in enumerate("xz"):
        assert got[name] == pytest.approx(models.permutation_importance(model.predict, x[:cut], y[:cut], 4, 42 + j, [j])[0, 0])


def test_f2_folds_are_fitted_on_all_their_training_rows(rows, monkeypatch):
    df, whole = rows
    monkeypatch.setattr(models, "MOST_ROWS", 60)
    boosting = (3, 0.2, 3, 5, 1.0)
    scored = models.backtest(evaluation.folds_of(df.filter("target is not null")), ["x", "z"], boosting=boosting)
    assert dict(scored.dtypes)["target"] == "bigint" and dict(scored.dtypes)["fold_number"] == "bigint"
    got = {(r.fold_number, r.evaluation_season, r.match_key, r.model): (r.target, r.probability_draw) for r in scored.collect()}
    assert len(got) == 2 * (230 - 120)
    for n, season in ((1, "2017"), (2, "2018")):
        train = xy(whole[whole.season < season])
        for name, model in (("logistic_regression", models.Logistic(0.1)), ("hist_gradient_boosting", models.Boosting(*boosting))):
            model.fit(*train)
            for r in whole[(whole.season == season) & whole.target.notna()].itertuples():
                assert got[n, season, r.match_key, name] == (r.target, pytest.approx(model.predict(np.array([[r.x, r.z]]))[0, 1]))


def test_f2_rows_of_folds_are_made_once_for_all_fits_and_scores(counted):
    df, made, _ = counted
    folds = evaluation.folds_of(df.filter("target is not null"))
    made.value = 0
    models.backtest(folds, ["x", "z"], boosting=(2, 0.2, 3, 5, 1.0)).count()
    assert made.value <= 240 * 4  # what makes folds reads seasons as well


def test_f6_production_is_fitted_on_all_labelled_rows(rows, monkeypatch):
    df, whole = rows
    monkeypatch.setattr(models, "MOST_ROWS", 60)
    boosting = (5, 0.1, 4, 5, 1.0)
    model, details = models.fit_production(df, ["x", "z"], boosting=boosting)
    assert (details["labelled_rows"], details["hgb_fit_rows"], details["calibration_rows"]) == (230, 195, 35)
    x, y = xy(whole)
    early = models.Boosting(*boosting).fit(x[:195], y[:195])
    want = models.Blend(models.Logistic(0.1).fit(x, y), models.Calibrated(early, models.Sigmoid().fit(early.raw(x[195:]), y[195:])), 0.5)
    assert np.allclose(model.predict(x), want.predict(x))
