"""The builds of each layer and the named pipelines put together from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.functions import match_columns as C
from fixtura.operators import bundle, elo, evaluation, form, gold, models, probability, silver
from fixtura.plans.catalogue import FEATURES
from fixtura.plans.pipeline import Run, Stage, run_stages, write_run
from fixtura.session import cut_lineage
from fixtura.settings import Settings
from fixtura.sources import layers
from fixtura.sources.client import MatchApi
from fixtura.sources.files import SourceError, read_report, write_report


def silver_matches(historical: DataFrame, current: DataFrame | None, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(matches, teams): both sources under canonical names, one record per match, with outcomes."""
    parts = [silver.prepare_historical(historical)] + ([silver.prepare_current(current)] if current is not None else [])
    named = silver.canonicalise_teams(silver.union_relaxed(*parts), aliases, strict=True)
    matches = silver.add_outcomes(silver.deduplicate(silver.add_match_keys(named)))
    gold.require_clean(gold.silver_violations(matches), "silver")
    return silver.chronological(matches), silver.team_dimension(matches).orderBy("team_id")


def form_tables(matches: DataFrame, window_size: int = 5) -> tuple[DataFrame, DataFrame]:
    """(team form, match form), both checked."""
    history = form.team_history(matches)
    gold.require_clean(gold.history_violations(history), "team history")
    team = form.rolling_form(form.rest_days(history), window_size)
    match = form.match_form(matches, team)
    gold.require_clean(gold.form_violations(match, window_size), "match form")
    return team, silver.chronological(match)


def elo_tables(matches: DataFrame, parameters: elo.EloParameters | None = None) -> tuple[DataFrame, DataFrame]:
    """(rating history, matches with ratings), both checked. The fold is written once and read twice."""
    history = cut_lineage(elo.elo_history(matches, parameters))
    gold.require_clean(elo.elo_invariants(history), "ratings")
    return history, silver.chronological(elo.match_elo(matches, history))


def model_dataset(match_form: DataFrame, match_elo: DataFrame, validation: str, test: str) -> DataFrame:
    """Form and ratings of each match (1:1, none lost) with target, flags and split, checked."""
    from fixtura.operators.joins import checked_join

    rated = match_elo.select("match_key", "home_elo_pre", "away_elo_pre", "elo_difference", "home_expected_score", "away_expected_score")
    both = checked_join(match_form, rated, "match_key", "left", "1:1", "ratings of a match")
    whole = F.when(F.col("home_elo_pre").isNull(), F.raise_error(F.lit("a match with form has no rating"))).otherwise(True).cast("boolean")
    dataset = gold.assign_splits(gold.cold_start_flags(both.filter(whole).withColumn("target", C.target_of(F.col("full_time_result")))), validation, test)
    gold.require_clean(gold.model_violations(gold.require_columns(dataset, FEATURES, "model dataset")), "model dataset")
    return silver.chronological(dataset)


class Builds:
    """Every stage of the pipelines as a method, over the folders that the settings name."""

    def __init__(self, spark: SparkSession, settings: Settings, aliases: str = "", seasons: tuple[int, int] = (2019, 2025), opener: Callable | None = None, features: tuple[str, ...] = FEATURES, boosting: tuple = models.BOOSTING, c_values: tuple[float, ...] = models.C_VALUES) -> None:
        self.spark, self.at, self.aliases, self.seasons, self.opener = spark, settings, aliases, seasons, opener
        self.features, self.boosting, self.c_values = list(features), boosting, c_values
        self.reports, self.predictions, self.production = (f"{settings.artifacts}/{n}" for n in ("reports", "predictions", "models/production"))

    def _read(self, path: str, name: str, **more: object) -> DataFrame:
        return layers.read_table(self.spark, path, name, **more)

    def _dataset(self) -> DataFrame:
        """The model dataset, its features as a model sees them."""
        df = self._read(f"{self.at.gold}/model_dataset.parquet", "model dataset", required=["match_key", "season", "kickoff_utc", "target", "split", *self.features], filled=True)
        return bundle.feature_frame(df, self.features)

    # data

    def historical(self) -> object:
        return layers.ingest_seasons(self.spark, *self.seasons, self.at.bronze, self.opener)

    def current(self) -> object:
        api = MatchApi(self.at.api_base, self.at.api_token, **({"opener": self.opener} if self.opener else {}))
        return layers.ingest_current(self.spark, api, self.at.competition_code, self.at.bronze)

    def matches(self) -> object:
        if not layers.bronze_files(self.at.bronze):
            raise SourceError("no historical matches: ingest them first")
        historical = self.spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(f"{self.at.bronze}/historical_matches")
        path = f"{self.at.bronze}/current/matches.parquet"
        current = self._read(path, "current matches") if Path(path).exists() else None
        return layers.write_silver(*silver_matches(historical, current, layers.read_aliases(self.spark, self.aliases)), self.at.silver)

    def form(self) -> object:
        return layers.write_form(*form_tables(self._read(f"{self.at.silver}/matches.parquet", "silver matches")), self.at.gold)

    def ratings(self) -> object:
        parameters = elo.EloParameters()
        return layers.write_elo(*elo_tables(self._read(f"{self.at.silver}/matches.parquet", "silver matches"), parameters), self.at.gold, asdict(parameters))

    def dataset(self) -> object:
        match_form, match_elo = self._read(f"{self.at.gold}/match_form.parquet", "match form"), self._read(f"{self.at.gold}/match_elo.parquet", "match ratings")
        return layers.write_model_dataset(model_dataset(match_form, match_elo, self.at.validation_season, self.at.test_season), self.at.gold, self.at.validation_season, self.at.test_season)

    # models

    def _scores(self, scored: DataFrame) -> tuple[DataFrame, dict]:
        """Metric records of scored rows, and the report of each (model, split)."""
        records = probability.metrics(scored, ["model", "split"])
        rows = {(r["model"], r["split"]): {m: r[m] for m in evaluation.METRICS} for r in records.collect()}
        for model, split in rows:
            layers.write_predictions(probability.prediction_frame(scored.filter((F.col("model") == model) & (F.col("split") == split))), self.predictions, model, split)
        return records, rows

    def baselines(self) -> object:
        scored = evaluation.baselines(self._dataset()).select("match_key", "kickoff_utc", "split", "target", "model", *evaluation.P)
        records, _ = self._scores(scored)
        layers.write_records(records.filter("split = 'validation'").orderBy("log_loss", "brier_score", "model"), self.reports, "baseline_ranking")
        return layers.write_records(records.orderBy("split", "log_loss", "model"), self.reports, "baseline_comparison")

    def logistic(self) -> object:
        df = self._dataset()
        grid = models.logistic_grid(df, self.features, self.c_values)
        chosen = evaluation.best(grid, "c").first()
        model = models.fit_all(df.filter("split = 'train'"), self.features, [models.Logistic(chosen["c"], chosen["class_weight"] == "balanced")])[0]
        scored = models.score_with(df.filter("split in ('validation', 'test') and target is not null"), self.features, {"logistic_regression": model}, ["match_key", "kickoff_utc", "split", "target"])
        _, rows = self._scores(scored)
        layers.write_records(grid.orderBy("log_loss", "brier_score", "c"), self.reports, "logistic_selection")
        layers.write_records(models.logistic_coefficients(df.filter("split = 'train'"), self.features, chosen["c"], chosen["class_weight"] == "balanced"), self.reports, "logistic_coefficients")
        report = {"selected_parameters": {"regularisation_strength": chosen["c"], "class_weight": chosen["class_weight"]}, "validation_metrics": rows["logistic_regression", "validation"], "test_metrics": rows["logistic_regression", "test"], "features": self.features}
        write_report(report, f"{self.reports}/logistic_regression.json")
        return report

    def gradient_boosting(self) -> object:
        """Selects on the tuning window, calibrates on the window after it, evaluates on the test season."""
        df = self._dataset()
        grid = models.boosting_grid(df, self.features, self.boosting)
        chosen = evaluation.best(grid, "leaves", "iterations").first()
        boosting = tuple(chosen[c] for c in ("iterations", "rate", "leaves", "least", "penalty"))
        windows = gold.chronological_partition(df.filter("split = 'validation' and target is not null"), 0.6)
        model = models.fit_all(df.filter("split = 'train'"), self.features, [models.Boosting(*boosting)])[0]
        calibrated = models.Calibrated(model, models.fit_all(windows.filter("part = 'calibration'"), self.features, [models.SigmoidOf(model)])[0])
        parts = windows.withColumn("split", F.col("part")).drop("part").unionByName(df.filter("split = 'test' and target is not null"))
        scored = models.score_with(parts, self.features, {"hist_gradient_boosting": model, bundle.BOOSTING: calibrated}, ["match_key", "kickoff_utc", "split", "target"])
        _, rows = self._scores(scored)
        first = self._read(layers.prediction_path(self.predictions, bundle.LOGISTIC, "validation"), "logistic predictions")
        layers.write_predictions(first.join(windows.filter("part = 'calibration'").select("match_key"), "match_key", "left_semi"), self.predictions, "logistic_regression", "calibration")
        layers.write_records(grid.orderBy("log_loss", "brier_score", "leaves", "iterations"), self.reports, "hgb_selection")
        layers.write_records(models.boosting_importance(df, self.features, boosting, repeats=20), self.reports, "hgb_importance")
        report = {
            "selected_parameters": dict(zip(bundle.CONFIGURATION, boosting, strict=True)), "tuning_metrics": rows["hist_gradient_boosting", "tuning"], "calibration_metrics": {"uncalibrated": rows["hist_gradient_boosting", "calibration"], "calibrated": rows[bundle.BOOSTING, "calibration"]},
            "test_metrics": {"uncalibrated": rows["hist_gradient_boosting", "test"], "calibrated": rows[bundle.BOOSTING, "test"]},
        }
        write_report(report, f"{self.reports}/hgb_evaluation.json")
        return report

    def ensemble(self, weights: tuple[float, ...] = tuple(round(k * 0.05, 2) for k in range(21))) -> object:
        """The weight of least loss on the calibration window, applied to the test season."""
        read = lambda model, split: self._read(layers.prediction_path(self.predictions, model, split), f"{model} {split}", filled=True)
        tuned, tested = (probability.align(read(bundle.LOGISTIC, s), read(bundle.BOOSTING, s)) for s in ("calibration", "test"))
        selection = probability.weight_metrics(tuned, weights)
        weight = evaluation.best(selection, "first_weight").first()["first_weight"]
        scored = [probability.blended(rows, weight, bundle.LOGISTIC, bundle.BOOSTING).withColumns({"split": F.lit(split), "model": F.lit("probability_ensemble")}) for rows, split in ((tuned, "validation"), (tested, "test"))]
        _, rows = self._scores(silver.union_relaxed(*scored))
        layers.write_records(selection.orderBy("log_loss", "brier_score", "first_weight"), self.reports, "ensemble_selection")
        report = {"selected_weights": {bundle.LOGISTIC: weight, bundle.BOOSTING: 1 - weight}, "validation_metrics": rows["probability_ensemble", "validation"], "test_metrics": rows["probability_ensemble", "test"]}
        write_report(report, f"{self.reports}/ensemble_evaluation.json")
        return report

    def compare(self) -> object:
        """Both comparison tables on the test season: baselines and learned models, then the ensemble too."""
        baselines = self._read(f"{self.reports}/baseline_comparison.parquet", "baseline comparison").filter("split = 'test'")
        logistic, boosting, ensemble = (read_report(f"{self.reports}/{n}.json") for n in ("logistic_regression", "hgb_evaluation", "ensemble_evaluation"))
        learned = [evaluation.metric_record(logistic, bundle.LOGISTIC), evaluation.metric_record(boosting, "hist_gradient_boosting", at=("test_metrics", "uncalibrated")), evaluation.metric_record(boosting, bundle.BOOSTING, at=("test_metrics", "calibrated"))]
        third = evaluation.comparison(baselines, self.spark.createDataFrame(learned))
        layers.write_records(third, self.reports, "day_3_model_comparison")
        fourth = evaluation.comparison(third, self.spark.createDataFrame([evaluation.metric_record(ensemble, "probability_ensemble")]))
        return layers.write_records(fourth, self.reports, "day_4_model_comparison")

    def backtests(self) -> object:
        rows = self._dataset().filter("target is not null")
        learned = models.backtest(evaluation.folds_of(rows), self.features, boosting=self.boosting[0])
        scored = learned.unionByName(evaluation.frequency_folds(rows).select(*learned.columns))
        layers.write_predictions(scored, self.predictions, "backtest", "folds")
        records = probability.metrics(scored, ["fold_number", "evaluation_season", "model"])
        layers.write_records(records.orderBy("fold_number", "model"), self.reports, "backtest_folds")
        return layers.write_records(evaluation.summarise_folds(records), self.reports, "backtest_summary")

    def calibration(self, bins: int = 10) -> object:
        summaries, tables, per_model = probability.calibration_of_models(layers.read_predictions(self.spark, self.predictions), bins)
        layers.write_records(summaries.orderBy("model", "class_label"), self.reports, "calibration_summary")
        layers.write_records(tables.orderBy("model", "class_label", "bin"), self.reports, "calibration_bins")
        return layers.write_records(per_model.orderBy("mean_class_ece", "model"), self.reports, "calibration_models")

    # production

    def fit(self) -> object:
        reports = {"ensemble": f"{self.reports}/ensemble_evaluation.json", "logistic": f"{self.reports}/logistic_regression.json", "boosting": f"{self.reports}/hgb_evaluation.json"}
        files = (f"{self.production}/bundle.pickle", f"{self.production}/manifest.json", f"{self.reports}/production_training.json")
        bundle.fit_and_save(self._dataset(), self.features, reports, *files)
        return bundle.check_artifacts(*files)

    def predict(self) -> object:
        """Predictions of all future fixtures; none to predict is no failure."""
        try:
            rows = bundle.future_rows(self._dataset())
        except bundle.BundleError as nothing:
            return str(nothing)
        kept = [c for c in ("match_key", "season", "kickoff_utc", "home_team", "away_team") if c in rows.columns]
        predictions = cut_lineage(bundle.predict(bundle.load_bundle(f"{self.production}/bundle.pickle"), rows, kept))
        bundle.check_output(predictions)
        audit = bundle.output_audit(predictions)
        layers.write_future(predictions.orderBy("kickoff_utc", "match_key"), self.predictions, audit)
        return audit


#: Stages of the named pipelines: (name, optional), each a method of `Builds`.
DATA = (("historical", False), ("current", True), ("matches", False), ("form", False), ("ratings", False), ("dataset", False))
MODELS = (("baselines", False), ("logistic", False), ("gradient_boosting", False), ("ensemble", False), ("compare", False))
PRODUCTION = (("fit", False), ("predict", True))
PIPELINES = {"data": DATA, "models": MODELS, "production": PRODUCTION, "full": (*DATA, *MODELS, *PRODUCTION)}


def stages_of(builds: Builds, pipeline: str) -> list[Stage]:
    if pipeline not in PIPELINES:
        raise ValueError(f"unknown pipeline {pipeline}: one of {', '.join(sorted(PIPELINES))}")
    return [Stage(name, getattr(builds, name), optional) for name, optional in PIPELINES[pipeline]]


def run_named(builds: Builds, pipeline: str, continue_after_optional: bool = True) -> Run:
    """Runs a named pipeline and records it, also when it fails; a failure of a required stage raises."""
    run = run_stages(pipeline, stages_of(builds, pipeline), continue_after_optional)
    write_run(run, f"{builds.at.artifacts}/runs")
    return run.or_raise()

