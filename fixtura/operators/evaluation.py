"""Scoring models against each other: baselines, folds, selection and comparison tables.

Predictions of all models, splits and folds stand in one long table with `model`, `split` or
`fold_number`; every metric record then comes from one grouped aggregation, however many there are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.operators import gold, probability
from fixtura.operators.joins import join_lookup
from fixtura.operators.probability import P

METRICS = ("accuracy", "balanced_accuracy", "macro_f1", "log_loss", "brier_score", "ranked_probability_score")


def best(records: DataFrame, *ties: str, by: tuple[str, ...] = ("log_loss", "brier_score")) -> DataFrame:
    """The record of least loss; equal ones by Brier score, then by the columns named."""
    return records.orderBy(*by, *ties).limit(1)


def _with(df: DataFrame, model: str, probabilities: list[Column]) -> DataFrame:
    return df.withColumns(dict(zip(P, probabilities, strict=True)) | {"model": F.lit(model)})


def baselines(dataset: DataFrame, splits: tuple[str, ...] = ("validation", "test"), draw: float = 0.25, smoothing: float = 1.0) -> DataFrame:
    """Three baselines on each split: majority and frequency of the training rows, and the rating's
    expectation. `dataset` has split, target and home_expected_score."""
    train = dataset.filter("split = 'train' and target is not null")
    scored = dataset.filter(F.col("split").isin(*splits) & F.col("target").isNotNull())
    counts = probability.class_counts(train)
    known = scored.crossJoin(F.broadcast(counts))  # one row of counts
    n = [F.col(f"n{k}") for k in range(3)]
    most = F.array_position(F.array(*n), F.greatest(*n)) - 1
    total = n[0] + n[1] + n[2] + 3 * smoothing
    sets = {
        "elo": probability.elo_outcome(F.col("home_expected_score"), draw),
        "frequency": [(c + smoothing) / total for c in n],
        "majority": [F.when(most == k, 1 - 2e-9).otherwise(1e-9) for k in range(3)],
    }
    return reduce(DataFrame.unionByName, [_with(known, model, p) for model, p in sets.items()]).drop("n0", "n1", "n2")


def folds_of(dataset: DataFrame, least_training: int = 2, most: int = 4) -> DataFrame:
    """Rows of every expanding fold with fold_number, evaluation_season and role; a row is in the
    training part of each fold after its season."""
    return join_lookup(dataset, gold.backtest_folds(dataset, least_training, most), ["season"], "inner")


def frequency_folds(dataset: DataFrame, smoothing: float = 1.0) -> DataFrame:
    """Evaluation rows of every fold with the class frequencies of the fold's training rows. Training
    rows are counted once per season and added up, not copied once per fold."""
    seasons = dataset.filter("target is not null").groupBy("season").agg(*[F.count_if(F.col("target") == k).cast("double").alias(f"n{k}") for k in range(3)])
    folds = gold.backtest_folds(dataset)
    counted = join_lookup(folds.filter("role = 'training'"), seasons, ["season"]).groupBy("fold_number").agg(*[F.coalesce(F.sum(f"n{k}"), F.lit(0.0)).alias(f"n{k}") for k in range(3)])
    evaluated = folds.filter("role = 'evaluation'").drop("role").join(counted, "fold_number")
    n = [F.col(f"n{k}") for k in range(3)]
    total = n[0] + n[1] + n[2] + 3 * smoothing
    rows = join_lookup(dataset.filter("target is not null"), evaluated, ["season"], "inner")
    return _with(rows, "frequency", [(c + smoothing) / total for c in n]).drop("n0", "n1", "n2")


def summarise_folds(records: DataFrame) -> DataFrame:
    """Per model the number of folds, and mean and sample deviation of each metric, by mean loss."""
    each = [f(c).alias(f"{c}_{name}") for c in METRICS for f, name in ((F.avg, "mean"), (F.stddev_samp, "std"))]
    return records.groupBy("model").agg(F.count("*").alias("fold_count"), *each).orderBy("log_loss_mean", "brier_score_mean", "model")


def comparison(*records: DataFrame) -> DataFrame:
    """Metric records of all models as one table, the best first; a metric that is missing is an error."""
    for r in records:
        gold.require_columns(r, ["model", *METRICS], "comparison")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), records)
    whole = F.when(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in METRICS]), F.raise_error(F.concat(F.lit("a metric is missing of "), F.col("model")))).otherwise(True).cast("boolean")
    return rows.filter(whole).orderBy("log_loss", "brier_score", "model")


def metric_record(report: dict, model: str, split: str = "test", at: tuple[str, ...] = ("test_metrics",)) -> dict:
    """One model's numeric metrics out of a report, or an error naming what is missing."""
    found: object = report
    for name in at:
        found = found.get(name) if isinstance(found, dict) else None
    if not isinstance(found, dict):
        raise TypeError(f"{model}: the report has no {'.'.join(at)}")
    wrong = [m for m in METRICS if not isinstance(found.get(m), int | float)]
    if wrong:
        raise TypeError(f"{model}: no number for {', '.join(wrong)}")
    return {"model": model, "split": split} | {m: float(found[m]) for m in METRICS}


def evaluation_frame(metadata: DataFrame, scored: DataFrame, key: str = "match_key") -> DataFrame:
    """Metadata of rows with the probabilities and class predicted for them, by key (never by position)."""
    from fixtura.operators.joins import checked_join

    return probability.prediction_frame(checked_join(metadata, scored.select(key, *P), key, "inner", "1:1", "predictions of a row"))


def labelled(predictions: DataFrame) -> DataFrame:
    """(target, probabilities) of the rows whose target is known; none or a bad one fails the job."""
    rows = predictions.filter("target is not null").select(F.col("target").cast("long").alias("target"), *P)
    bad = ~F.col("target").isin(0, 1, 2) | reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | ~F.col(c).between(0, 1) for c in P])
    return rows.filter(F.when(bad, F.raise_error(F.lit("a target or probability is out of range"))).otherwise(True).cast("boolean"))
