"""Three-class probabilities: baselines, proper scores, calibration and blending, all in SQL expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fixtura.functions.match_columns import arg_max, clip
from fixtura.operators.joins import checked_join

P = ("probability_away_win", "probability_draw", "probability_home_win")
EPSILON = 2.220446049250313e-16


def with_constant(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """The same three probabilities on every row; `one_row` has exactly one row."""
    return df.crossJoin(F.broadcast(one_row.limit(1)))


def class_counts(train: DataFrame) -> DataFrame:
    return train.agg(*[F.count_if(F.col("target") == k).cast("double").alias(f"n{k}") for k in range(3)])


def majority(train: DataFrame) -> DataFrame:
    best = arg_max(F.col("n0"), F.col("n1"), F.col("n2"))
    return class_counts(train).select(*[F.when(best == k, 1 - 2e-9).otherwise(1e-9).alias(P[k]) for k in range(3)])


def frequency(train: DataFrame, smoothing: float = 1.0) -> DataFrame:
    total = F.col("n0") + F.col("n1") + F.col("n2") + 3 * smoothing
    return class_counts(train).select(*[((F.col(f"n{k}") + smoothing) / total).alias(P[k]) for k in range(3)])


def elo_outcome(expected: Column, draw: float = 0.25) -> list[Column]:
    """Away, draw and home probability of an expected home score, clipped and made to sum to one."""
    raw = [clip((1 - expected) * (1 - draw), 1e-9, 1.0), clip(F.lit(draw), 1e-9, 1.0), clip(expected * (1 - draw), 1e-9, 1.0)]
    total = raw[0] + raw[1] + raw[2]
    return [r / total for r in raw]


def blend(first: list[Column], second: list[Column], weight: Column) -> list[Column]:
    mixed = [weight * a + (1 - weight) * b for a, b in zip(first, second, strict=True)]
    total = mixed[0] + mixed[1] + mixed[2]
    return [m / total for m in mixed]


def metrics(scored: DataFrame, by: list[str]) -> DataFrame:
    """Accuracy, balanced accuracy, macro F1, log loss, Brier and ranked probability score per group."""
    y = [(F.col("target") == k).cast("double") for k in range(3)]
    p = [F.col(c) for c in P]
    guess = arg_max(*p)
    of_true = F.when(F.col("target") == 0, p[0]).when(F.col("target") == 1, p[1]).otherwise(p[2])
    cells = [F.count_if((F.col("target") == t) & (F.col("_g") == g)).alias(f"c{t}{g}") for t in range(3) for g in range(3)]
    grouped = scored.filter("target is not null").withColumn("_g", guess).groupBy(*by).agg(
        *cells,
        F.avg(-F.ln(clip(of_true, EPSILON, 1.0))).alias("log_loss"),
        F.avg(sum(((p[k] - y[k]) ** 2 for k in range(3)), F.lit(0.0))).alias("brier_score"),
        F.avg((F.pow(p[0] - y[0], F.lit(2)) + F.pow(p[0] + p[1] - y[0] - y[1], F.lit(2))) / 2).alias("ranked_probability_score"),
        F.count("*").alias("row_count"),
    )
    return _scores(grouped, by)


def _scores(grouped: DataFrame, by: list[str]) -> DataFrame:
    """Scores of counted cells c<true><guessed>; a class that never occurs has no recall."""
    n = {(t, g): F.col(f"c{t}{g}") for t in range(3) for g in range(3)}
    true = [n[k, 0] + n[k, 1] + n[k, 2] for k in range(3)]
    said = [n[0, k] + n[1, k] + n[2, k] for k in range(3)]
    recall = F.array(*[F.when(true[k] > 0, n[k, k] / F.nullif(true[k], F.lit(0))) for k in range(3)])
    f1 = F.array(*[F.when(true[k] + said[k] > 0, 2 * n[k, k] / F.nullif(true[k] + said[k], F.lit(0))) for k in range(3)])
    mean = lambda a: F.aggregate(F.filter(a, lambda x: x.isNotNull()), F.lit(0.0), lambda s, x: s + x) / F.size(F.filter(a, lambda x: x.isNotNull()))
    return grouped.select(*by, "row_count", ((n[0, 0] + n[1, 1] + n[2, 2]) / F.col("row_count")).alias("accuracy"), mean(recall).alias("balanced_accuracy"), mean(f1).alias("macro_f1"), "log_loss", "brier_score", "ranked_probability_score")


def bin_edges(bins: int) -> list[float]:
    if bins < 2:
        raise ValueError("at least two bins")
    return [i * (1.0 / bins) for i in range(bins)] + [1.0]


def bin_of(p: Column, bins: int = 10) -> Column:
    """Number of edges at or below p, less one; the last edge belongs to the last bin."""
    edges = F.array(*[F.lit(e) for e in bin_edges(bins)])
    return F.least(F.size(F.filter(edges, lambda e: e <= p)) - 1, F.lit(bins - 1)).cast("long")


def one_vs_rest(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Long form (class_label, p, y) of the three classes."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("class_label"), F.col(P[k]).alias("p"), (F.col("target") == k).cast("double").alias("y")) for k, n in enumerate(("away_win", "draw", "home_win"))])).alias("c")
    return scored.filter("target is not null").select(*keep, each).select(*keep, "c.*")


def reliability(long: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """Count and means of every bin of every group; empty bins stay, with nulls."""
    found = long.withColumn("bin", bin_of(F.col("p"), bins)).groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_probability"), F.avg("y").alias("observed_frequency"))
    every = long.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    return every.join(found, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def calibration_summary(table: DataFrame, by: list[str]) -> DataFrame:
    """Expected and greatest calibration error, means, bias and populated bins of each group's bins."""
    gap = F.abs(F.col("mean_probability") - F.col("observed_frequency"))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    return table.groupBy(*by).agg(
        (F.sum(gap * F.col("n")) / F.sum("n")).alias("expected_calibration_error"), F.max(gap).alias("maximum_calibration_error"),
        mean("mean_probability").alias("mean_probability"), mean("observed_frequency").alias("observed_frequency"), (mean("mean_probability") - mean("observed_frequency")).alias("bias"), F.count_if(F.col("n") > 0).alias("populated_bins"),
    )


def confidence_summary(scored: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """How sure the guesses are against how often they are right: calibration of the greatest probability."""
    table = reliability(confidence(scored, by), by, bins)
    return calibration_summary(table, by).withColumnsRenamed({"mean_probability": "mean_confidence", "observed_frequency": "accuracy", "bias": "over_confidence"})


def calibration_of_models(scored: DataFrame, bins: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(summaries, bins, per model) over the column `model`: three classes one against the rest, and
    confidence; per model mean and greatest errors over its classes joined with its confidence (1:1)."""
    classes = reliability(one_vs_rest(scored, ["model"]), ["model", "class_label"], bins)
    sure = reliability(confidence(scored, ["model"]).withColumn("class_label", F.lit("confidence")), ["model", "class_label"], bins)
    summaries = calibration_summary(classes, ["model", "class_label"])
    per_class = summaries.groupBy("model").agg(
        F.avg("expected_calibration_error").alias("mean_class_ece"), F.max("maximum_calibration_error").alias("maximum_class_mce"), F.avg(F.abs("bias")).alias("mean_absolute_bias")
    )
    confident = confidence_summary(scored, ["model"], bins).select("model", "mean_confidence", "accuracy", "over_confidence", F.col("expected_calibration_error").alias("confidence_ece"), F.col("maximum_calibration_error").alias("confidence_mce"))
    return summaries, classes.unionByName(sure), checked_join(per_class, confident, "model", "inner", "1:1", "one calibration per model")


def probability_violations(scored: DataFrame, columns: tuple[str, ...] = P, tolerance: float = 1e-8) -> DataFrame:
    """Rows whose probabilities are missing or not finite, outside the unit interval, or off a sum of one."""
    each = [F.col(c).cast("double") for c in columns]
    any_of = lambda f: reduce(lambda a, b: a | b, [f(p) for p in each])
    broken = lambda p: p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    return scored.agg(
        F.count("*").alias("row_count"), F.count_if(any_of(broken)).alias("not_finite"), F.count_if(any_of(lambda p: ~broken(p) & ~p.between(0, 1))).alias("outside_unit"),
        F.count_if(~any_of(broken) & (F.abs(sum(each[1:], each[0]) - 1) > tolerance)).alias("not_one"),
    )


def prediction_violations(predictions: DataFrame, key: str = "match_key") -> DataFrame:
    """The same, and keys that come twice, and targets that are no class, of a table of predictions."""
    target = F.col("target") if "target" in predictions.columns else F.lit(None).cast("long")
    return probability_violations(predictions).crossJoin(F.broadcast(predictions.agg((F.count("*") - F.countDistinct(key)).alias("duplicate_keys"), F.count_if(~target.isin(0, 1, 2)).alias("bad_target"))))


def check_weight(weight: float) -> float:
    if not (isinstance(weight, int | float) and 0 <= weight <= 1):
        raise ValueError("a weight must lie in [0, 1]")
    return float(weight)


def check_weights(first: float, second: float, tolerance: float = 1e-10) -> tuple[float, float]:
    if abs(check_weight(first) + check_weight(second) - 1) > tolerance:
        raise ValueError("weights must sum to one")
    return float(first), float(second)


def parse_numbers(text: str, check: Callable[[float], float] = check_weight) -> tuple[float, ...]:
    """Distinct checked numbers of a comma-separated list, in order."""
    found = sorted({check(float(part)) for part in text.split(",") if part.strip()})
    if not found:
        raise ValueError("at least one number is needed")
    return tuple(found)


def parse_strengths(text: str) -> tuple[float, ...]:
    """As `parse_numbers`, of finite positive regularisation strengths."""

    def positive(c: float) -> float:
        if not (0 < c < float("inf")):
            raise ValueError("a strength must be positive")
        return c

    return parse_numbers(text, positive)


def prediction_frame(scored: DataFrame) -> DataFrame:
    """Rows with their probabilities, the class of the greatest (the first of equals) and how great it is."""
    p = [F.col(c) for c in P]
    best = arg_max(*p)
    outcome = F.when(best == 0, "away_win").when(best == 1, "draw").otherwise("home_win")
    return scored.withColumns({"predicted_class": best, "predicted_outcome": outcome, "prediction_confidence": F.greatest(*p)})


def align(first: DataFrame, second: DataFrame, key: str = "match_key") -> DataFrame:
    """Predictions of two models for the same rows, by key (1:1), as first_* and second_*.

    Keys of only one side, keys that come twice and targets that differ fail the job: a full outer join
    carries the checks, so that they cost no pass of their own.
    """
    named = lambda df, side: df.select(key, F.col("target").alias(f"_{side}_target"), *[F.col(c).alias(f"{side}_{c}") for c in P], F.lit(True).alias(f"_{side}"))
    both = checked_join(named(first, "first"), named(second, "second"), key, "full", "1:1", "predictions of a row")
    problem = F.when(F.col("_first").isNull() | F.col("_second").isNull(), F.concat(F.lit("only one model predicts "), F.col(key).cast("string"))).when(~F.col("_first_target").eqNullSafe(F.col("_second_target")), F.concat(F.lit("targets differ for "), F.col(key).cast("string")))
    sound = F.when(problem.isNotNull(), F.raise_error(problem)).otherwise(True).cast("boolean")
    return both.filter(sound).select(key, F.col("_first_target").alias("target"), *[f"{s}_{c}" for s in ("first", "second") for c in P])


def blended(aligned: DataFrame, weight: float, first_model: str = "first", second_model: str = "second") -> DataFrame:
    """The ensemble of two aligned models with its weights and the class it predicts."""
    mixed = blend([F.col(f"first_{c}") for c in P], [F.col(f"second_{c}") for c in P], F.lit(check_weight(weight)))
    named = aligned.withColumns(dict(zip(P, mixed, strict=True)) | {"first_model": F.lit(first_model), "second_model": F.lit(second_model), "first_model_weight": F.lit(float(weight)), "second_model_weight": F.lit(1 - float(weight))})
    return prediction_frame(named).drop(*[f"{s}_{c}" for s in ("first", "second") for c in P])


def weight_metrics(aligned: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Metrics of every weight in one pass: each row is blended with all weights inside the scan's
    pipeline and summed up on the map side, so that a few sums per weight are all that is shuffled."""
    listed = F.array(*[F.lit(float(check_weight(w))) for w in weights])
    each = aligned.filter("target is not null").withColumn("first_weight", F.explode(listed))
    mixed = blend([F.col(f"first_{c}") for c in P], [F.col(f"second_{c}") for c in P], F.col("first_weight"))
    return metrics(each.select("first_weight", "target", *[m.alias(c) for m, c in zip(mixed, P, strict=True)]), ["first_weight"])


def confidence(scored: DataFrame, keep: list[str]) -> DataFrame:
    p = [F.col(c) for c in P]
    return scored.filter("target is not null").select(*keep, F.greatest(*p).alias("p"), (arg_max(*p) == F.col("target")).cast("double").alias("y"))
