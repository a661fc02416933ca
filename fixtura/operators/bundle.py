"""The production bundle: a fitted model with its feature contract, kept on disk and checked on use."""

from __future__ import annotations

import hashlib
import json
import pickle
import subprocess
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fixtura.operators import gold, models, probability
from fixtura.sources.files import read_report, write_report

#: What a bundle declares.
SCHEMA_VERSION = "1.0.0"
CLASS_LABELS, CLASS_NAMES = (0, 1, 2), ("away_win", "draw", "home_win")
LOGISTIC, BOOSTING = "logistic_regression", "hist_gradient_boosting_calibrated"
CONFIGURATION = ("max_iter", "learning_rate", "max_leaf_nodes", "min_samples_leaf", "l2_regularization")


class BundleError(ValueError):
    """A bundle, or what is asked of it, breaks the contract."""


@dataclass(frozen=True)
class Bundle:
    model: models.Blend
    feature_names: tuple[str, ...]
    weights: tuple[float, float]
    metadata: dict = field(default_factory=dict)
    created_at: str = ""
    schema_version: str = SCHEMA_VERSION
    class_labels: tuple[int, ...] = CLASS_LABELS
    class_names: tuple[str, ...] = CLASS_NAMES


def contract_hash(features: tuple[str, ...] | list[str]) -> str:
    """SHA-256 of the feature names in their order."""
    return hashlib.sha256("\n".join(features).encode()).hexdigest()


def make_bundle(model: models.Blend, features: list[str], weights: tuple[float, float], metadata: dict) -> Bundle:
    if not features or len(set(features)) != len(features):
        raise BundleError("features must be named, each once")
    return Bundle(model, tuple(features), probability.check_weights(*weights), metadata, datetime.now(UTC).isoformat())


def save_bundle(bundle: Bundle, path: str) -> Path:
    out = Path(path)
    out.parent.mkdir(parents=True, exist_ok=True)
    out.write_bytes(pickle.dumps(bundle))
    return out


def load_bundle(path: str) -> Bundle:
    """A bundle from a file that this engine wrote; type, schema version, features and weights are checked."""
    if not Path(path).is_file():
        raise BundleError(f"no bundle at {path}")
    bundle = pickle.loads(Path(path).read_bytes())  # noqa: S301
    if not isinstance(bundle, Bundle):
        raise BundleError(f"{path} holds no bundle")
    if bundle.schema_version != SCHEMA_VERSION:
        raise BundleError(f"schema {bundle.schema_version} instead of {SCHEMA_VERSION}")
    probability.check_weights(*bundle.weights)
    return bundle


def feature_frame(df: DataFrame, features: tuple[str, ...] | list[str]) -> DataFrame:
    """The rows, if they have every feature of the contract as a number; a value that is not finite
    once null and NaN are taken as 0 fails the job."""
    gold.require_columns(df, list(features), "features")
    text = [c for c, t in df.dtypes if c in features and t.split("(")[0] not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal", "boolean")]
    if text:
        raise BundleError(f"features are no numbers: {', '.join(text)}")
    ready = df.withColumns({c: gold.feature(c) for c in features})
    infinite = reduce(lambda a, b: a | b, [F.abs(F.col(c)) == float("inf") for c in features])
    return ready.filter(F.when(infinite, F.raise_error(F.lit("a feature is not finite"))).otherwise(True).cast("boolean"))


def future_rows(df: DataFrame) -> DataFrame:
    """The fixtures to predict, in order of time: target unknown, keys once; none is an error."""
    rows = df.filter("target is null")
    found = rows.agg(F.count("*"), F.countDistinct("match_key")).first()
    if not found[0]:
        raise BundleError("no future fixtures")
    if found[0] != found[1]:
        raise BundleError("a future fixture comes twice")
    return rows.orderBy("kickoff_utc", "match_key")


def predict(bundle: Bundle, df: DataFrame, kept: list[str]) -> DataFrame:
    """Rows with the bundle's probabilities, class and confidence."""
    ready = feature_frame(df, bundle.feature_names)
    return probability.prediction_frame(models.score_with(ready, list(bundle.feature_names), {"production": bundle.model}, kept).drop("model"))


def check_output(predictions: DataFrame) -> None:
    """Predictions are there, sum to one and have no null."""
    gold.require_clean(probability.probability_violations(predictions), "predictions")
    nulls = {c: n for c, n in gold.null_counts(predictions).first().asDict().items() if n}
    if nulls:
        raise gold.DataQualityError(f"predictions: nulls in {', '.join(sorted(nulls))}")


def output_audit(predictions: DataFrame) -> dict:
    """Counts per outcome, and mean, least and greatest confidence, in one pass."""
    c = F.col("prediction_confidence")
    counts = [F.count_if(F.col("predicted_outcome") == n).alias(n) for n in CLASS_NAMES]
    row = predictions.agg(F.count("*").alias("n"), *counts, F.avg(c).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most")).first()
    return {"row_count": row["n"], "outcomes": {n: row[n] for n in CLASS_NAMES}, "confidence": {"mean": row["mean"], "min": row["least"], "max": row["most"]}}


def _selected(report: dict, name: str, what: str) -> dict:
    found = report.get(name)
    if not isinstance(found, dict):
        raise TypeError(f"the {what} report has no {name}")
    return found


def _number(found: dict, name: str, what: str) -> float:
    if isinstance(found.get(name), bool) or not isinstance(found.get(name), int | float):
        raise TypeError(f"{what}: {name} is no number")
    return float(found[name])


def selected_weights(report: dict) -> tuple[float, float]:
    chosen = _selected(report, "selected_weights", "ensemble")
    return _number(chosen, LOGISTIC, "ensemble"), _number(chosen, BOOSTING, "ensemble")


def logistic_configuration(report: dict) -> tuple[float, bool]:
    """(strength, balanced) that the logistic report selected."""
    chosen = _selected(report, "selected_parameters", "logistic")
    if chosen.get("class_weight") not in ("none", "balanced"):
        raise ValueError("logistic: unknown class weight")
    return _number(chosen, "regularisation_strength", "logistic"), chosen["class_weight"] == "balanced"


def boosting_configuration(report: dict) -> tuple[int, float, int, int, float]:
    """(iterations, rate, leaves, least rows, penalty) that the boosting report selected."""
    chosen = _selected(report, "selected_parameters", "boosting")
    if missing := [c for c in CONFIGURATION if c not in chosen]:
        raise ValueError(f"boosting: no {', '.join(missing)}")
    n = {c: _number(chosen, c, "boosting") for c in CONFIGURATION}
    return int(n["max_iter"]), n["learning_rate"], int(n["max_leaf_nodes"]), int(n["min_samples_leaf"]), n["l2_regularization"]


def git_commit() -> str | None:
    try:
        done = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, check=True)  # noqa: S603, S607
    except (OSError, subprocess.SubprocessError):
        return None
    return done.stdout.strip() or None


def fit_and_save(dataset: DataFrame, features: list[str], reports: dict[str, str], bundle_path: str, manifest_path: str, report_path: str, fraction: float = 0.15) -> Bundle:
    """Fits production on all labelled rows by the configurations that three reports (ensemble,
    logistic, boosting) selected; writes bundle, manifest and training report."""
    read = {name: read_report(path) for name, path in reports.items()}
    weights = selected_weights(read["ensemble"])
    c, balanced = logistic_configuration(read["logistic"])
    boosting = boosting_configuration(read["boosting"])
    model, fitted_on = models.fit_production(feature_frame(dataset, features), features, weights[0], c, balanced, boosting, fraction)
    details = fitted_on | {"logistic_configuration": {"regularisation_strength": c, "class_weight": "balanced" if balanced else "none"}, "hgb_configuration": dict(zip(CONFIGURATION, boosting, strict=True))}
    bundle = make_bundle(model, features, weights, details)
    save_bundle(bundle, bundle_path)
    manifest = {
        "schema_version": bundle.schema_version, "created_at": bundle.created_at, "bundle_path": bundle_path, "git_commit": git_commit(), "feature_count": len(features), "feature_names": list(features), "feature_contract_sha256": contract_hash(features),
        "class_labels": list(bundle.class_labels), "class_names": list(bundle.class_names), "ensemble_weights": {LOGISTIC: weights[0], BOOSTING: weights[1]}, "training_cutoff": fitted_on["training_cutoff"], "source_reports": reports,
    }
    write_report(manifest, manifest_path)
    write_report({"generated_at": datetime.now(UTC).isoformat(), "status": "success", **manifest, "training": details}, report_path)
    return bundle


def read_manifest(path: str) -> dict:
    """A JSON object; broken JSON and other values have errors of their own."""
    try:
        value = json.loads(Path(path).read_text(encoding="utf-8"))
    except json.JSONDecodeError as e:
        raise BundleError(f"{path} is no JSON: {e}") from e
    if not isinstance(value, dict):
        raise TypeError(f"{path} holds no object")
    return value


#: What a manifest must declare.
FIELDS = ("schema_version", "created_at", "bundle_path", "feature_count", "feature_names", "class_labels", "class_names", "ensemble_weights", "training_cutoff")


def _list_of(manifest: dict, name: str) -> list:
    if not isinstance(manifest[name], list):
        raise TypeError(f"{name} is no list")
    return manifest[name]


def check_fields(manifest: dict) -> None:
    if missing := sorted(set(FIELDS) - set(manifest)):
        raise BundleError(f"the manifest lacks {', '.join(missing)}")


def check_contract(manifest: dict) -> None:
    """Named features, each a text and there once, as many as declared, with the hash declared if any."""
    names = _list_of(manifest, "feature_names")
    if isinstance(manifest["feature_count"], bool) or not isinstance(manifest["feature_count"], int):
        raise TypeError("feature_count is no whole number")
    if not names or not all(isinstance(n, str) and n.strip() for n in names) or len(set(names)) != len(names):
        raise BundleError("features must be named, each once")
    if len(names) != manifest["feature_count"]:
        raise BundleError(f"{len(names)} features instead of {manifest['feature_count']}")
    if manifest.get("feature_contract_sha256") not in (None, contract_hash(names)):
        raise BundleError("the features are not those of the contract")


def check_classes(manifest: dict) -> None:
    for name in ("class_labels", "class_names"):
        found = _list_of(manifest, name)
        if len(found) != 3 or len(set(found)) != 3:
            raise BundleError(f"{name} must be three different classes")


def check_manifest_weights(manifest: dict) -> None:
    weights = manifest["ensemble_weights"]
    if not isinstance(weights, dict):
        raise TypeError("ensemble_weights is no object")
    if not weights or not all(isinstance(n, str) and n.strip() for n in weights):
        raise BundleError("weights must be named")
    if abs(sum(_number(weights, n, "ensemble_weights") for n in weights) - 1) > 1e-9 or not all(0 <= w <= 1 for w in weights.values()):
        raise BundleError("weights must lie in [0, 1] and sum to one")


def check_artifacts(bundle_path: str, manifest_path: str, report_path: str) -> dict:
    """All checks of what a production fit leaves behind, in order; the manifest if they pass."""
    if missing := [p for p in (bundle_path, manifest_path, report_path) if not Path(p).is_file()]:
        raise FileNotFoundError(f"missing: {', '.join(missing)}")
    manifest = read_manifest(manifest_path)
    for check in (check_fields, check_contract, check_classes, check_manifest_weights):
        check(manifest)
    if not isinstance(manifest["bundle_path"], str):
        raise TypeError("bundle_path is no text")
    if Path(manifest["bundle_path"]) != Path(bundle_path):
        raise BundleError("the manifest names another bundle")
    if not read_manifest(report_path):
        raise BundleError("the training report is empty")
    return manifest
