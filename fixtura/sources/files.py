"""Files at the edge: raw copies, CSV and Parquet scans, typed Parquet sinks, manifests and reports."""

from __future__ import annotations

import hashlib
import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fixtura.functions.match_columns import blank_to_null


class SourceError(ValueError):
    """A source is missing, empty or lacks columns."""


def sha256_of(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()


def canonical_json(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()


def save_raw(content: bytes, folder: str, name: str) -> Path:
    """Bytes as they came, kept untouched."""
    path = Path(folder, name)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)
    return path


def save_payload(payload: object, folder: str, dataset: str, at: datetime) -> Path:
    return save_raw(json.dumps(payload, indent=2, default=str).encode(), folder, f"{dataset}_{at.astimezone(UTC):%Y%m%dT%H%M%SZ}.json")


def read_csv(spark: SparkSession, path: str, required: tuple[str, ...] = ()) -> DataFrame:
    """All columns as text; "", NA and N/A are null; long rows are cut and short ones filled."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if missing := [c for c in required if c not in df.columns]:
        raise SourceError(f"missing columns: {', '.join(missing)}")
    return df.select(*[blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns])


def read_seasons(spark: SparkSession, root: str) -> DataFrame:
    """Parquet of all seasons with merged schemas. Files are listed recursively, so that the folder
    name season=1920 does not replace the season column."""
    if not any(Path(root).glob("season=*/*.parquet")):
        raise SourceError(f"no season under {root}")
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(root)


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.parquet(path) if Path(path).exists() else spark.createDataFrame([], schema)


def read_report(path: str) -> dict:
    """A JSON object, or an error."""
    value = json.loads(Path(path).read_text())
    if not isinstance(value, dict):
        raise SourceError(f"{path} holds no object")
    return value


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report(report: dict, path: str) -> Path:
    return save_raw(json.dumps(report, indent=2, default=str).encode(), str(Path(path).parent), Path(path).name)
