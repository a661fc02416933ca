"""Session helpers: one place for the settings the engine relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def create_session(name: str = "fixtura", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the engine's settings; `settings` (dots written as `__`) override them."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS | {k.replace("__", "."): v for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpoint into the shared folder that the cluster names in spark.checkpoint.dir.

    Only a session of one machine (tests) that names none gets a temporary folder; a cluster must name one.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not context.master.startswith("local"):
                raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
            import tempfile

            named = tempfile.mkdtemp(prefix="fixtura-checkpoint-")
        context.setCheckpointDir(named)
    return df.checkpoint()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of a session (once per session)."""
    import io
    import os
    import tempfile
    import zipfile

    context = spark.sparkContext
    if getattr(context, "_fixtura_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as archive:
        for folder, _, files in os.walk(root):
            for name in files:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    path = os.path.join(tempfile.mkdtemp(prefix="fixtura-package-"), "fixtura.zip")
    with open(path, "wb") as out:  # on the driver, from where executors fetch it as long as the session lasts
        out.write(data.getvalue())
    context.addPyFile(path)
    context._fixtura_shipped = True
