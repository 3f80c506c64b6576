"""Intermediate tables in the shared folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from lumberline.session import fresh_path


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, if the path is there too."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(":")
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *filter(None, paths)])


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to the shared folder and go on from the files.

    The plan is run once, and a lost executor costs a read, not a second run.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column is called so (Spark does not tell case apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
