"""Saving and restoring named tables (window contents) as JSON."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class SnapshotStore:
    """Snapshots below one shared folder; the one saved last is in force.

    Every save writes a folder of its own and becomes current by one appended log row
    after its data is complete, so a failed save leaves the previous snapshot in force.
    Saves are numbered in the log; ``version`` is the caller's label, which may start
    again (a new checkpoint) or repeat (a replayed micro-batch). One writer per name.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, name: str) -> str:
        return f"{self.folder}/{name}/log"

    def _last(self, name: str) -> Row | None:
        try:
            log = self.spark.read.schema("save bigint, version bigint, data string").json(self._log(name))
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        return log.orderBy(F.desc("save")).first()

    def save(self, name: str, df: DataFrame, version: int) -> str:
        last = self._last(name)
        number = last["save"] + 1 if last else 1
        data = f"save={number}-{uuid.uuid4().hex}"
        path = f"{self.folder}/{name}/{data}"
        df.write.option("ignoreNullFields", "false").json(path)
        entry = self.spark.range(1).select(F.lit(number).alias("save"), F.lit(version).alias("version"), F.lit(data).alias("data"))
        entry.coalesce(1).write.mode("append").json(self._log(name))
        return path

    def restore(self, name: str, schema: T.StructType | str) -> DataFrame:
        """The current snapshot with declared types; NULLs stay NULL."""
        last = self._last(name)
        if last is None:
            raise FileNotFoundError(f"no snapshot of {name!r} in {self.folder}")
        return self.spark.read.schema(schema).json(f"{self.folder}/{name}/{last['data']}")

    def each_batch(self, name: str, query):
        """For ``foreachBatch``: save ``query(batch)`` under the batch number."""
        return lambda batch, number: self.save(name, query(batch), number)
