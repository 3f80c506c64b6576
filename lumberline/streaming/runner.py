"""Running parsed streams: event clock, late rows, reloaded lookups, sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumberline.functions.times import event_time
from lumberline.session import fresh_path

SNAPSHOT_SECONDS = 60  # Fixed value: default interval between snapshots.


def on_event_clock(df: DataFrame, lateness: str = "0 seconds", millis: str = "logts_timestamp") -> DataFrame:
    """Time advances with the events: ``event_time`` plus its watermark.

    Rows without a prefix time carry no event time and do not move the clock.
    """
    return df.withColumn("event_time", event_time(F.col(millis))).withWatermark("event_time", lateness)


def on_wall_clock(df: DataFrame) -> DataFrame:
    """Time is when a row is read."""
    return df.withColumn("event_time", F.current_timestamp())


def from_time(df: DataFrame, millis: int, column: str = "logts_timestamp") -> DataFrame:
    """Start the clock at ``millis``: earlier events are before the run."""
    return df.filter(F.col(column) >= F.lit(millis))


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything there is, exactly once, into Parquet below ``path``."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Run a stream over what is available and read its result back as a table."""
    base = fresh_path(spark, label)
    run_available(df, f"{base}/data", f"{base}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{base}/data")


def drain_batches(spark: SparkSession, df: DataFrame, label: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over what is available through ``foreachBatch``."""
    checkpoint = fresh_path(spark, label)
    query = (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", f"{checkpoint}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int) -> StreamingQuery:
    """Start a stream that calls ``handle`` every ``seconds`` (snapshots, reloads)."""
    return (
        df.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=f"{seconds} seconds")
        .start()
    )


def with_reload(
    read_table: Callable[[], DataFrame],
    enrich: Callable[[DataFrame, DataFrame], DataFrame],
    write: Callable[[DataFrame, int], None],
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler that reads the lookup side anew for every batch."""

    def handle(batch: DataFrame, number: int) -> None:
        write(enrich(batch, read_table()), number)

    return handle


def hand_on(df: DataFrame, folder: str, number: int) -> None:
    """Keep rows for the next batch. Two folders take turns, so a replayed batch meets what it met before."""
    df.write.mode("overwrite").parquet(f"{folder}/turn={number % 2}")


def handed_on(spark: SparkSession, folder: str, number: int, schema) -> DataFrame:
    """What batch ``number - 1`` kept; the first batch of a checkpoint finds nothing."""
    if number == 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/turn={(number - 1) % 2}")


class LateRows:
    """``foreachBatch`` handler that sets rows apart which come too late.

    The clock is the largest event time of all earlier batches, ``clock`` at first. It is
    handed on in ``folder``, which belongs to the stream's checkpoint, so a restarted
    stream and a replayed batch judge alike. Rows behind it by more than ``delay_ms`` go
    to ``late``, everything else to ``on_time``; nothing is dropped. Rows of one batch
    are not judged by each other.
    """

    def __init__(self, delay_ms: int, on_time, late, folder: str, millis: str = "logts_timestamp", clock: int | None = None):
        self.delay_ms, self.on_time, self.late, self.folder = delay_ms, on_time, late, folder
        self.millis, self.first_clock = millis, clock

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            known = handed_on(batch.sparkSession, self.folder, number, "clock bigint").first()
            clock = known["clock"] if known else self.first_clock
            if clock is None:
                self.on_time(batch, number)
            else:
                behind = F.coalesce(F.col(self.millis) < F.lit(clock - self.delay_ms), F.lit(False))
                self.on_time(batch.filter(~behind), number)
                self.late(batch.filter(behind), number)
            newest = F.greatest(F.max(F.col(self.millis).cast("bigint")), F.lit(clock).cast("bigint"))
            hand_on(batch.agg(newest.alias("clock")), self.folder, number)
        finally:
            batch.unpersist()
