"""Streams whose state is a table: named windows with snapshots, and multi-line entries.

Both are ``foreachBatch`` handlers that run the batch operators over the rows kept from
earlier batches and the new ones. Kept rows are handed on below the query's checkpoint,
so a replayed batch meets what it met before, and a key with very many rows is cut into
chunks as in batch.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumberline.operators.sequence import gather_parts, joined_parts, mark_continued, split_entries
from lumberline.operators.windows import latest_per_key
from lumberline.sinks.snapshots import SnapshotStore
from lumberline.streaming.runner import SNAPSHOT_SECONDS, hand_on, handed_on

Merge = Callable[[DataFrame], DataFrame]


def keep_all() -> Merge:
    """Everything that ever came."""
    return lambda rows: rows


def keep_latest(keys: Sequence[str], order: str, tie: Sequence[str] = ()) -> Merge:
    """The latest row of each key."""
    return lambda rows: latest_per_key(rows, keys, order, tie)


def keep_time(order: str, reach: int) -> Merge:
    """Rows less than ``reach`` behind the newest one."""

    def merge(rows: DataFrame) -> DataFrame:
        newest = rows.agg(F.max(order).alias("__newest"))
        return rows.join(newest, F.col(order) > F.col("__newest") - F.lit(reach)).drop("__newest")  # one row

    return merge


class NamedWindow:
    """``foreachBatch`` handler that keeps a window's contents and saves snapshots of them.

    ``merge`` says which of the held and the new rows stay; the contents are written
    once a batch, so a batch costs a pass over the window. A snapshot is saved after a
    batch when ``seconds`` have gone by since the last one, and by :meth:`save`; it always
    holds the whole window. A new checkpoint starts from the store's snapshot of this
    name, if there is one. Rows have to have the columns of ``schema``; others are left out.
    """

    def __init__(
        self, store: SnapshotStore, name: str, folder: str, schema: T.StructType | str, merge: Merge,
        seconds: float = SNAPSHOT_SECONDS, clock: Callable[[], float] = time.monotonic,
    ):
        self.store, self.name, self.folder, self.merge = store, name, folder, merge
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.seconds, self.clock = seconds, clock
        self.saved_at, self.number = clock(), None

    def _saved(self) -> DataFrame:
        """The store's snapshot; without one, nothing."""
        try:
            return self.store.restore(self.name, self.schema)
        except FileNotFoundError:
            return self.store.spark.createDataFrame([], self.schema)

    def _start(self, spark: SparkSession) -> DataFrame:
        """What the checkpoint's first batch meets. It is copied once, so that batch meets it again when replayed
        after a snapshot that already holds its rows."""
        start, done = f"{self.folder}/start", f"{self.folder}/start-done"
        try:
            spark.read.text(done)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            self._saved().write.mode("overwrite").parquet(start)
            spark.createDataFrame([("done",)], "value string").coalesce(1).write.text(done)
        return spark.read.schema(self.schema).parquet(start)

    def _held(self, spark: SparkSession, number: int) -> DataFrame:
        return handed_on(spark, self.folder, number, self.schema) if number else self._start(spark)

    def __call__(self, batch: DataFrame, number: int) -> None:
        held = self._held(batch.sparkSession, number)
        hand_on(self.merge(held.unionByName(batch.select(*self.schema.names))), self.folder, number)
        self.number = number
        if self.clock() - self.saved_at >= self.seconds:
            self.save()

    def contents(self) -> DataFrame:
        """The window after the last batch this handler saw; before the first, the store's snapshot."""
        if self.number is None:
            return self._saved()
        return handed_on(self.store.spark, self.folder, self.number + 1, self.schema)

    def save(self) -> None:
        """Save the contents now; nothing happens before the first batch."""
        if self.number is not None:
            self.store.save(self.name, self.contents(), self.number)
            self.saved_at = self.clock()


def run_window(df: DataFrame, window: NamedWindow, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a stream that keeps ``window``; ``trigger`` as for ``DataStreamWriter.trigger``."""
    writer = df.writeStream.foreachBatch(window).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stop_window(query: StreamingQuery, window: NamedWindow, finish: bool = False) -> None:
    """Stop the stream (``finish``: wait for its end) and save the window, also where the stream failed."""
    try:
        if finish:
            query.awaitTermination()
        else:
            query.stop()
    finally:
        window.save()


class AssembleLines:
    """``foreachBatch`` handler that joins physical lines into entries across batches.

    A file's lines (``keys`` name the file) come in the order of ``position``, then
    ``tie``. All entries but the last of each file are complete and go to
    ``write(entries, number)``, which has to replace what it wrote for that number; the
    last one stays open. An open entry goes out too once its file had no line for
    ``flush_seconds`` (judged when a batch comes) and by :meth:`flush`.

    An entry of more than ``max_chars`` characters is written in parts as they fill up,
    numbered by ``entry_part``, all but the last marked ``continues``; a part holds at most
    ``max_chars`` and one line more, and no line is lost. So an open entry keeps that much.
    Cutting does not depend on batches: the parts are those of
    :func:`lumberline.operators.sequence.split_entries` over the whole input.
    """

    def __init__(
        self, folder: str, keys: Sequence[str], position: str, text: str, start: Column,
        write: Callable[[DataFrame, int], None], tie: Sequence[str] = (), separator: str = "\n",
        width: int | None = None, max_chars: int = 1 << 20, flush_seconds: float | None = None, clock: Callable[[], float] = time.time,
    ):
        self.folder, self.keys, self.position, self.text, self.start = folder, list(keys), position, text, start
        self.write, self.tie, self.separator, self.width = write, list(tie), separator, width
        self.max_chars, self.flush_seconds, self.clock = max_chars, flush_seconds, clock
        self.schema: T.StructType | None = None
        self.number = None

    def _columns(self) -> list[str]:
        return [*self.keys, self.position, *self.tie, self.text]

    def __call__(self, batch: DataFrame, number: int) -> None:
        batch = batch.select(*self._columns()).persist()
        try:
            self._take(batch, number, self.clock(), flush=False)
        finally:
            batch.unpersist()

    def flush(self, spark: SparkSession) -> None:
        """Write what is still open, as the batch after the last one (at the end of a run that goes on nowhere)."""
        if self.number is not None:
            lines = spark.createDataFrame([], T.StructType(self.schema.fields[: len(self._columns())]))
            self._take(lines, self.number + 1, self.clock(), flush=True)

    def _take(self, lines: DataFrame, number: int, now: float, flush: bool) -> None:
        more = [T.StructField("__before", T.LongType()), T.StructField("__seen", T.DoubleType())]
        self.schema = T.StructType([*lines.schema.fields, *more])
        kept = handed_on(lines.sparkSession, self.folder, number, self.schema)
        fresh = lines.withColumns({"__before": F.lit(None).cast("bigint"), "__seen": F.lit(now)})
        pieces = split_entries(
            kept.unionByName(fresh), self.keys, self.position, self.text, self.start, self.separator, self.width,
            self.tie, self.max_chars, before="__before",
        )
        more = [F.max("__seen").alias("__seen"), F.max("__entries").alias("__entries")]
        parts = gather_parts(pieces, self.keys, self.position, self.text, self.separator, self.tie, self.max_chars, "__before", more).persist()
        try:
            # The last part of each file's last entry is open.
            idle = F.lit(flush) if flush or self.flush_seconds is None else F.col("__seen") <= F.lit(now - self.flush_seconds)
            open_ = (F.col("entry") == F.col("__entries")) & ~F.col("continues") & ~idle
            marked = mark_continued(parts, self.keys)
            self.write(joined_parts(marked.filter(~open_), self.keys, self.text, self.separator).drop("entry"), number)
            held = marked.filter(open_).select(*self.keys, "__seen", F.explode("__lines").alias("__line"))
            rest = [c for c in self.schema.names if c not in (*self.keys, "__seen")]
            hand_on(held.select(*[F.col("__line").getField(c).alias(c) if c in rest else c for c in self.schema.names]), self.folder, number)
        finally:
            parts.unpersist()
        self.number = number

