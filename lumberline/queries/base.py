"""Registry of queries and the inputs they share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.functions.times import epoch_micros
from lumberline.plans.patterns import PatternSet
from lumberline.session import fresh_path, prepare
from lumberline.sources.lines import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a query, with the SQL that states what it must return."""

    def register(fn):
        if key in QUERIES:
            raise ValueError(f"query {key!r} is registered twice")

        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = sql
        return run

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table; its type column is called ``action`` to leave ``event_type`` free."""
    df = table(spark, sf_dir, "events").withColumnRenamed("event_type", "action")
    return df.withColumn("ts_us", epoch_micros(F.col("ts")))


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # A glob, because a streamed path must be a folder and the table may be one file.
    df = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumnRenamed("event_type", "action")
    return df.withColumn("ts_us", epoch_micros(F.col("ts")))


def replayed(df: DataFrame, order: str, label: str, parts: int = 4) -> DataFrame:
    """The rows as a stream that reads one of ``parts`` stretches of ``order`` per micro-batch, one after another."""
    spark = df.sparkSession
    path, files = fresh_path(spark, label), spark.sparkContext.defaultParallelism
    cuts = df.approxQuantile(order, [i / parts for i in range(1, parts)], 0.01)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df if low is None else df.filter(F.col(order) >= low)
        part = part if high is None else part.filter(F.col(order) < high)
        part.repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def line_of(props: Column | str = "props") -> Column:
    """A prefixed log line made from an event row."""
    return F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00\thost"),
        F.pmod("user_id", F.lit(5)).cast("string"), F.lit("\t"), F.col("event_id").cast("string"),
        F.lit("\tuser="), F.col("user_id").cast("string"), F.lit(" action="), F.col("action"),
        F.lit(" "), F.col(props) if isinstance(props, str) else props,
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(events(spark, sf_dir)).select(line_of().alias("data"))


def log_lines_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_stream(spark, sf_dir).select(line_of().alias("data"))


def line_sql(props: str = "props") -> str:
    """The same line in DuckDB, over the events table."""
    return (
        "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' || chr(9) || 'host' || (user_id % 5) || chr(9) || event_id"
        f" || chr(9) || 'user=' || user_id || ' action=' || event_type || ' ' || {props}"
    )


# Events that a watermark without lateness has passed at the end of the table.
PASSED = "passed AS (SELECT * FROM events WHERE epoch_us(ts) // 1000 < (SELECT max(epoch_us(ts)) // 1000 FROM events))"
LINES = f"lines AS (SELECT *, {line_sql()} AS line FROM events)"
# What a prefixed line parses into, by splitting it at its tabs.
PARTS = (
    f"{LINES}, parts AS (SELECT *, split_part(line, chr(9), 1) AS logts, split_part(line, chr(9), 2) AS host, "
    "split_part(line, chr(9), 3) AS pid, split_part(line, chr(9), 4) AS body FROM lines)"
)

APP = {
    "name": "app",
    "parent": "logevents",
    "pattern": "user=%{INT:user_id} action=%{WORD:action} %{JSON:props}",
    "fields": {"k": "int"},
}
APP_TYPES = PatternSet([APP])

def with_ip(df: DataFrame) -> DataFrame:
    """Adds an address per event; some are NULL, empty or not an address."""
    id_, kind = F.col("event_id"), F.col("event_id") % 101
    first = F.element_at(F.array(*[F.lit(x) for x in ("10", "172", "192", "8")]), (id_ % 4 + 1).cast("int"))
    second = F.when(id_ % 4 == 2, "168").otherwise((id_ % 256).cast("string"))
    ip = F.concat_ws(".", first, second, (F.col("user_id") % 256).cast("string"), F.lit("1"))
    return df.withColumn("ip", F.when(kind == 0, None).when(kind == 1, "").when(kind == 2, "bad").otherwise(ip))


IPS = """ips AS (SELECT *, CASE event_id % 101 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'bad' ELSE
  (CASE event_id % 4 WHEN 0 THEN '10' WHEN 1 THEN '172' WHEN 2 THEN '192' ELSE '8' END) || '.' ||
  (CASE event_id % 4 WHEN 2 THEN '168' ELSE CAST(event_id % 256 AS VARCHAR) END) || '.' ||
  CAST(user_id % 256 AS VARCHAR) || '.1' END AS ip FROM events),
nums AS (SELECT *, CASE WHEN ip IS NULL OR ip IN ('', 'bad') THEN NULL ELSE
  CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 +
  CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) END AS num FROM ips)"""
