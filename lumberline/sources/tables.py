"""Small structured inputs: CSV, literal lists, reloadable reference tables."""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterable, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def scan_csv(
    spark: SparkSession,
    path: str | Sequence[str] | None = None,
    content: str | None = None,
    header: bool = True,
    fields: Mapping[str, str] | None = None,
    multiline: bool = False,
) -> DataFrame:
    """CSV from files or inline text. Everything is text unless declared ``int``.

    Without a header the declared ``fields`` name the columns in order. A record
    with fewer values than names is an error, and so is a non-numeric ``int``.
    ``multiline`` allows line breaks inside quotes; such files are not split.
    """
    fields = dict(fields or {})
    if not header and not fields:
        raise ValueError("a CSV input without a header needs its fields declared")
    if path is not None:
        reader = spark.read.option("header", header).option("mode", "FAILFAST").option("escape", "\\").option("multiLine", multiline)
        if not header:
            reader = reader.schema(T.StructType([T.StructField(f, T.StringType()) for f in fields]))
        raw = reader.csv(path if isinstance(path, str) else list(path))
    elif content:
        rows = [r for r in csv.reader(io.StringIO(content)) if r]
        names = rows.pop(0) if header else list(fields)
        for row in rows:
            if len(row) < len(names):
                raise ValueError(f"CSV record has {len(row)} values for {len(names)} fields")
        raw = literal_table(spark, [tuple(r[: len(names)]) for r in rows], T.StructType([T.StructField(n, T.StringType()) for n in names]))
    else:
        raise ValueError("a CSV input needs a path or content")
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in raw.columns}
    return raw.select(
        *[(t.cast("int") if fields.get(c) == "int" else t).alias(c) for c, t in text.items()]
    )


def literal_table(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """Rows that the driver holds, as a relation whose size Spark knows.

    Catalyst then broadcasts a small one by its own threshold; rows made from Python
    tuples would count as boundless, and the other side of a join be shuffled.
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = [pa.array([r[i] for r in rows], to_arrow_type(f.dataType)) for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema.fieldNames()), schema)


def static_list(spark: SparkSession, values: Iterable, field: str = "data") -> DataFrame:
    """A literal list as a one-column table."""
    return literal_table(spark, [(str(v),) for v in values], T.StructType([T.StructField(field, T.StringType())]))


def lookup_window(df: DataFrame, name: str) -> DataFrame:
    """Register a table under a name, for SQL and for joins by name."""
    df.createOrReplaceTempView(name)
    return df


class ReferenceTable:
    """A lookup table with declared columns, fully replaced at each load.

    Every load is written under a path of its own and the view is then pointed to
    it, so readers never see a half-written table and a lost executor re-reads. A
    second table object of the same name and folder leaves earlier loads readable.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, columns: Mapping[str, str]):
        self.spark, self.name, self.folder = spark, name, folder.rstrip("/")
        self.columns = dict(columns)

    def conform(self, df: DataFrame) -> DataFrame:
        """Declared columns only, with declared types; absent ones are NULL."""
        return df.select(
            *[
                (F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c)
                for c, kind in self.columns.items()
            ]
        )

    def load(self, *inputs: DataFrame) -> DataFrame:
        parts = [self.conform(df) for df in inputs]
        table = parts[0]
        for part in parts[1:]:
            table = table.unionByName(part)
        path = f"{self.folder}/{self.name}/load-{uuid.uuid4().hex}"
        table.write.parquet(path)
        loaded = self.spark.read.parquet(path)
        loaded.createOrReplaceTempView(self.name)
        return loaded

    def read(self) -> DataFrame:
        return self.spark.table(self.name)
