"""Line-oriented sources: text files, compressed files, several files as one stream."""

from __future__ import annotations

import io
import sys
from collections.abc import Iterator, Mapping, Sequence
from typing import BinaryIO

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Python that runs inside tasks travels with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def scan_lines(spark: SparkSession, paths: str | Sequence[str], position: bool = False) -> DataFrame:
    """One row per line in ``data``. Files ending in ``.gz`` are unpacked on the way.

    ``position`` adds ``file``, ``block`` and ``line_id``; ordering by the three
    gives the order of the lines in their file.
    """
    df = spark.read.text(paths if isinstance(paths, str) else list(paths)).withColumnRenamed("value", "data")
    if not position:
        return df
    return df.select(
        "data",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line_id"),
    )


def spread(df: DataFrame) -> DataFrame:
    """Use every core on an input of few splits; an input of many stays as it is.

    Parsing is pure CPU work, and a small (or unsplittable) file would otherwise
    be parsed by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# Stores that a task can open by itself, by the scheme of their paths.
OPENED_BY_TASKS = ("file", "hdfs", "s3", "gs")


def scan_sniffed(spark: SparkSession, paths: str | Sequence[str], piecewise: bool | None = None) -> DataFrame:
    """Lines of files that may be gzip whatever they are called (told by magic bytes).

    Each file is one task, as gzip cannot be split. Spark lists the files; the task opens
    its file and reads and unpacks it piece by piece, so memory does not grow with the
    file. Stores that only Spark can open (told by their paths, or ``piecewise=False``)
    are read as one value for each file, which allows 2 GB.
    """
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    if piecewise is None:
        first = files.select("path").first()
        piecewise = first is None or first["path"].split(":", 1)[0] in OPENED_BY_TASKS

    def lines(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"] if "content" in batch else batch["path"]):
                with opened(path) if piecewise else io.BytesIO(content) as f:
                    for chunk in unpacked_lines(f):
                        yield pd.DataFrame({"file": path, "data": chunk})

    # The contents are read by Spark only where they are asked for.
    return files.select("path", *[] if piecewise else ["content"]).mapInPandas(lines, "file string, data string")


def opened(path: str) -> BinaryIO:
    """A file of a mounted folder, or of a store Arrow knows, to be read from its beginning."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return open("/" + rest.lstrip("/"), "rb")
    from pyarrow.fs import FileSystem

    store, name = FileSystem.from_uri(path)
    return store.open_input_stream(name, compression=None)


def unpacked_lines(source: bytes | BinaryIO, step: int = 1 << 20, rows: int = 10_000) -> Iterator[list[str]]:
    """Lists of lines of a (possibly gzip, possibly multi-member) file or byte string.

    At most ``step`` bytes are read and eight times as many unpacked at a time. Zeros after
    a member are padding. A gzip stream that stops early is an error.
    """
    import zlib

    f = io.BytesIO(source) if isinstance(source, bytes) else source

    def pieces() -> Iterator[bytes]:
        fed = f.read(step)
        while len(fed) < 2 and (more := f.read(step)):
            fed += more
        if fed[:2] != b"\x1f\x8b":
            while fed:
                yield fed
                fed = f.read(step)
            return
        unpack, held = zlib.decompressobj(31), False  # held: unpacked bytes wait inside
        while held or fed or (fed := f.read(step)):
            if unpack is None:
                if not (fed := fed.lstrip(b"\0")):
                    continue
                unpack = zlib.decompressobj(31)
            piece = unpack.decompress(fed, 8 * step)
            yield piece
            held = not unpack.eof and len(piece) == 8 * step
            fed, unpack = (unpack.unused_data, None) if unpack.eof else (unpack.unconsumed_tail, unpack)
        if unpack is not None:
            raise EOFError("a gzip file ends before its stream does")

    rest, out, held = [], [], 0
    for piece in pieces():
        if b"\n" not in piece:
            rest.append(piece)  # a line over several pieces is joined once
            continue
        first, *full = piece.split(b"\n")
        full, rest = [b"".join([*rest, first]), *full[:-1]], [full[-1]]
        for line in full:
            out.append(line.removesuffix(b"\r").decode("utf-8", "replace"))
            held += len(line)
            if len(out) >= rows or held >= 8 * step:
                yield out
                out, held = [], 0
    if last := b"".join(rest):
        out.append(last.decode("utf-8", "replace"))
    if out:
        yield out


def merge_by_event_time(inputs: Mapping[str, DataFrame], time: str = "logts_timestamp", tie: Sequence[str] = ()) -> DataFrame:
    """Several parsed inputs as one stream in event-time order (no time sorts as 0)."""
    merged: DataFrame | None = None
    for name, df in inputs.items():
        one = df.withColumn("input", F.lit(name))
        merged = one if merged is None else merged.unionByName(one, allowMissingColumns=True)
    if merged is None:
        raise ValueError("no inputs given")
    return merged.orderBy(F.coalesce(F.col(time), F.lit(0)), "input", *tie)


def stream_union(*frames: DataFrame) -> DataFrame:
    """Several streams into one target; a column a stream lacks is NULL there."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
