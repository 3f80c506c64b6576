"""Follow growing text files, as a streaming source with byte offsets.

Spark's file source notices new files but not bytes appended to known ones. The
offset of this source is ``{file: position after the last complete line}``; byte
ranges are read by executors, large ones in several tasks, and a restarted query
goes on where its checkpoint says. Files have to be on storage that every
executor mounts. Compressed files are skipped.

The offset holds, beside the position, a digest of the file's first bytes and of those
before the position. Where a file no longer has them (it was truncated, or replaced by
another of its name) it begins at 0 again, also if it has regrown past its old
position. A file is opened only when its size, time or inode has changed since the last
look. Bytes that came and went between two looks were never there for this source.
"""

from __future__ import annotations

import glob
import hashlib
import os
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPLIT_BYTES = 64 << 20
_LOOK_BACK = 1 << 16
_MARK_BYTES = 1024


class _Range(InputPartition):
    def __init__(self, file: str, start: int, end: int, aligned: bool):
        self.file, self.start, self.end, self.aligned = file, start, end, aligned


def _mark(f, at: int) -> str:
    """Digest of the bytes at the beginning of a file and of those before a position."""
    size = min(at, _MARK_BYTES)
    f.seek(0)
    head = f.read(size)
    f.seek(at - size)
    return hashlib.sha256(head + f.read(size)).hexdigest()[:32]


class TailReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"]
        if "://" in self.pattern:
            raise ValueError("tail needs mounted files, given by plain paths or globs")
        self.from_end = options.get("from", "end") == "end"
        self.known: dict[str, tuple] = {}

    def _files(self) -> list[str]:
        return sorted(f for p in self.pattern.split(",") for f in glob.glob(p) if os.path.isfile(f))

    def _complete(self, f, end: int) -> int:
        """Position just past the last newline before ``end``."""
        while end > 0:
            start = max(0, end - _LOOK_BACK)
            f.seek(start)
            at = f.read(end - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            end = start
        return 0

    def _look(self, name: str) -> dict | None:
        """Position and identity of a file; None for a compressed one, and for one that is gone."""
        try:
            state = os.stat(name)
            seen = (state.st_ino, state.st_size, state.st_mtime_ns)
            if name not in self.known or self.known[name][0] != seen:
                with open(name, "rb") as f:
                    packed = f.read(2) == b"\x1f\x8b"
                    at = 0 if packed else self._complete(f, state.st_size)
                    found = None if packed else {"at": at, "mark": _mark(f, at)}
                self.known[name] = seen, found
            return self.known[name][1]
        except FileNotFoundError:  # removed since it was listed
            self.known.pop(name, None)
            return None

    def _now(self) -> dict:
        looks = {name: self._look(name) for name in self._files()}
        return {name: look for name, look in looks.items() if look}

    def initialOffset(self) -> dict:
        return self._now() if self.from_end else {}

    def latestOffset(self) -> dict:
        return self._now()

    def _begin(self, name: str, old: dict | int | None, new: dict) -> int:
        """Where to go on in a file: 0 if it is not the one (or not the contents) that was read."""
        if old is None or old == new:
            return new["at"] if old else 0
        if isinstance(old, int):  # an offset that an earlier version wrote: the position alone
            return old if old <= new["at"] else 0
        if new["at"] < old["at"]:
            return 0
        with open(name, "rb") as f:
            return old["at"] if _mark(f, old["at"]) == old["mark"] else 0

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges: list[InputPartition] = []
        for name, new in end.items():
            stop = new["at"]
            at = begin = self._begin(name, start.get(name), new)
            while at < stop:
                upto = min(at + _SPLIT_BYTES, stop)
                ranges.append(_Range(name, at, upto, at == begin))
                at = upto
        return ranges

    def read(self, part: _Range) -> Iterator[tuple]:
        with open(part.file, "rb") as f:
            at = part.start
            f.seek(at)
            if not part.aligned:
                # The line that crosses into this range belongs to the one before.
                f.seek(at - 1)
                at = at - 1 + len(f.readline())
            while at < part.end:
                line = f.readline()
                if not line:
                    break
                yield (part.file, at, line.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace"))
                at += len(line)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail_lines"

    def schema(self) -> str:
        return "file string, offset bigint, data string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return TailReader(self.options)


def tail(spark: SparkSession, paths: str, from_end: bool = True) -> DataFrame:
    """Streaming frame (file, offset, data) over files given by path or glob."""
    spark.dataSource.register(TailSource)
    return (
        spark.readStream.format("tail_lines")
        .option("path", paths)
        .option("from", "end" if from_end else "start")
        .load()
    )
