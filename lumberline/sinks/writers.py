"""Result formats and routing."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import json_object, render_template

Query = Callable[[DataFrame], DataFrame]


def as_json(df: DataFrame, name: str = "value") -> DataFrame:
    """One JSON object per result row; sub-events (structs, maps) nest."""
    return df.select(json_object(*df.columns).alias(name))


def as_text(df: DataFrame, template: str, name: str = "value") -> DataFrame:
    """One line per result row, from a ``${field}`` template."""
    return df.select(render_template(template, df.schema).alias(name))


def format_rows(df: DataFrame, template: str | None = None) -> DataFrame:
    return as_text(df, template) if template else as_json(df)


def write_lines(df: DataFrame, path: str, template: str | None = None, mode: str = "overwrite") -> None:
    format_rows(df, template).write.mode(mode).text(path)


@dataclass
class Output:
    """Where results go: a writer, and the queries bound to it (none: all)."""

    write: Callable[[DataFrame, str, str | None], None]
    queries: Sequence[str] = ()


class QuerySet:
    """Named queries over one parsed stream, routed to outputs.

    An output bound to queries gets only those; an unbound one gets every query.
    Silent queries, and those whose name starts with ``__``, are not printed.
    """

    def __init__(self):
        self._queries: dict[str, tuple[Query, bool]] = {}

    def add(self, name: str, query: Query, silent: bool = False) -> str:
        """Register; a taken name gets the suffix ``-1``, ``-2``, ..."""
        unique, n = name, 0
        while unique in self._queries:
            n += 1
            unique = f"{name}-{n}"
        self._queries[unique] = (query, silent or name.startswith("__"))
        return unique

    def results(self, events: DataFrame) -> dict[str, DataFrame]:
        return {name: query(events) for name, (query, _) in self._queries.items()}

    def routes(self, outputs: Mapping[str, Output]) -> dict[str, list[str]]:
        """Output name -> query names it receives."""
        loud = [n for n, (_, silent) in self._queries.items() if not silent]
        return {o: [n for n in loud if not out.queries or n in out.queries] for o, out in outputs.items()}

    def emit(self, events: DataFrame, outputs: Mapping[str, Output], batch: str | None = None) -> None:
        """Evaluate and write. Parsed events are kept while several queries use them."""
        events = events.persist()
        try:
            results = self.results(events)
            for output, names in self.routes(outputs).items():
                for name in names:
                    outputs[output].write(results[name], name, batch)
        finally:
            events.unpersist()

    def foreach_batch(self, outputs: Mapping[str, Output]) -> Callable[[DataFrame, int], None]:
        """The same routing for a streaming query (``writeStream.foreachBatch``).

        A batch is named by its stream and number, both of which its checkpoint keeps, so
        a replayed batch replaces its rows and a new stream leaves those of an old one.
        """

        def handle(batch: DataFrame, number: int) -> None:
            stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
            self.emit(batch, outputs, f"{stream}-{number}")

        return handle


def text_output(folder: str, template: str | None = None, queries: Sequence[str] = ()) -> Output:
    """Append each query's rows below ``folder/query=<name>``; a stream's batch goes to ``batch=`` there, once."""

    def write(df: DataFrame, name: str, batch: str | None = None) -> None:
        path = f"{folder}/query={name}"
        if batch is None:
            write_lines(df, path, template, mode="append")
        else:
            write_lines(df, f"{path}/batch={batch}", template)

    return Output(write, queries)


def tagged(results: Mapping[str, DataFrame]) -> DataFrame:
    """Results of several queries as (query, value) JSON rows."""
    out: DataFrame | None = None
    for name, df in results.items():
        one = as_json(df).withColumn("query", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def tagged_rows(events: DataFrame, rules: Mapping[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """:func:`tagged` for queries that look at one event each, given as (condition, columns).

    All of them are answered in one pass over the events, so a shared parse runs once. An
    event gives a row for each query whose condition holds.
    """
    if not rules:
        raise ValueError("no queries given")
    answers = [
        F.when(condition, F.struct(json_object(*columns).alias("value"), F.lit(name).alias("query")))
        for name, (condition, columns) in rules.items()
    ]
    return events.select(F.inline(F.array_compact(F.array(*answers))))
