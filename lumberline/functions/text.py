"""Text-valued helpers: url arguments, CSV fields, templates, JSON rendering."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.functions.binding import let

_PLACEHOLDER = re.compile(r"\$\{([^${}]+)\}")
_CSV_END = "\u0001"


def url_pairs(args: Column) -> Column:
    """``a=1&b`` -> ARRAY<STRUCT<key,value,ok>> in order of appearance.

    A piece without ``=``, or starting with it, is a bare key with no value and
    is not decoded; an empty value is NULL; ``ok`` is FALSE where a percent
    escape is malformed. Trailing empty pieces are dropped.
    """
    trimmed = F.regexp_replace(args, r"&+\z", "")
    pieces = F.when((trimmed == "") & (args != ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, "&", -1))

    def pair(piece: Column) -> Column:
        at = F.instr(piece, "=")
        raw_key = F.substring_index(piece, "=", 1)
        raw_value = F.substring(piece, at + 1, F.length(piece))
        key = F.when(at > 1, F.try_url_decode(raw_key)).otherwise(piece)
        value = F.when((at > 1) & (F.length(piece) > at), F.try_url_decode(raw_value))
        bad = (at > 1) & (key.isNull() | ((F.length(piece) > at) & value.isNull()))
        return F.struct(key.alias("key"), value.alias("value"), (~bad).alias("ok"))

    return F.transform(pieces, pair)


def url_pairs_valid(pairs: Column) -> Column:
    return F.forall(pairs, lambda p: p["ok"])


def url_map(pairs: Column) -> Column:
    """Pairs -> MAP<STRING,STRING>; the last value of a repeated key wins (by the session's map policy)."""
    known = F.filter(pairs, lambda p: p["key"].isNotNull())
    return F.map_from_entries(F.transform(known, lambda p: F.struct(p["key"], p["value"])))


def url_multi_map(pairs: Column) -> Column:
    """Pairs -> MAP<STRING,ARRAY<STRING>> with every value of a key, in order."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    values = F.transform(
        keys,
        lambda k: F.transform(F.filter(pairs, lambda p: p["key"] == k), lambda p: p["value"]),
    )
    return F.map_from_arrays(keys, values)


def csv_values(text: Column, count: int) -> Column:
    """One CSV record -> ARRAY of ``count`` strings; absent trailing values are NULL.

    An end marker appended as one more value tells an empty value (kept as an
    empty string) from a missing one.
    """
    schema = ", ".join(f"c{i} string" for i in range(count + 1))
    row = F.from_csv(F.concat(text, F.lit("," + _CSV_END)), schema)

    def kept(values: Column) -> Column:
        end = F.array_position(values, _CSV_END)
        return F.transform(
            F.slice(values, 1, count),
            lambda v, i: F.when((end == 0) | (i < end - 1), F.coalesce(v, F.lit(""))),
        )

    return let(let(row, lambda r: F.array(*[r[f"c{i}"] for i in range(count + 1)])), kept)


def render_template(template: str, schema: T.StructType) -> Column:
    """``${field}`` / ``${a.b}`` text with values filled in.

    Unknown names, and NULL values, leave the placeholder as it is.
    """
    pieces: list[Column] = []
    position = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > position:
            pieces.append(F.lit(template[position:m.start()]))
        value = _lookup(m.group(1), schema)
        pieces.append(F.lit(m.group()) if value is None else F.coalesce(value.cast("string"), F.lit(m.group())))
        position = m.end()
    if position < len(template):
        pieces.append(F.lit(template[position:]))
    return F.concat(*pieces) if pieces else F.lit("")


def _lookup(path: str, schema: T.StructType) -> Column | None:
    head, *rest = path.split(".")
    if path in schema.fieldNames():
        nested = isinstance(schema[path].dataType, (T.StructType, T.MapType))
        return None if nested else F.col(f"`{path}`")
    if head not in schema.fieldNames():
        return None
    kind, value = schema[head].dataType, F.col(f"`{head}`")
    while rest:
        if isinstance(kind, T.MapType):
            return F.try_element_at(value, F.lit(".".join(rest)))
        if not isinstance(kind, T.StructType) or rest[0] not in kind.fieldNames():
            return None
        kind, value = kind[rest[0]].dataType, value[rest[0]]
        rest = rest[1:]
    return None if isinstance(kind, (T.StructType, T.MapType)) else value


def json_object(*columns: str) -> Column:
    """One JSON object per row; NULL fields are written, not dropped."""
    packed = F.struct("*") if not columns else F.struct(*columns)
    return F.to_json(packed, {"ignoreNullFields": "false"})
