"""Event types: definitions, the type tree, and the schema it implies.

All of this is driver-side bookkeeping over a handful of definitions. The
outcome is a tree of :class:`Node` that ``plans.parse`` turns into columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

from lumberline.functions.grok import Grok, compile_grok

ROOT_TYPE = "events"

# The two event types every pattern set starts from.
BASE_DEFINITIONS = (
    {
        "name": "events",
        "order": 1,
        "pattern": r"^(?<data>.*)(\n)?$",
        "fields": {"srcip": "string", "srcport": "int", "dstip": "string", "dstport": "int"},
    },
    {
        "name": "logevents",
        "parent": "events",
        "order": 2,
        "pattern": r"^(?<logts>[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\S+)\t(?<host>[^\t]+)\t(?<pid>[^\t]*)\t(?<data>.*)$",
    },
)

SPARK_TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "long": T.LongType(),
    "float": T.FloatType(),
    "double": T.DoubleType(),
    "map": T.MapType(T.StringType(), T.StringType()),
}

_SHORTHAND = re.compile(r"([a-zA-Z][a-zA-Z0-9_-]*)@@(.*)", re.DOTALL)


def _listed(value) -> list:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)


def column_name(name: str) -> str:
    """Field names become columns, where ``-`` is spelled ``_``."""
    return name.replace("-", "_")


@dataclass
class Node:
    """One compiled event type."""

    name: str
    parents: list[str]
    order: int
    patterns: list[Grok]
    optional: list[Grok]
    source: str
    cond: dict[str, str]
    softcond: dict[str, str]
    replace: list[dict[str, str]]
    fields: dict[str, str]
    csv_fields: list[str]
    json: str | None = None
    json_nested: bool = False
    csv: str | None = None
    urlargs: str | None = None
    urlargs_nested: bool = False
    srctime: tuple[str, str] | None = None
    children: list["Node"] = field(default_factory=list, repr=False)


def definition(expression: str) -> dict:
    """Shorthand ``type@@pattern``; a bare expression defines the root type anew."""
    m = _SHORTHAND.fullmatch(expression)
    if m:
        return {"name": m.group(1), "pattern": m.group(2)}
    return {"name": ROOT_TYPE, "pattern": expression}


def compile_definition(spec: Mapping, grok: Mapping[str, str] | None = None) -> Node:
    """Check one definition (the keys of a pattern file) and infer its fields."""
    name = spec.get("name")
    if not name:
        raise ValueError("an event type needs a name")
    patterns = [compile_grok(p, grok) for p in _listed(spec.get("pattern"))]
    optional = [compile_grok(p, grok) for p in _listed(spec.get("optionalpattern"))]
    inferred: dict[str, str] = {}
    for compiled in patterns + optional:
        for fld, kind in compiled.types.items():
            inferred.setdefault(fld, kind)

    node = Node(
        name=name,
        parents=_listed(spec.get("parent")) or ([] if name == ROOT_TYPE else [ROOT_TYPE]),
        order=int(spec.get("order") or 0),
        patterns=patterns,
        optional=optional,
        source=spec.get("field") or "data",
        cond=dict(spec.get("cond") or {}),
        softcond=dict(spec.get("softcond") or {}),
        replace=list(spec.get("replace") or []),
        fields={},
        csv_fields=[column_name(c) for c in _listed(spec.get("csv-fields"))],
    )
    # One JSON, one CSV and one url-args field per event type: the first of each.
    for fld, kind in inferred.items():
        family, _, nested = kind.partition(".")
        if family in ("json", "csv", "urlargs"):
            if getattr(node, family) is None:
                setattr(node, family, fld)
                if family != "csv":
                    setattr(node, f"{family}_nested", bool(nested))
            keep_map = nested and family != "csv" and getattr(node, family) == fld
            node.fields[fld] = f"{family}map" if keep_map else "string"
        else:
            node.fields[fld] = kind
    for fld in node.csv_fields:
        node.fields[fld] = "string"
    declared = spec.get("fields") or {}
    if not isinstance(declared, Mapping):
        declared = {column_name(f): "string" for f in _listed(declared)}
    node.fields.update(declared)
    if spec.get("srctime-field") and spec.get("srctime-format"):
        node.srctime = (spec["srctime-field"], spec["srctime-format"])
        node.fields["src_logts_timestamp"] = "long"
    return node


class PatternSet:
    """A set of event types that is parsed together.

    ``event_types`` restricts parsing to the named types and their ancestors.
    The base types are added unless the set defines the root type itself.
    """

    def __init__(
        self,
        definitions: Iterable[Mapping | str] = (),
        grok: Mapping[str, str] | None = None,
        event_types: Sequence[str] | str | None = None,
    ):
        specs = [definition(d) if isinstance(d, str) else dict(d) for d in definitions]
        if not any(s.get("name") == ROOT_TYPE for s in specs):
            names = {s.get("name") for s in specs}
            specs = [b for b in BASE_DEFINITIONS if b["name"] not in names] + specs
        self.grok = dict(grok or {})
        nodes = [compile_definition(s, self.grok) for s in specs]
        self.nodes = {n.name: n for n in nodes}
        wanted = _listed(event_types)
        if wanted:
            keep = set(wanted) | {a for w in wanted for a in self.ancestors(w)}
            self.nodes = {k: n for k, n in self.nodes.items() if k in keep}
        for node in self.nodes.values():
            inside = [c for c in self.nodes.values() if node.name in c.parents]
            node.children = sorted(inside, key=lambda c: c.order)
        self.roots = sorted((n for n in self.nodes.values() if not n.parents), key=lambda n: n.order)

    @classmethod
    def from_document(cls, document: Mapping, event_types=None) -> "PatternSet":
        """From a loaded pattern file: ``patterns`` (or ``pattern``) plus ``grok``."""
        definitions = document.get("patterns", document.get("pattern", []))
        if isinstance(definitions, (str, Mapping)):
            definitions = [definitions]
        return cls(definitions, document.get("grok"), event_types)

    def ancestors(self, name: str) -> list[str]:
        """All parents up to the root, nearest first."""
        found: list[str] = []
        queue = list(self.nodes[name].parents) if name in self.nodes else []
        while queue:
            parent = queue.pop(0)
            if parent not in found and parent in self.nodes:
                found.append(parent)
                queue.extend(self.nodes[parent].parents)
        return found

    def family(self, name: str) -> list[str]:
        """The type itself and all its descendants."""
        found = [name]
        for current in found:
            found.extend(n.name for n in self.nodes.values() if current in n.parents and n.name not in found)
        return found

    def field_types(self) -> dict[str, str]:
        """Field -> type. Types that disagree between event types give ``string``."""
        seen: dict[str, set[str]] = {}
        for node in self.nodes.values():
            for fld, kind in node.fields.items():
                seen.setdefault(fld, set()).add(kind)
        return {f: kinds.pop() if len(kinds) == 1 else "string" for f, kinds in seen.items()}

    def fields_of(self, name: str) -> dict[str, str]:
        """Fields visible on one type: its own first, then those of its ancestors."""
        visible: dict[str, str] = {}
        for owner in [name, *self.ancestors(name)]:
            for fld, kind in self.nodes[owner].fields.items():
                visible.setdefault(fld, kind)
        return visible
