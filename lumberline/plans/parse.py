"""Lines -> typed events, as a fold of column expressions over the type tree.

The tree is walked once, on the driver, in matching order. Each step adds one
projection, so the result is a narrow plan: no shuffle, no Python, valid on
batch and streaming frames alike. A pattern costs one regex pass per line that
reaches it: all its captures come out of a single replacement, split apart at a
control character. Lines that contain that character take an exact slower path.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions import text as tx
from lumberline.functions.grok import Grok
from lumberline.functions.times import event_time_millis, parse_millis
from lumberline.plans.patterns import ROOT_TYPE, SPARK_TYPES, Node, PatternSet

_CUT = "\u0001"
_MAP = "map<string,string>"


@dataclass(frozen=True)
class Flag:
    """A boolean column saying that a counter of an event type goes up by one."""

    counter: str
    event_type: str
    column: str


def q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def match_parts(source: Column, grok: Grok) -> Column:
    """ARRAY whose item ``i`` is the ``i``-th capture; a single item when unmatched."""
    if not grok.captures:
        hit = F.rlike(source, F.lit(grok.regex))
        return F.when(hit, F.array(F.lit(""), F.lit(""))).otherwise(F.array(F.lit("")))
    fast = F.split(
        F.regexp_replace(source, grok.regex, "".join(f"{_CUT}${c.group}" for c in grok.captures)),
        _CUT,
        -1,
    )
    captures = [F.regexp_extract(source, grok.regex, c.group) for c in grok.captures]
    slow = F.when(F.rlike(source, F.lit(grok.regex)), F.array(F.lit(""), *captures)).otherwise(F.array(F.lit("")))
    return F.when(F.contains(source, F.lit(_CUT)), slow).otherwise(fast)


def full_match(value: Column, regex: str) -> Column:
    return F.rlike(value, F.lit(rf"\A(?:{regex})\z"))


class _Fold:
    """Working state of one walk: the frame and which fields may hold a value."""

    def __init__(self, df: DataFrame, patterns: PatternSet, line: str):
        self.patterns = patterns
        self.types = patterns.field_types()
        self.step = 0
        self.flags: list[Flag] = []
        self.flag_values: dict[str, Column] = {}
        self.present = {"data"}
        self.extra = False
        self.carried = [c for c in df.columns if c != line]
        self.df = df.select(
            *[q(c) for c in self.carried],
            q(line).cast("string").alias("__v_data"),
            F.array().cast("array<string>").alias("__path"),
        )

    # -- small helpers -----------------------------------------------------
    def value(self, name: str) -> Column:
        return q("__v_" + name) if name in self.present else F.lit(None).cast("string")

    def add(self, columns: dict[str, Column]) -> None:
        if columns:
            self.df = self.df.withColumns(columns)

    def written(self, values: dict[str, Column], when: Column) -> dict[str, Column]:
        return {"__v_" + n: F.when(when, new).otherwise(self.value(n)) for n, new in values.items()}

    def write(self, values: dict[str, Column], when: Column, **more: Column) -> None:
        self.add({**self.written(values, when), **more})
        self.present |= set(values)

    def temp(self, label: str) -> str:
        self.step += 1
        return f"__{label}{self.step}"

    # -- the walk ----------------------------------------------------------
    # A pattern adds two projections: its match, then everything it writes. Flags
    # (tried, hit, level still open) are cheap expressions over stored matches.
    def level(self, nodes: list[Node], gate: Column, trail: tuple[str, ...]) -> None:
        open_ = gate
        for node in nodes:
            if node.name in trail or not node.patterns or node.source not in self.present:
                continue
            matched, ok = self.visit(node, open_, trail)
            open_ = open_ & ~(matched if ok is None else matched & ok)

    def visit(self, node: Node, open_: Column, trail: tuple[str, ...]) -> tuple[Column, Column | None]:
        gate = open_ & self.value(node.source).isNotNull()
        for fld, regex in node.cond.items():
            gate = gate & F.coalesce(full_match(self.value(fld), regex), F.lit(False))
        for fld, regex in node.softcond.items():
            gate = gate & F.coalesce(full_match(self.value(fld), regex), F.lit(True))

        matched: Column | None = None
        for i, grok in enumerate(node.patterns):
            name, hit = self.match(node, grok, gate)
            if i == 0:
                # Later expressions are tried exactly when the first one was.
                gate = q(name).isNotNull()
                self.flag("tried", node, gate)
            self.capture(name, grok, hit, path=node.name)
            matched = hit if matched is None else matched | hit
        if len(node.patterns) > 1:
            name = self.temp("hit")
            self.add({name: matched})
            matched = q(name)
        self.flag("matched", node, matched)
        for grok in node.optional:
            name, hit = self.match(node, grok, matched)
            self.capture(name, grok, hit)
        self.level(node.children, matched, (*trail, node.name))
        return matched, self.finish(node, matched)

    def flag(self, counter: str, node: Node, value: Column) -> None:
        name = f"__flag{len(self.flags)}"
        self.flags.append(Flag(counter, node.name, name))
        self.flag_values[name] = value

    def match(self, node: Node, grok: Grok, gate: Column) -> tuple[str, Column]:
        """Store the match of one expression (NULL where it was not tried)."""
        name = self.temp("p")
        self.add({name: F.when(gate, match_parts(self.value(node.source), grok))})
        return name, F.coalesce(F.size(q(name)) > 1, F.lit(False))

    def capture(self, name: str, grok: Grok, hit: Column, path: str | None = None) -> None:
        """Write the captures of a match, and its type into the path."""
        values: dict[str, Column] = {}
        for i, capture in enumerate(grok.captures, start=1):
            got = q(name)[i]
            if capture.optional:
                got = F.nullif(got, F.lit(""))
            # A name that occurs twice keeps its last value that is set.
            values[capture.name] = F.coalesce(got, values[capture.name]) if capture.name in values else got
        more = {}
        if path is not None:
            more["__path"] = F.when(hit, F.array_append(q("__path"), F.lit(path))).otherwise(q("__path"))
        self.write(values, hit, **more)

    def finish(self, node: Node, matched: Column) -> Column | None:
        """Structured fields, replacements and source time of a matched type.

        Runs on the way up, after the children. Returns the flag that lets the
        type close its level (None: always): a broken JSON or url-args field leaves
        it open.
        """
        done, good = matched, None
        if node.json in self.present:
            raw, parsed, good, seen = self.value(node.json), self.temp("json"), self.temp("ok"), self.temp("deser")
            self.add({parsed: F.from_json(F.when(matched, raw), _MAP), seen: matched & raw.isNotNull()})
            self.flag("desercount", node, q(seen))
            nulls = F.exists(F.map_values(q(parsed)), lambda v: v.isNull())
            self.add({good: ~q(seen) | q(parsed).isNotNull(), "__nulls": F.coalesce(nulls, F.lit(False))})
            done = matched & q(good)
            if not node.json_nested:
                self.merge(node.json, parsed)
        if node.csv in self.present and node.csv_fields:
            row = self.temp("csv")
            self.add({row: F.when(done, tx.csv_values(self.value(node.csv), len(node.csv_fields)))})
            self.write({f: F.coalesce(q(row)[i], self.value(f)) for i, f in enumerate(node.csv_fields)}, done)
        if node.urlargs in self.present:
            raw, pairs, fine = self.value(node.urlargs), self.temp("args"), self.temp("ok")
            self.add({pairs: F.when(done, tx.url_pairs(raw))})
            valid = F.coalesce(tx.url_pairs_valid(q(pairs)), F.lit(True))
            self.add({fine: valid if good is None else q(good) & valid})
            good = fine
            done = matched & q(good)
            if not node.urlargs_nested:
                merged = self.temp("argmap")
                self.add({merged: F.when(done, tx.url_map(q(pairs)))})
                self.add({"__nulls": F.coalesce(F.exists(F.map_values(q(merged)), lambda v: v.isNull()), F.lit(False))})
                self.merge(node.urlargs, merged)
        for rule in node.replace:
            if rule.get("field") in self.present:
                fld = rule["field"]
                new = F.regexp_replace(self.value(fld), rule["regex"], rule["replacement"])
                self.write({fld: new}, done)
        if node.srctime and node.srctime[0] in self.present:
            millis = parse_millis(self.value(node.srctime[0]), node.srctime[1]).cast("string")
            target = "src_logts_timestamp"
            self.write({target: F.coalesce(millis, self.value(target))}, done)
        return None if good is None else q(good)

    def merge(self, raw_field: str, found: str) -> None:
        """Replace the raw field by the keys of a map column (NULL where nothing is
        to be merged); unknown keys go to ``extra``.
        """
        known = list(self.types)

        def merged(k: str) -> Column:
            # A key may hold NULL, which overwrites too; only then look at the keys.
            # Spelled as SQL: one call per field keeps wide schemas quick to build.
            key = "'" + k.replace("\\", "\\\\").replace("'", "\\'") + "'"
            old = f"`__v_{k}`" if k in self.present else "CAST(NULL AS STRING)"
            after = old if k != raw_field else "CAST(NULL AS STRING)"
            return F.expr(
                f"CASE WHEN {found} IS NULL THEN {old} "
                f"WHEN __nulls AND map_contains_key({found}, {key}) THEN {found}[{key}] "
                f"ELSE coalesce(try_element_at({found}, {key}), {after}) END"
            )

        unknown = F.map_filter(q(found), lambda k, _: ~k.isin(known))
        if self.extra:
            older = F.map_filter(q("__extra"), lambda k, _: ~F.map_contains_key(q(found), k))
            extra = F.when(q(found).isNotNull(), F.map_concat(older, unknown)).otherwise(q("__extra"))
        else:
            extra = F.coalesce(unknown, F.create_map().cast(_MAP))
            self.extra = True
        names = {raw_field: None, **dict.fromkeys(known)}
        self.add({**{"__v_" + k: merged(k) for k in names}, "__extra": extra})
        self.present |= set(names)

    # -- result ------------------------------------------------------------
    def seal(self, flags: bool) -> None:
        """End the fold with a generator of exactly one row.

        Catalyst moves filters below projections, and traces join keys through
        them, by copying the projected expressions. Across this fold that would run
        every regex again and nest copies in copies, until planning takes longer
        than the work. Nothing is traced through the output of a generator, while
        filters on carried columns (a partition, say) still reach the scan.
        """
        kept = ["__v_" + f for f in sorted(self.present)] + ["__path"]
        kept += ["__extra"] if self.extra else []
        values = [q(c) for c in kept]
        values += [v.alias(n) for n, v in self.flag_values.items()] if flags else []
        row = F.explode(F.array(F.struct(*values))).alias("__row")
        sealed = self.df.select(*[q(c) for c in self.carried], row)
        self.df = sealed.select(*[q(c) for c in self.carried], "__row.*")

    def result(self, flags: bool) -> DataFrame:
        self.seal(flags)
        path = F.when(F.size(q("__path")) > 0, q("__path")).otherwise(F.array(F.lit(ROOT_TYPE)))
        bad: list[tuple[str, Column, Column]] = []
        columns = [q(c) for c in self.carried]
        columns += [F.element_at(path, -1).alias("event_type"), path.alias("match_path")]
        for fld, kind in {"data": "string", **self.types}.items():
            raw = self.value(fld)
            typed = typed_value(raw, kind)
            columns.append(typed.alias(fld))
            if kind != "string" and fld in self.present:
                bad.append((fld, raw, raw.isNotNull() & typed.isNull()))
        if self.extra:
            columns.append(q("__extra").alias("extra"))
        if bad:
            entries = F.array(*[F.struct(F.lit(f).alias("k"), F.when(failed, raw).alias("v")) for f, raw, failed in bad])
            some = bad[0][2]
            for _, _, failed in bad[1:]:
                some = some | failed
            kept = F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))
            columns.append(F.when(some, kept).otherwise(F.create_map().cast(_MAP)).alias("_bad_fields"))
        if flags:
            columns += [q(f.column) for f in self.flags]
        return self.df.select(*columns)


def typed_value(raw: Column, kind: str) -> Column:
    """Captured text as a declared type; NULL when it is not one."""
    if kind in ("int", "long"):
        # A cast would trim blanks, which are not part of a number here.
        solid = (F.ascii(raw) > 32) & (F.ascii(F.substring(raw, -1, 1)) > 32)
        return F.when(solid, raw).try_cast(SPARK_TYPES[kind])
    if kind in ("float", "double"):
        return raw.try_cast(SPARK_TYPES[kind])
    if kind in ("jsonmap", "map"):
        return F.from_json(raw, _MAP)
    if kind == "urlargsmap":
        pairs = tx.url_pairs(raw)
        return F.when(tx.url_pairs_valid(pairs), tx.url_map(pairs))
    return raw


def _run(df: DataFrame, patterns: PatternSet, line: str, flags: bool) -> tuple[DataFrame, list[Flag]]:
    fold = _Fold(df, patterns, line)
    fold.level(patterns.roots, F.lit(True), ())
    return fold.result(flags), fold.flags


def parse(
    df: DataFrame,
    patterns: PatternSet,
    line: str = "data",
    keep_matches: bool = True,
    remove_raw: bool = False,
    event_clock: bool = True,
) -> DataFrame:
    """Parse the text column ``line`` of a batch or streaming frame.

    Adds ``event_type`` (the most specific type), ``match_path``, one column per
    field, ``extra`` (merged keys nobody declared), ``_bad_fields`` (raw text of
    failed casts) and, when the prefix time is known, ``logts_timestamp``. Other
    columns are carried along.
    """
    parsed, _ = _run(df, patterns, line, flags=False)
    if event_clock and "logts" in parsed.columns and "logts_timestamp" not in parsed.columns:
        parsed = parsed.withColumn("logts_timestamp", event_time_millis(F.col("logts")))
    unwanted = ([] if keep_matches else ["match_path"]) + (["data"] if remove_raw else [])
    return parsed.drop(*unwanted)


def parse_stats(df: DataFrame, patterns: PatternSet, line: str = "data") -> DataFrame:
    """(event_type, matchcount, matches, nonmatches, desercount) of a batch.

    One wide partial aggregation of boolean flags, unfolded to rows at the end.
    """
    parsed, flags = _run(df, patterns, line, flags=True)
    counts: dict[str, list[tuple[str, str]]] = {}
    sums = []
    for flag in flags:
        alias = f"n{len(sums)}"
        sums.append(F.count_if(q(flag.column)).alias(alias))
        counts.setdefault(flag.event_type, []).append((flag.counter, alias))
    total = parsed.agg(*sums)

    def add(pairs: list[tuple[str, str]], counter: str) -> Column:
        out = F.lit(0).cast("bigint")
        for name, alias in pairs:
            if name == counter:
                out = out + F.col(alias)
        return out

    rows = [
        F.struct(
            F.lit(name).alias("event_type"),
            add(pairs, "matched").alias("matchcount"),
            add(pairs, "matched").alias("matches"),
            (add(pairs, "tried") - add(pairs, "matched")).alias("nonmatches"),
            add(pairs, "desercount").alias("desercount"),
        )
        for name, pairs in counts.items()
    ]
    return total.select(F.inline(F.array(*rows)))


def events_of(df: DataFrame, patterns: PatternSet, event_type: str) -> DataFrame:
    """The view of one type: rows of it and its descendants, with its own field types."""
    visible = patterns.fields_of(event_type)
    united = patterns.field_types()
    view = df.filter(F.col("event_type").isin(patterns.family(event_type)))
    recast = {
        f: typed_value(q(f), kind)
        for f, kind in visible.items()
        if kind != "string" and united[f] == "string" and f in df.columns
    }
    return view.withColumns(recast) if recast else view


def parse_inputs(
    inputs: dict[str, DataFrame],
    default: PatternSet,
    parsers: dict[str, PatternSet] | None = None,
    line: str = "data",
) -> DataFrame:
    """Several inputs, each with its own patterns or the default ones, as one stream."""
    out: DataFrame | None = None
    for name, df in inputs.items():
        one = parse(df, (parsers or {}).get(name, default), line).withColumn("input", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no inputs given")
    return out
