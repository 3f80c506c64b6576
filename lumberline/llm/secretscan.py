"""Secret scanning behind a trigram index.

From each rule's regular expression a Boolean query over trigrams is derived: every match
contains all trigrams of at least one alternative. The index has a posting for each
document and each trigram that a rule asks for; a rule's postings are intersected, and
only its candidate documents are searched. A rule without mandatory trigrams searches
all documents.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.binding import let
from lumberline.llm.store import unused

MOST_STRINGS = 32
TEXT_BLOCK = 8192  # code points


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``secret`` is the group that must have at least ``least`` characters."""

    kind: str
    pattern: str
    secret: int = 0
    least: int = 0
    base: bool = False


# The base rules, then common credential formats.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _strings(node) -> set[str] | None:
    """All strings that a piece of a pattern matches, if there are few; else None."""
    kind, value = node
    if kind is op.LITERAL:
        return {chr(value).lower()}
    if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= MOST_STRINGS:
        return {chr(c).lower() for _, c in value}
    if kind is op.SUBPATTERN:
        return _sequence_strings(value[3])
    if kind is op.BRANCH:
        parts = [_sequence_strings(x) for x in value[1]]
        return None if None in parts else set().union(*parts)
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[1] is not op.MAXREPEAT and value[1] <= 8:
        inner = _sequence_strings(value[2])
        if inner is not None:
            out = {"".join(p) for n in range(value[0], value[1] + 1) for p in product(inner, repeat=n)} if len(inner) ** value[1] <= MOST_STRINGS else None
            return out
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _clauses(nodes) -> list[set[frozenset[str]]]:
    """What a sequence needs: of each clause, all trigrams of one member."""
    out, run = [], {""}

    def close() -> None:
        need = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
        if frozenset() not in need:
            out.append(need)

    for node in nodes:
        part = _strings(node)
        if part is not None and len(run) * len(part) <= MOST_STRINGS:
            run = {a + b for a in run for b in part}
            continue
        close()
        run = part if part is not None and len(part) <= MOST_STRINGS else {""}
        kind, value = node
        if part is None and kind is op.SUBPATTERN:
            out += _clauses(value[3])
        elif part is None and kind in (op.MAX_REPEAT, op.MIN_REPEAT) and value[0] > 0:
            out += _clauses(value[2])
    close()
    return out


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of lower-case trigrams that must all occur; none: no trigram is mandatory."""
    clauses = _clauses(_parser.parse(pattern))
    if not clauses:
        return []
    # The clause with the most trigrams in its weakest member filters best; the others only narrow it.
    clauses.sort(key=lambda c: -min(map(len, c)))
    out = set(clauses[0])
    for clause in clauses[1:]:
        if len(out) * len(clause) <= MOST_STRINGS:
            out = {a | b for a in out for b in clause}
    return sorted((a for a in out if not any(b < a for b in out)), key=sorted)  # what asks for more adds nothing


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index: ``trigram, doc_id`` for each of the trigrams that a document's text holds."""
    text = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(text, F.lit(t)), F.lit(t)) for t in trigrams]))
    return docs.select("doc_id", F.explode(held).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, rules``: the rules (by number) whose trigram query a document satisfies."""
    wanted = [
        {"rule": r, "alternative": a, "need": len(trigrams), "trigram": t}
        for r, rule in enumerate(rules) for a, trigrams in enumerate(trigram_query(rule.pattern)) for t in sorted(trigrams)
    ]
    schema = "array<struct<rule:int,alternative:int,need:int,trigram:string>>"
    table = docs.sparkSession.range(1).select(F.inline(F.from_json(F.lit(json.dumps(wanted)), schema)))
    index = postings(docs.filter("doc_id is not null"), sorted({w["trigram"] for w in wanted}))
    met = index.join(table, "trigram").groupBy("doc_id", "rule", "alternative", "need").agg(F.size(F.collect_set("trigram")).alias("n"))
    return met.filter("n = need").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _found(text: Column, number: int, rule: Rule) -> Column:
    """Spans of one rule: leftmost matches that do not overlap, without those that are too short.

    Places follow from the lengths of the matches and of what is between them.
    """
    pattern = rule.pattern
    if rule.least and not rule.secret and re.fullmatch(r"(\w*)\[[^]]+\]\+", pattern):
        # One run of a class, perhaps after fixed letters: the length may be asked for at once.
        fixed = len(re.match(r"\w*", pattern)[0])
        pattern = f"{pattern[:-1]}{{{rule.least - fixed},}}"
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.secret)) if rule.secret else whole
    between = F.split(text, pattern, -1)
    lengths = F.zip_with(between, whole, lambda a, b: F.length(a) + F.coalesce(F.length(b), F.lit(0)))

    def span(begin: Column, x: Column) -> Column:
        start = begin + F.length(x["between"])
        end = start + F.length(x["whole"])
        good = x["whole"].isNotNull() & (F.length(x["secret"]) >= rule.least)
        return F.when(good, F.struct(start.alias("start"), F.lit(number).alias("number"), end.alias("end")))

    parts = F.arrays_zip(between.alias("between"), whole.alias("whole"), secret.alias("secret"))
    return F.when(text.rlike(pattern), F.array_compact(F.zip_with(earlier(lengths, lambda a, b: a + b), parts, span)))


def earlier(values: Column, combine: Callable[[Column, Column], Column], block: int = 512) -> Column:
    """For each of some whole numbers, ``combine`` (a sum, a maximum) of 0 and those before it.

    An array that grows in a fold is copied at each step; here that happens in blocks
    only, which are then shifted by what is before them.
    """
    zero = F.struct(F.lit(0).alias("last"), F.expr("cast(array() as array<int>)").alias("out"))

    def fold(parts: Column, number: Callable[[Column], Column]) -> Column:
        def step(acc: Column, x: Column) -> Column:
            return F.struct(combine(acc["last"], number(x)).alias("last"), F.concat(acc["out"], F.array(acc["last"])).alias("out"))

        return F.aggregate(parts, zero, step)

    def shifted(local: Column) -> Column:
        bases = fold(local, lambda x: x["last"])["out"]
        return F.flatten(F.zip_with(local, bases, lambda x, base: F.transform(x["out"], lambda v: combine(base, v))))

    def of(values: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / block), F.lit(0)).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(values, b * block + 1, F.lit(block)))
        return let(F.transform(blocks, lambda x: fold(x, lambda v: v)), shifted)

    return let(values, of)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """Adds ``name``: array of (start, number of the rule, end) in code points, in that order.

    Keeps all other columns; a NULL or empty text has none. Rows with a NULL id are
    searched by all rules; rows that share an id share their candidate rules.
    """
    docs = docs.drop(name)
    text, of, rules_of = (unused(docs, x) for x in ("text_", "of_id", "of_rules"))
    mine = docs.withColumn(text, F.coalesce(F.col("text").cast("string"), F.lit("")))
    index = candidates(mine.select(F.col("doc_id").alias("doc_id"), F.col(text).alias("text")), rules)
    index = index.withColumnsRenamed({"doc_id": of, "rules": rules_of})
    found = mine.join(index, mine["doc_id"] == index[of], "left")
    none = F.expr("cast(array() as array<struct<start:int,number:int,end:int>>)")
    spans = []
    for number, rule in enumerate(rules):
        asked = F.coalesce(F.array_contains(rules_of, number), F.col("doc_id").isNull()) if trigram_query(rule.pattern) else F.lit(True)
        spans.append(F.coalesce(F.when(asked, _found(F.col(text), number, rule)), none))
    return found.withColumn(name, F.array_sort(F.concat(*spans))).drop(text, of, rules_of)


def _listed(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["number"]], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the base rules' spans, and all spans as text."""
    found = secret_spans(docs.select("doc_id", "text"), rules)
    base = F.filter("secrets", lambda s: s["number"].isin([i for i, r in enumerate(rules) if r.base]))

    def count(number: int) -> Column:
        return F.size(F.filter("secrets", lambda s: s["number"] == number)).cast("bigint")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(rules) if r.base]
    return found.select("doc_id", *counts, F.sha2(_listed(base, rules), 256).alias("base_sha256"), _listed(F.col("secrets"), rules).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each secret span (overlapping ones together) replaced by ``mask``; all columns stay."""
    name = unused(docs, "secrets")
    found = secret_spans(docs, rules, name)
    text, spans = F.col("text").cast("string"), F.col(name)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))

    def masked(blocks: Column) -> Column:
        def part(begin: Column, end: Column) -> Column:
            """The text from ``begin`` to ``end``; a place is sought in its block only."""
            first, last = F.floor(begin / TEXT_BLOCK).cast("int"), F.floor(end / TEXT_BLOCK).cast("int")
            inside = F.substring(F.get(blocks, first), begin % TEXT_BLOCK + 1, end - begin)
            middle = F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
            tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % TEXT_BLOCK), F.lit(""))
            across = F.concat(F.substring(F.get(blocks, first), begin % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK)), middle, tail)
            return F.coalesce(F.when(end > begin, F.when(first == last, inside).otherwise(across)), F.lit(""))

        def write(done: Column, s: Column) -> Column:
            return F.when(s["start"] >= done, F.concat(part(done, s["start"]), F.lit(mask)))  # else inside an earlier mask

        reached = earlier(F.transform(spans, lambda s: s["end"]), F.greatest)
        rest = part(F.array_max(F.transform(spans, lambda s: s["end"])), F.length(text))
        return F.array_join(F.concat(F.zip_with(reached, spans, write), F.array(rest)), "")

    return found.withColumn("text", F.when(F.size(spans) > 0, let(blocks, masked)).otherwise(text)).drop(name).select(*docs.columns)
