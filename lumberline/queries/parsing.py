"""Queries over parsed lines: one per parser feature."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumberline.functions import text as tx
from lumberline.functions.times import event_time_millis
from lumberline.plans.parse import events_of, parse, parse_inputs, parse_stats
from lumberline.plans.patterns import PatternSet
from lumberline.sources.lines import spread
from lumberline.queries.base import (
    APP,
    APP_TYPES,
    LINES,
    PARTS,
    events,
    line_of,
    line_sql,
    log_lines,
    query,
    table,
)


def path_text():
    return F.array_join("match_path", ">").alias("path")


def document_lines(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("data"))


@query("grok_extract", f"WITH {PARTS} SELECT pid, host, logts, body AS data FROM parts")
def grok_extract(spark, sf_dir):
    parsed = parse(log_lines(spark, sf_dir), PatternSet())
    return parsed.select("pid", "host", "logts", "data")


@query(
    "grok_register",
    f"WITH {LINES} SELECT split_part(line, chr(9), 3) AS pid, user_id, event_type AS action FROM lines",
)
def grok_register(spark, sf_dir):
    patterns = PatternSet(
        [{"name": "referred", "parent": "logevents", "pattern": "%{WHO} %{WHAT} .*", "fields": {"user_id": "long"}}],
        grok={"WHO": "user=%{INT:user_id}", "WHAT": "action=%{WORD:action}"},
    )
    return parse(log_lines(spark, sf_dir), patterns).select("pid", "user_id", "action")


_SYSLOG = "strftime(ts, '%b') || ' ' || lpad(CAST(day(ts) AS VARCHAR), 2, ' ') || strftime(ts, ' %H:%M:%S')"


@query(
    "grok_system_log",
    f"""SELECT {_SYSLOG} AS timestamp, 'web-' || (user_id % 5) AS logsource, event_type AS program, CASE WHEN event_id % 2 = 0 THEN CAST(event_id + 1 AS VARCHAR) END AS pid,
               CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 8 AS VARCHAR) END AS facility, 'value ' || user_id AS message FROM events""",
)
def grok_system_log(spark, sf_dir):
    """System log lines, made from the events, by one of the published names."""
    patterns = PatternSet([{"name": "sys", "pattern": "%{SYSLOGBASE} %{LD:message}"}])
    id_, user = F.col("event_id"), F.col("user_id").cast("string")
    facility = F.when(id_ % 3 == 0, F.concat(F.lit(" <"), (id_ % 8).cast("string"), F.lit(".1>"))).otherwise("")
    pid = F.when(id_ % 2 == 0, F.concat(F.lit("["), (id_ + 1).cast("string"), F.lit("]"))).otherwise("")
    at = F.concat(F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "), F.date_format("ts", " HH:mm:ss"))
    line = F.concat(at, facility, F.lit(" web-"), (F.col("user_id") % 5).cast("string"), F.lit(" "), "action", pid, F.lit(": value "), user)
    parsed = parse(spread(events(spark, sf_dir)).select(line.alias("data")), patterns)
    return parsed.select("timestamp", "logsource", "program", "pid", "facility", "message")


HIERARCHY = PatternSet(
    [
        {"name": "app", "parent": "logevents", "pattern": "user=%{INT:user_id} action=%{WORD:action} %{LD:detail}"},
        {"name": "app_error", "parent": "app", "field": "action", "pattern": "error"},
        {"name": "app_money", "parent": "app", "field": "action", "pattern": "%{WORD:money}", "cond": {"action": "purchase"}},
        {"name": "app_small", "parent": "app_money", "field": "detail", "pattern": r'\{"k": %{INT:k}\}', "cond": {"detail": r".* \d\}"}},
    ]
)


@query(
    "event_type_hierarchy",
    """WITH t AS (SELECT CAST(event_id AS VARCHAR) AS pid, CASE
         WHEN event_type = 'error' THEN 'events>logevents>app>app_error'
         WHEN event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 0 AND 9 THEN 'events>logevents>app>app_money>app_small'
         WHEN event_type = 'purchase' THEN 'events>logevents>app>app_money'
         ELSE 'events>logevents>app' END AS path FROM events)
       SELECT pid, string_split(path, '>')[-1] AS event_type, path FROM t""",
)
def event_type_hierarchy(spark, sf_dir):
    return parse(log_lines(spark, sf_dir), HIERARCHY).select("pid", "event_type", path_text())


@query(
    "pattern_order",
    """SELECT CASE WHEN event_type = 'click' THEN 'early' WHEN event_type IN ('click', 'view') THEN 'unordered' ELSE 'late' END AS event_type,
              count(*) AS n FROM events GROUP BY 1""",
)
def pattern_order(spark, sf_dir):
    patterns = PatternSet(
        [
            {"name": "late", "parent": "logevents", "order": 5, "pattern": ".*"},
            {"name": "unordered", "parent": "logevents", "pattern": ".*action=(click|view) .*"},
            {"name": "early", "parent": "logevents", "order": -1, "pattern": ".*action=click .*"},
        ]
    )
    return parse(log_lines(spark, sf_dir), patterns).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "pattern_cond",
    """SELECT CAST(event_id AS VARCHAR) AS pid, CASE WHEN user_id % 5 IN (0, 1, 2) THEN 'front' ELSE 'logevents' END AS event_type,
              CASE WHEN user_id % 5 IN (0, 1, 2) THEN event_type END AS action FROM events""",
)
def pattern_cond(spark, sf_dir):
    patterns = PatternSet(
        [{"name": "front", "parent": "logevents", "cond": {"host": "host[0-2]"}, "pattern": ".* action=%{WORD:action} .*"}]
    )
    return parse(log_lines(spark, sf_dir), patterns).select("pid", "event_type", "action")


@query(
    "pattern_softcond",
    """SELECT line_no, event_type FROM (
         SELECT event_id AS line_no, CASE WHEN user_id % 5 = 3 THEN 'soft' ELSE 'logevents' END AS event_type FROM events
         UNION ALL SELECT -1 - event_id, 'soft' FROM events)""",
)
def pattern_softcond(spark, sf_dir):
    """Lines with a host must fit it; bare lines have no host and pass."""
    ev = spread(events(spark, sf_dir))
    lines = ev.select(F.col("event_id").alias("line_no"), line_of().alias("data")).unionByName(
        ev.select((-1 - F.col("event_id")).alias("line_no"), F.concat(F.lit("plain "), "action").alias("data"))
    )
    patterns = PatternSet(
        [{"name": "soft", "parent": ["logevents", "events"], "order": 3, "softcond": {"host": "host3"}, "pattern": "%{LD:rest}"}]
    )
    return parse(lines, patterns).select("line_no", "event_type")


@query(
    "source_field",
    "SELECT CAST(event_id AS VARCHAR) AS pid, substr(event_type, 1, 1) AS initial, substr(event_type, 2) AS rest, event_type AS action FROM events",
)
def source_field(spark, sf_dir):
    patterns = PatternSet([APP, {"name": "worded", "parent": "app", "field": "action", "pattern": "(?<initial>.)%{LD:rest}"}])
    return parse(log_lines(spark, sf_dir), patterns).select("pid", "initial", "rest", "action")


@query(
    "pattern_alternatives",
    """SELECT CAST(event_id AS VARCHAR) AS pid, CAST(CASE WHEN event_type = 'view' THEN NULL ELSE user_id END AS INTEGER) AS user_id,
              CASE WHEN event_type = 'view' THEN 'is-view' ELSE event_type END AS action,
              CASE WHEN event_type = 'view' THEN 'events>logevents>alt>alt' ELSE 'events>logevents>alt>alt>alt' END AS path
       FROM events""",
)
def pattern_alternatives(spark, sf_dir):
    """All expressions that match are applied in turn; later captures overwrite."""
    patterns = PatternSet(
        [
            {
                "name": "alt",
                "parent": "logevents",
                "pattern": [
                    ".* action=%{WORD:action} .*",
                    "user=%{INT:user_id} action=(?!view).*",
                    ".*(?<action>is-view|(?<=action=)(?!view)[a-z]+).*",
                ],
            }
        ]
    )
    tagged = spread(events(spark, sf_dir)).select(
        F.when(F.col("action") == "view", F.concat(line_of(), F.lit(" is-view"))).otherwise(line_of()).alias("data")
    )
    return parse(tagged, patterns).select("pid", "user_id", "action", path_text())


@query(
    "optional_patterns",
    """SELECT CAST(event_id AS VARCHAR) AS pid, 'withopt' AS event_type, event_type AS action,
              CASE WHEN event_type = 'error' THEN CAST(json_extract(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def optional_patterns(spark, sf_dir):
    patterns = PatternSet(
        [
            {
                "name": "withopt",
                "parent": "logevents",
                "pattern": ".* action=%{WORD:action} .*",
                "optionalpattern": r'.* action=error .*"k": %{INT:k}\}',
            }
        ]
    )
    return parse(log_lines(spark, sf_dir), patterns).select("pid", "event_type", "action", "k")


@query(
    "typed_fields",
    """SELECT event_id AS pid, CAST(json_extract(props, '$.k') AS FLOAT) AS k_float, CAST(json_extract(props, '$.k') AS DOUBLE) AS k_double,
              TRY_CAST(event_type AS INTEGER) AS action, event_type AS bad_action FROM events""",
)
def typed_fields(spark, sf_dir):
    patterns = PatternSet(
        [
            {
                "name": "typed",
                "parent": "logevents",
                "pattern": [
                    r'.* action=%{WORD:action} \{"k": (?<kf>\d+)\}',
                    r'.* \{"k": (?<kd>\d+)\}',
                ],
                "fields": {"pid": "long", "kf": "float", "kd": "double", "action": "int"},
            }
        ]
    )
    typed = events_of(parse(log_lines(spark, sf_dir), patterns), patterns, "typed")
    return typed.select(
        "pid", F.col("kf").alias("k_float"), F.col("kd").alias("k_double"), "action",
        F.col("_bad_fields")["action"].alias("bad_action"),
    )


@query("auto_int", "SELECT CAST(event_id AS VARCHAR) AS pid, CAST(user_id AS INTEGER) AS user_id, CAST(user_id AS INTEGER) + 1 AS next_user FROM events")
def auto_int(spark, sf_dir):
    patterns = PatternSet([{"name": "numbered", "parent": "logevents", "pattern": "user=%{INT:user_id} .*"}])
    parsed = parse(log_lines(spark, sf_dir), patterns)
    return parsed.select("pid", "user_id", (F.col("user_id") + 1).alias("next_user"))


@query(
    "json_merge",
    """SELECT CAST(event_id AS VARCHAR) AS pid,
              CASE WHEN event_type = 'error' THEN 'fallback' ELSE 'app' END AS event_type,
              CASE WHEN event_type = 'error' THEN 'events>logevents>app>fallback' ELSE 'events>logevents>app' END AS path,
              event_type AS action,
              CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS INTEGER) END AS k,
              CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS why,
              CASE WHEN event_type = 'error' THEN '{broken' END AS props
       FROM events""",
)
def json_merge(spark, sf_dir):
    """Broken JSON leaves its type open for the next sibling; captures survive."""
    ev = spread(events(spark, sf_dir))
    props = F.when(F.col("action") == "error", "{broken").otherwise(
        F.concat(F.regexp_extract("props", r"\A(.*)\}\z", 1), F.lit(', "why": "'), "action", F.lit('"}'))
    )
    patterns = PatternSet([APP, {"name": "fallback", "parent": "logevents", "order": 1, "pattern": "%{LD:rest}"}])
    parsed = parse(ev.select(line_of(props).alias("data")), patterns)
    return parsed.select(
        "pid", "event_type", path_text(), "action", "k", F.try_element_at("extra", F.lit("why")).alias("why"), "props"
    )


@query(
    "json_nested",
    "SELECT CAST(event_id AS VARCHAR) AS pid, json_extract_string(props, '$.k') AS k, event_type AS action FROM events",
)
def json_nested(spark, sf_dir):
    nested = {**APP, "pattern": "user=%{INT:user_id} action=%{WORD:action} %{JSON_NESTED:props}", "fields": {}}
    parsed = parse(log_lines(spark, sf_dir), PatternSet([nested]))
    return parsed.select("pid", F.col("props")["k"].alias("k"), "action")


@query(
    "csv_field",
    """SELECT CAST(event_id AS VARCHAR) AS pid, CAST(event_id AS VARCHAR) AS id, event_type AS what,
              CAST(user_id AS VARCHAR) || ',x' AS quoted_part, '' AS empty_part, CAST(NULL AS VARCHAR) AS missing FROM events""",
)
def csv_field(spark, sf_dir):
    ev = spread(events(spark, sf_dir))
    record = F.concat(F.col("event_id").cast("string"), F.lit(","), "action", F.lit(',"'), F.col("user_id").cast("string"), F.lit(',x",'))
    patterns = PatternSet(
        [
            {
                "name": "csv",
                "parent": "logevents",
                "pattern": "user=[0-9]+ action=[a-z]+ %{CSV:record}",
                "csv-fields": ["id", "what", "quoted-part", "empty-part", "missing"],
            }
        ]
    )
    parsed = parse(ev.select(line_of(record).alias("data")), patterns)
    return parsed.select("pid", "id", "what", "quoted_part", "empty_part", "missing")


URL_TYPES = {"name": "page", "pattern": r"https?://[^?]*\?%{URLARGS:args}", "fields": {"page": "int", "ref": "string", "utm_source": "string"}}
_URL_ARGS = """args AS (SELECT page_id, url, regexp_extract(url, '^https?://[^?]*[?](\\S+)$', 1) AS q FROM pages),
pairs AS (SELECT page_id, url, q, unnest(string_split(q, '&')) AS pair, generate_subscripts(string_split(q, '&'), 1) AS pos FROM args WHERE q <> ''),
kv AS (SELECT page_id, pos, CASE WHEN strpos(pair, '=') > 1 THEN split_part(pair, '=', 1) ELSE pair END AS k,
  CASE WHEN strpos(pair, '=') > 1 AND length(pair) > strpos(pair, '=') THEN url_decode(replace(substr(pair, strpos(pair, '=') + 1), '+', ' ')) END AS v FROM pairs)"""


def _url_value(key: str) -> str:
    return f"(SELECT arg_max(v, pos) FROM kv WHERE kv.page_id = p.page_id AND k = '{key}')"


@query(
    "urlargs_merge",
    f"""WITH {_URL_ARGS} SELECT p.page_id, CASE WHEN q <> '' THEN 'page' ELSE 'events' END AS event_type,
        CAST({_url_value('page')} AS INTEGER) AS page, {_url_value('ref')} AS ref, {_url_value('utm_source')} AS utm_source FROM args p""",
)
def urlargs_merge(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return parse(pages, PatternSet([URL_TYPES]), line="url").select("page_id", "event_type", "page", "ref", "utm_source")


@query(
    "urlargs_nested",
    f"""WITH {_URL_ARGS} SELECT p.page_id, {_url_value('page')} AS page, {_url_value('ref')} AS ref,
        (SELECT CAST(count(DISTINCT k) AS INTEGER) FROM kv WHERE kv.page_id = p.page_id) AS n_keys FROM args p WHERE q <> ''""",
)
def urlargs_nested(spark, sf_dir):
    nested = {"name": "page", "pattern": r"https?://[^?]*\?%{URLARGS_NESTED:args}"}
    patterns = PatternSet([nested])
    parsed = events_of(parse(table(spark, sf_dir, "pages").select("page_id", "url"), patterns, line="url"), patterns, "page")
    args = F.col("args")
    return parsed.select("page_id", args["page"].alias("page"), args["ref"].alias("ref"), F.size(args).alias("n_keys"))


@query(
    "urlargs_multi",
    f"""WITH {_URL_ARGS}, kv2 AS (SELECT page_id, k, v, pos, 0 AS turn FROM kv UNION ALL SELECT page_id, k, v, pos, 1 FROM kv)
        SELECT page_id, k AS name, string_agg(coalesce(v, ''), '|' ORDER BY turn, pos) AS joined, count(*) AS n FROM kv2 GROUP BY page_id, k""",
)
def urlargs_multi(spark, sf_dir):
    """Each argument list is written twice, so that every key has several values."""
    pages = table(spark, sf_dir, "pages")
    args = F.regexp_extract("url", r"^https?://[^?]*\?(\S+)$", 1)
    doubled = pages.filter(args != "").select("page_id", F.concat(args, F.lit("&"), args).alias("args"))
    multi = doubled.select("page_id", F.explode(tx.url_multi_map(tx.url_pairs(F.col("args")))).alias("name", "found"))
    joined = F.array_join(F.transform("found", lambda v: F.coalesce(v, F.lit(""))), "|")
    return multi.select("page_id", "name", joined.alias("joined"), F.size("found").cast("bigint").alias("n"))


@query(
    "field_replace",
    "SELECT CAST(event_id AS VARCHAR) AS pid, 'node-' || (user_id % 5) AS host, regexp_replace(event_type, '([aeiou])', '<\\1>', 'g') AS action FROM events",
)
def field_replace(spark, sf_dir):
    spec = {
        **APP,
        "replace": [
            {"field": "host", "regex": "^host([0-9]+)$", "replacement": "node-$1"},
            {"field": "action", "regex": "([aeiou])", "replacement": "<$1>"},
        ],
    }
    return parse(log_lines(spark, sf_dir), PatternSet([spec])).select("pid", "host", "action")


@query(
    "src_time",
    """SELECT CAST(event_id AS VARCHAR) AS pid, CASE WHEN event_type = 'error' THEN NULL ELSE epoch_ms(date_trunc('second', ts)) - 7200000 END AS src_logts_timestamp
       FROM events""",
)
def src_time(spark, sf_dir):
    """A second timestamp inside the line, two hours east; error lines hold none."""
    ev = spread(events(spark, sf_dir))
    stamp = F.when(F.col("action") == "error", "never").otherwise(
        F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0200"))
    )
    patterns = PatternSet(
        [
            {
                "name": "stamped",
                "parent": "logevents",
                "pattern": r"user=[0-9]+ action=[a-z]+ \[(?<when>[^\]]*)\]",
                "srctime-field": "when",
                "srctime-format": "dd/MMM/yyyy:HH:mm:ss Z",
            }
        ]
    )
    lines = ev.select(line_of(F.concat(F.lit("["), stamp, F.lit("]"))).alias("data"))
    return parse(lines, patterns).select("pid", "src_logts_timestamp")


@query("event_time", "SELECT CAST(event_id AS VARCHAR) AS pid, epoch_ms(date_trunc('second', ts)) AS logts_timestamp FROM events")
def event_time(spark, sf_dir):
    return parse(log_lines(spark, sf_dir), PatternSet()).select("pid", "logts_timestamp")


@query(
    "event_time_compat",
    """SELECT CAST(event_id AS VARCHAR) AS pid,
              epoch_ms(date_trunc('second', ts)) - CASE WHEN extract('hour' FROM ts) = 12 THEN 43200000 ELSE 0 END AS logts_timestamp FROM events""",
)
def event_time_compat(spark, sf_dir):
    """The 12-hour reading of the prefix time, for those who need its quirk."""
    parsed = parse(log_lines(spark, sf_dir), PatternSet(), event_clock=False)
    return parsed.select("pid", event_time_millis(F.col("logts"), compat_hh=True).alias("logts_timestamp"))


@query("remove_raw", f"WITH {PARTS} SELECT pid, host, 0 AS has_data FROM parts")
def remove_raw(spark, sf_dir):
    parsed = parse(log_lines(spark, sf_dir), PatternSet(), remove_raw=True)
    held = F.to_json(F.struct(*parsed.columns))
    return parsed.select("pid", "host", held.rlike('"data":|user=').cast("int").alias("has_data"))


@query(
    "keep_matches",
    "SELECT CAST(event_id AS VARCHAR) AS pid, 'events>logevents>app' AS path, CAST(3 AS INTEGER) AS depth FROM events",
)
def keep_matches(spark, sf_dir):
    parsed = parse(log_lines(spark, sf_dir), APP_TYPES, keep_matches=True)
    return parsed.select("pid", path_text(), F.size("match_path").alias("depth"))


@query("prune_event_types", "SELECT 'logevents' AS event_type, count(*) AS n, CAST(2 AS INTEGER) AS n_types FROM events")
def prune_event_types(spark, sf_dir):
    patterns = PatternSet([APP, {"name": "other", "pattern": "%{LD:rest}"}], event_types="logevents")
    counted = parse(log_lines(spark, sf_dir), patterns).groupBy("event_type").agg(F.count("*").alias("n"))
    return counted.withColumn("n_types", F.lit(len(patterns.nodes)))


@query(
    "type_view",
    """SELECT CAST(event_id AS VARCHAR) AS pid, CASE WHEN event_type = 'purchase' AND CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 0 AND 9
                THEN 'app_small' ELSE 'app_money' END AS event_type FROM events WHERE event_type = 'purchase'""",
)
def type_view(spark, sf_dir):
    parsed = parse(log_lines(spark, sf_dir), HIERARCHY)
    return events_of(parsed, HIERARCHY, "app_money").select("pid", "event_type")


@query(
    "default_type",
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
       SELECT 'events' AS event_type, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM l""",
)
def default_type(spark, sf_dir):
    parsed = parse(document_lines(spark, sf_dir), APP_TYPES)
    return parsed.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("n_chars"))


@query(
    "parse_stats",
    """WITH l AS (SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)), e AS (SELECT count(*) AS n FROM events)
       SELECT t.event_type, CAST(t.hit AS BIGINT) AS matchcount, CAST(t.hit AS BIGINT) AS matches, CAST(t.miss AS BIGINT) AS nonmatches, CAST(t.deser AS BIGINT) AS desercount
       FROM (SELECT 'events' AS event_type, l.n + e.n AS hit, 0 AS miss, 0 AS deser FROM l, e
             UNION ALL SELECT 'logevents', e.n, l.n, 0 FROM l, e
             UNION ALL SELECT 'app', e.n, 0, e.n FROM e) t""",
)
def parse_stats_query(spark, sf_dir):
    lines = log_lines(spark, sf_dir).unionByName(document_lines(spark, sf_dir).select("data"))
    return parse_stats(lines, APP_TYPES)


@query(
    "input_parsers",
    """WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
       SELECT 'app' AS input, 'app' AS event_type, count(*) AS n FROM events
       UNION ALL SELECT 'docs', CASE WHEN length(regexp_replace(line, '[^ ]', '', 'g')) > 0 THEN 'words' ELSE 'events' END, count(*) FROM l GROUP BY 2""",
)
def input_parsers(spark, sf_dir):
    docs = PatternSet([{"name": "words", "pattern": "(?<head>[^ ]*) (?<tail>.*)"}])
    parsed = parse_inputs(
        {"app": log_lines(spark, sf_dir), "docs": document_lines(spark, sf_dir).select("data")},
        default=APP_TYPES,
        parsers={"docs": docs},
    )
    return parsed.groupBy("input", "event_type").agg(F.count("*").alias("n"))
