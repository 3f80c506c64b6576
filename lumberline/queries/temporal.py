"""Event clock, late data, sequences, contexts, and expression families."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumberline.operators import sequence as sq
from lumberline.operators import windows as wn
from lumberline.plans.parse import events_of, parse
from lumberline.plans.patterns import PatternSet
from lumberline.operators.joins import interval_join_stream
from lumberline.queries.base import APP_TYPES, PASSED, events, events_stream, log_lines, log_lines_stream, query, replayed, table
from lumberline.queries.relational import CENTS, HOUR, SECOND, dbl, side
from lumberline.session import fresh_path
from lumberline.sinks.snapshots import SnapshotStore
from lumberline.streaming import stateful as st
from lumberline.streaming.held import AssembleLines, NamedWindow, keep_latest, run_window, stop_window
from lumberline.streaming.patterns import not_followed_by_stream
from lumberline.streaming.runner import drain, drain_batches, from_time, on_event_clock


@query(
    "event_clock",
    """WITH e AS (SELECT date_trunc('second', ts) AS t, event_type FROM events)
       SELECT date_trunc('hour', t) AS window_start, event_type AS action, count(*) AS n FROM e
       GROUP BY 1, 2 HAVING date_trunc('hour', any_value(t)) + INTERVAL 1 HOUR <= (SELECT max(t) FROM e)""",
)
def event_clock(spark, sf_dir):
    """Hourly counts on a stream whose clock is the time inside the lines.

    A window is emitted once the clock has passed it, so the last one stays open.
    """
    parsed = events_of(parse(log_lines_stream(spark, sf_dir), APP_TYPES), APP_TYPES, "app")
    counted = wn.time_batch(on_event_clock(parsed), ["action"], "event_time", "1 hour", [F.count("*").alias("n")])
    out = drain(spark, counted, "clock")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "action", "n")


_ARRIVAL = "epoch_us(ts) + ((event_id * 7919) % 600) * 1000000"


@query(
    "late_data",
    f"""WITH a AS (SELECT event_id, epoch_us(ts) AS t, {_ARRIVAL} AS arrival FROM events)
        SELECT event_id, max(t) OVER w AS clock_us, max(t) OVER w - t AS late_us FROM a WINDOW w AS (ORDER BY arrival, event_id ROWS UNBOUNDED PRECEDING)""",
)
def late_data(spark, sf_dir):
    """Events in arrival order; each is evaluated at the clock it meets, none is lost."""
    late = (F.col("event_id") * 7919) % 600 * SECOND
    arrived = events(spark, sf_dir).withColumn("arrival", F.col("ts_us") + late)
    out = sq.clocked(arrived, "arrival", "ts_us", tie=["event_id"])
    return out.select("event_id", "clock_us", (F.col("clock_us") - F.col("ts_us")).alias("late_us"))


@query(
    "initial_time",
    "SELECT CAST(event_id AS VARCHAR) AS pid, epoch_ms(date_trunc('second', ts)) AS logts_timestamp FROM events WHERE epoch_ms(date_trunc('second', ts)) >= 1705276800000",
)
def initial_time(spark, sf_dir):
    parsed = parse(log_lines(spark, sf_dir), PatternSet())
    return from_time(parsed, 1705276800000).select("pid", "logts_timestamp")


@query(
    "on_demand_query",
    "WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS action FROM events GROUP BY 1) SELECT action, count(*) AS users FROM l GROUP BY 1",
)
def on_demand_query(spark, sf_dir):
    """Ad-hoc SQL over the saved contents of a window."""
    store = SnapshotStore(spark, fresh_path(spark, "ondemand"))
    latest = wn.latest_per_key(events(spark, sf_dir), ["user_id"], "event_id").select("user_id", "action")
    store.save("last_action", latest, version=1)
    store.restore("last_action", latest.schema).createOrReplaceTempView("last_action")
    return spark.sql("SELECT action, count(*) AS users FROM last_action GROUP BY action")


_ITEM = "'  item ' || l_linenumber || ' part ' || l_partkey || ' qty ' || CAST(l_quantity AS INTEGER)"


def _order_lines(spark, sf_dir):
    heads = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("bigint").alias("position"), F.lit(0).cast("bigint").alias("line"), F.lit(0).cast("bigint").alias("part"),
        F.concat(F.lit("ORDER "), F.col("o_orderkey").cast("string"), F.lit(" "), "o_orderstatus").alias("text"),
    )
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("bigint").alias("position"), F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_partkey").cast("bigint").alias("part"),
        F.concat(
            F.lit("  item "), F.col("l_linenumber").cast("string"), F.lit(" part "), F.col("l_partkey").cast("string"),
            F.lit(" qty "), F.col("l_quantity").cast("int").cast("string"),
        ).alias("text"),
    )
    return heads.unionByName(items)


@query(
    "multiline_assembly",
    f"""WITH lines AS (SELECT CAST(o_orderkey AS BIGINT) AS k, 0 AS line, 0 AS part, 'ORDER ' || o_orderkey || ' ' || o_orderstatus AS text FROM orders
              UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, {_ITEM} FROM lineitem),
            entries AS (SELECT *, sum(CASE WHEN starts_with(text, 'ORDER ') THEN 1 ELSE 0 END) OVER (ORDER BY k, line, part, text ROWS UNBOUNDED PRECEDING) AS entry FROM lines)
       SELECT min(k) AS first_position, count(*)::INTEGER AS n_lines, string_agg(text, chr(10) ORDER BY k, line, part, text) AS text FROM entries GROUP BY entry""",
)
def multiline_assembly(spark, sf_dir):
    """Order headers followed by their items, as one long file without any key."""
    out = sq.assemble_lines(
        _order_lines(spark, sf_dir), [], "position", "text", F.col("text").startswith("ORDER "), tie=["line", "part"]
    )
    return out.select("first_position", "n_lines", "text")


@query(
    "sequence_within",
    """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT event_id AS next_id, user_id, ts FROM events WHERE event_type = 'purchase'),
            j AS (SELECT a.event_id, arg_min(b.next_id, b.ts) AS next_id FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND epoch_us(b.ts) < epoch_us(a.ts) + 18000000000 GROUP BY 1)
       SELECT event_id, next_id FROM j""",
)
def sequence_within(spark, sf_dir):
    ev = events(spark, sf_dir)
    views = side(ev, "view", event_id="event_id", u="user_id", a_us="ts_us")
    bought = side(ev, "purchase", next_id="event_id", v="user_id", b_us="ts_us")
    return sq.followed_by(views, bought, [("u", "v")], "a_us", "b_us", 5 * HOUR, ["next_id"]).select("event_id", "next_id")


@query(
    "absence_within",
    """SELECT a.event_id FROM events a WHERE a.event_type = 'signup' AND a.ts + INTERVAL 2 DAY <= (SELECT max(ts) FROM events)
       AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 2 DAY)""",
)
def absence_within(spark, sf_dir):
    """Signups with no purchase within two days, once the clock has passed the wait."""
    ev = events(spark, sf_dir)
    clock = ev.agg(F.max("ts_us")).scalar()
    signups = side(ev, "signup", event_id="event_id", u="user_id", a_us="ts_us")
    bought = side(ev, "purchase", v="user_id", b_us="ts_us")
    return sq.not_followed_by(signups, bought, [("u", "v")], "a_us", "b_us", 48 * HOUR, clock).select("event_id")


@query(
    "match_sequence",
    """WITH s AS (SELECT event_id, user_id, substr(event_type, 1, 1) AS c0, lead(substr(event_type, 1, 1), 1) OVER w AS c1, lead(substr(event_type, 1, 1), 2) OVER w AS c2, lead(substr(event_type, 1, 1), 3) OVER w AS c3,
              lead(event_id, 2) OVER w AS e2, lead(event_id, 3) OVER w AS e3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
       SELECT user_id, event_id, CASE WHEN c2 = 'c' AND c3 = 'p' THEN e3 ELSE e2 END AS last_event_id, CAST(CASE WHEN c2 = 'c' AND c3 = 'p' THEN 4 ELSE 3 END AS INTEGER) AS match_length
       FROM s WHERE c0 = 'v' AND c1 = 'c' AND (c2 = 'p' OR (c2 = 'c' AND c3 = 'p'))""",
)
def match_sequence(spark, sf_dir):
    """view, one or two clicks, purchase: rows in direct succession per user."""
    symbol = F.substring("action", 1, 1)
    out = sq.match_rows(events(spark, sf_dir), ["user_id"], "ts_us", symbol, "vc{1,2}p", 4, "event_id")
    return out.select("user_id", "event_id", "last_event_id", "match_length")


@query(
    "keyed_context",
    """WITH m AS (SELECT *, CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 0 END AS marker FROM events),
            p AS (SELECT *, (SELECT arg_max(b.marker, b.ts) FROM m b WHERE b.user_id = m.user_id AND b.marker IS NOT NULL AND b.ts < m.ts) AS before FROM m),
            o AS (SELECT *, sum(CASE WHEN marker = 1 AND coalesce(before, 0) = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS context FROM p)
       SELECT user_id, CAST(context AS BIGINT) AS context, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
       FROM o WHERE coalesce(before, 0) = 1 OR coalesce(marker, 0) = 1 GROUP BY 1, 2""",
)
def keyed_context(spark, sf_dir):
    """Per user, everything from a signup up to the next purchase."""
    inside = sq.contexts(
        events(spark, sf_dir), ["user_id"], "ts_us", F.col("action") == "signup", F.col("action") == "purchase"
    )
    return inside.groupBy("user_id", "context").agg(
        F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"),
        dbl(F.sum(F.col("value").cast(CENTS)), "total"),
    )


@query(
    "window_upsert",
    """WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS kind, arg_max(value, event_id) AS value FROM events GROUP BY 1)
       SELECT coalesce(c.c_custkey, l.user_id) AS id, CASE WHEN l.user_id IS NULL THEN c.c_mktsegment ELSE l.kind END AS segment, CASE WHEN l.user_id IS NULL THEN c.c_acctbal ELSE l.value END AS amount
       FROM customer c FULL JOIN l ON l.user_id = c.c_custkey WHERE l.kind IS NULL OR l.kind <> 'error'""",
)
def window_upsert(spark, sf_dir):
    """A user's last event replaces the customer row; a last ``error`` deletes it."""
    base = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("amount")
    )
    changes = events(spark, sf_dir).select(
        F.col("user_id").alias("id"), F.col("action").alias("segment"), F.col("value").alias("amount"), "event_id"
    )
    return sq.upsert(base, changes, "id", "event_id", ["segment", "amount"], F.col("segment") == "error")


@query(
    "dedup_stream",
    """SELECT event_id, user_id, event_type AS action FROM events
       QUALIFY coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts) > 86400000000, true)""",
)
def dedup_stream(spark, sf_dir):
    kept = wn.suppress_repeats(events(spark, sf_dir), ["user_id", "action"], "ts_us", 24 * HOUR)
    return kept.select("event_id", "user_id", "action")


@query(
    "parse_and_filter_stream",
    "SELECT CAST(event_id AS VARCHAR) AS pid, 'host' || (user_id % 5) AS host, CAST(user_id AS INTEGER) AS user_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE event_type = 'error'",
)
def parse_and_filter_stream(spark, sf_dir):
    parsed = parse(log_lines_stream(spark, sf_dir), APP_TYPES)
    return drain(spark, parsed.filter("action = 'error'").select("pid", "host", "user_id", "k"), "filtered")


@query(
    "window_join_stream",
    """SELECT a.event_id AS stop_id, b.event_id AS start_id FROM events a JOIN events b ON a.event_type = 'purchase' AND b.event_type = 'signup'
       AND a.user_id = b.user_id AND epoch_us(b.ts) > epoch_us(a.ts) - 21600000000 AND b.ts <= a.ts""",
)
def window_join_stream(spark, sf_dir):
    """The flagship join on two streams; state is kept for the window only."""
    ev = events_stream(spark, sf_dir).withColumn("time", F.col("ts").cast("timestamp"))
    stop = side(ev, "purchase", stop_id="event_id", u="user_id", a_time="time")
    start = side(ev, "signup", start_id="event_id", v="user_id", b_time="time")
    joined = interval_join_stream(stop, start, [("u", "v")], "a_time", "b_time", "6 hours", lateness="1 hour")
    return drain(spark, joined.select("stop_id", "start_id"), "join")


@query(
    "absence_within_stream",
    """SELECT a.event_id FROM events a WHERE a.event_type = 'signup'
       AND a.ts + INTERVAL 2 DAY < (SELECT min(m) FROM (SELECT max(ts) AS m FROM events WHERE event_type = 'signup' UNION ALL SELECT max(ts) FROM events WHERE event_type = 'purchase'))
       AND NOT EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'purchase' AND b.user_id = a.user_id AND b.ts > a.ts AND b.ts < a.ts + INTERVAL 2 DAY)""",
)
def absence_within_stream(spark, sf_dir):
    """The same absence on a stream; it is known once both clocks have passed the wait."""
    ev = events_stream(spark, sf_dir).withColumn("time", F.col("ts").cast("timestamp"))
    signups = side(ev, "signup", event_id="event_id", u="user_id", a_time="time")
    bought = side(ev, "purchase", v="user_id", b_time="time")
    alone = not_followed_by_stream(signups, bought, [("u", "v")], "a_time", "b_time", "2 days")
    return drain(spark, alone.select("event_id"), "absence")


# -- streams with state of their own -------------------------------------------


def _timed(spark, sf_dir, label):
    """The events in four stretches of time, one per micro-batch."""
    timed = events(spark, sf_dir).withColumn("time", F.col("ts").cast("timestamp"))
    return replayed(timed.select("event_id", "user_id", "action", "value", "ts_us", "time"), "ts_us", label)


_SYMBOLS = """SELECT event_id, user_id, substr(event_type, 1, 1) AS c0, lead(substr(event_type, 1, 1), 1) OVER w AS c1, lead(substr(event_type, 1, 1), 2) OVER w AS c2, lead(substr(event_type, 1, 1), 3) OVER w AS c3,
  lead(event_id, 2) OVER w AS e2, lead(event_id, 3) OVER w AS e3 FROM passed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


@query(
    "match_sequence_stream",
    f"""WITH {PASSED}, s AS ({_SYMBOLS})
        SELECT user_id, event_id, CASE WHEN c2 = 'c' AND c3 = 'p' THEN e3 ELSE e2 END AS last_event_id, CAST(CASE WHEN c2 = 'c' AND c3 = 'p' THEN 4 ELSE 3 END AS INTEGER) AS match_length
        FROM s WHERE c0 = 'v' AND c1 = 'c' AND (c2 = 'p' OR (c2 = 'c' AND c3 = 'p'))""",
)
def match_sequence_stream(spark, sf_dir):
    """The row pattern of ``match_sequence`` on a stream of four micro-batches."""
    stream = _timed(spark, sf_dir, "pattern-source")
    found = st.match_rows_stream(stream, ["user_id"], "time", F.substring("action", 1, 1), "vc{1,2}p", 4, "event_id", ["event_id"])
    return drain(spark, found.select("user_id", "event_id", "last_event_id", "match_length"), "pattern")


@query(
    "dedup_previous_stream",
    f"""WITH {PASSED} SELECT event_id, user_id, event_type AS action FROM passed
        QUALIFY coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 86400000000, true)""",
)
def dedup_previous_stream(spark, sf_dir):
    """The rule of ``dedup_stream``, which looks at the previous event, on a stream."""
    stream = _timed(spark, sf_dir, "dedup-source")
    kept = st.suppress_repeats_stream(stream, ["user_id", "action"], "time", 24 * HOUR, ["event_id"], ["event_id"])
    return drain(spark, kept.select("event_id", "user_id", "action"), "dedup")


@query(
    "agg_running_stream",
    f"""WITH {PASSED} SELECT event_id, user_id, row_number() OVER w AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) OVER w AS BIGINT) AS cents, max(value) OVER w AS high, min(value) OVER w AS low
        FROM passed WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""",
)
def agg_running_stream(spark, sf_dir):
    """Each event of a stream with its user's totals so far."""
    cents = F.round(F.col("value") * 100).cast("bigint")
    totals = st.running_totals_stream(
        _timed(spark, sf_dir, "running-source"), ["user_id"], "time", ["event_id"], {"cents": cents}, {"high": F.col("value")}, {"low": F.col("value")}, ["event_id"]
    )
    return drain(spark, totals.select("event_id", "user_id", "n", "cents", "high", "low"), "running")


@query(
    "win_length_stream",
    f"""WITH {PASSED}, o AS (SELECT event_id, user_id, lead(event_id, 5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pushed_by FROM passed)
        SELECT o.event_id, o.user_id, epoch_us(e.ts) AS left_us FROM o JOIN passed e ON e.event_id = o.pushed_by""",
)
def win_length_stream(spark, sf_dir):
    """Events of a stream as they leave the window of their user's last five."""
    gone = st.length_window_stream(_timed(spark, sf_dir, "length-source"), ["user_id"], "time", 5, ["event_id"], ["event_id"])
    return drain(spark, gone.select("event_id", "user_id", "left_us"), "length")


@query(
    "win_expiry_stream",
    "SELECT event_id, ts + INTERVAL 10 DAY AS expires_at FROM events WHERE epoch_us(ts) + 864000000000 <= (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events)",
)
def win_expiry_stream(spark, sf_dir):
    """Events on a stream, each once the clock has passed its ten days."""
    stream = _timed(spark, sf_dir, "expiry-source").select("event_id", "time")
    gone = drain(spark, st.expiries_stream(stream, "time", "10 days"), "expiry")
    return gone.select("event_id", F.col("expires_at").cast("timestamp_ntz").alias("expires_at"))


@query(
    "output_every_stream",
    """WITH e AS (SELECT *, epoch_us(ts) // 86400000000 AS d FROM events), z AS (SELECT max(epoch_us(ts)) // 1000 * 1000 // 86400000000 AS open_d FROM events),
            l AS (SELECT event_type, d, max(event_id) AS event_id, min(event_id) AS first_id FROM e GROUP BY 1, 2), c AS (SELECT * FROM l WHERE d < (SELECT open_d FROM z)),
            g AS (SELECT unnest(range((SELECT min(d) FROM e), (SELECT open_d FROM z))) AS d)
       SELECT 'last' AS mode, event_type AS action, event_id, (d + 1) * 86400000000 AS output_us FROM c
       UNION ALL SELECT 'first', event_type, first_id, (d + 1) * 86400000000 FROM c
       UNION ALL SELECT 'all', event_type, event_id, (d + 1) * 86400000000 FROM e
       UNION ALL SELECT 'snapshot', c.event_type, max(c.event_id), (g.d + 1) * 86400000000 FROM g JOIN c ON c.d <= g.d GROUP BY c.event_type, g.d""",
)
def output_every_stream(spark, sf_dir):
    """Daily output of a stream in its four modes; a day is written once the clock has passed it."""
    stream, out = _timed(spark, sf_dir, "output-source"), None
    for mode in ("last", "first", "all", "snapshot"):
        limited = st.output_every_stream(stream, ["action"], "time", 24 * HOUR, mode, ["event_id"], ["event_id"])
        one = drain(spark, limited, f"output-{mode}").select(F.lit(mode).alias("mode"), "action", "event_id", "output_us")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "multiline_assembly_stream",
    f"""WITH lines AS (SELECT CAST(o_orderkey AS BIGINT) AS k, 0 AS line, 0 AS part, 'ORDER ' || o_orderkey || ' ' || o_orderstatus AS text FROM orders
              UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, {_ITEM} FROM lineitem),
            entries AS (SELECT *, sum(CASE WHEN starts_with(text, 'ORDER ') THEN 1 ELSE 0 END) OVER (ORDER BY k, line, part, text ROWS UNBOUNDED PRECEDING) AS entry FROM lines)
       SELECT min(k) AS first_position, count(*)::INTEGER AS n_lines, string_agg(text, chr(10) ORDER BY k, line, part, text) AS text FROM entries GROUP BY entry""",
)
def multiline_assembly_stream(spark, sf_dir):
    """The long file of ``multiline_assembly`` in four micro-batches, whose borders fall into entries."""
    place = (F.col("position") * 1000 + F.col("line")).alias("place")
    stream = replayed(_order_lines(spark, sf_dir).select(place, "position", "line", "part", "text"), "place", "lines-source")
    base = fresh_path(spark, "lines")
    written = AssembleLines(
        f"{base}/open", [], "place", "text", F.col("text").startswith("ORDER "),
        lambda df, n: df.write.mode("overwrite").parquet(f"{base}/entries/batch={n}"), tie=["part"],
    )
    drain_batches(spark, stream, "lines-run", written)
    written.flush(spark)
    first = ((F.col("first_position") - F.pmod("first_position", F.lit(1000))) / 1000).cast("bigint").alias("first_position")
    return spark.read.parquet(f"{base}/entries").select(first, "n_lines", "text")


@query(
    "snapshot_window_stream",
    "SELECT user_id, arg_max(event_type, event_id) AS action, max(event_id) AS event_id FROM events GROUP BY user_id",
)
def snapshot_window_stream(spark, sf_dir):
    """The last event of each user over a stream that is stopped half-way and begun anew.

    The second run has a checkpoint of its own and starts from the snapshot of the whole
    window that was saved when the first one stopped.
    """
    ev = events(spark, sf_dir).select("user_id", "action", "event_id")
    half = ev.approxQuantile("event_id", [0.5], 0.01)[0] if ev.limit(1).count() else 0
    base = fresh_path(spark, "window")
    store = SnapshotStore(spark, f"{base}/snapshots")
    for run, rows in enumerate((ev.filter(F.col("event_id") < half), ev.filter(F.col("event_id") >= half))):
        window = NamedWindow(store, "latest", f"{base}/held-{run}", ev.schema, keep_latest(["user_id"], "event_id"))
        stream = replayed(rows, "event_id", f"window-source-{run}", parts=2)
        stop_window(run_window(stream, window, f"{base}/checkpoint-{run}", availableNow=True), window, finish=True)
    return store.restore("latest", ev.schema)


# -- expression families -------------------------------------------------------


@query(
    "interval_predicates",
    """SELECT event_id, ts < TIMESTAMP '2024-01-10 00:00:00' AS is_before, ts >= TIMESTAMP '2024-01-20 00:00:00' AS is_after,
              ts >= TIMESTAMP '2024-01-12 00:00:00' AND ts < TIMESTAMP '2024-01-13 00:00:00' AS is_during,
              date_trunc('day', ts) = TIMESTAMP '2024-01-15 00:00:00' AS coincides FROM events""",
)
def interval_predicates(spark, sf_dir):
    def at(day: str):
        return F.lit(f"{day} 00:00:00").cast("timestamp_ntz")

    ts = F.col("ts")
    return events(spark, sf_dir).select(
        "event_id",
        (ts < at("2024-01-10")).alias("is_before"),
        (ts >= at("2024-01-20")).alias("is_after"),
        ((ts >= at("2024-01-12")) & (ts < at("2024-01-13"))).alias("is_during"),
        (F.date_trunc("day", ts) == at("2024-01-15")).alias("coincides"),
    )


@query(
    "datetime_methods",
    """SELECT event_id, CAST(extract('hour' FROM ts) AS INTEGER) AS hour, CAST(extract('day' FROM ts) AS INTEGER) AS day, CAST(isodow(ts) AS INTEGER) AS weekday,
              ts + INTERVAL 90 MINUTE AS later, date_trunc('hour', ts) AS rounded, strftime(ts, '%d.%m.%Y %H:%M') AS shown FROM events""",
)
def datetime_methods(spark, sf_dir):
    ts = F.col("ts")
    return events(spark, sf_dir).select(
        "event_id",
        F.hour(ts).alias("hour"),
        F.dayofmonth(ts).alias("day"),
        (F.weekday(ts) + 1).alias("weekday"),
        (ts + F.expr("INTERVAL 90 MINUTES")).cast("timestamp_ntz").alias("later"),
        F.date_trunc("hour", ts).cast("timestamp_ntz").alias("rounded"),
        F.date_format(ts, "dd.MM.yyyy HH:mm").alias("shown"),
    )


@query(
    "array_enumeration",
    """WITH d AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
       SELECT doc_id, CAST(len(list_filter(words, lambda w: length(w) > 6)) AS INTEGER) AS n_long, len(list_filter(words, lambda w: length(w) > 14)) > 0 AS any_huge,
              len(list_filter(words, lambda w: w = '')) = 0 AS all_filled, CAST(list_sum(list_transform(words, lambda w: length(w))) AS BIGINT) AS total,
              words[1] AS first_word, CAST(list_max(list_transform(words, lambda w: length(w))) AS INTEGER) AS longest FROM d""",
)
def array_enumeration(spark, sf_dir):
    """Collection methods on the words of each document (a collection is one row's)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ", -1).alias("words"))
    zero = F.lit(0).cast("bigint")
    return words.select(
        "doc_id",
        F.size(F.filter("words", lambda w: F.length(w) > 6)).alias("n_long"),
        F.exists("words", lambda w: F.length(w) > 14).alias("any_huge"),
        F.forall("words", lambda w: w != "").alias("all_filled"),
        F.aggregate("words", zero, lambda total, w: total + F.length(w)).alias("total"),
        F.element_at("words", 1).alias("first_word"),
        F.array_max(F.transform("words", lambda w: F.length(w))).alias("longest"),
    )


@query(
    "string_methods",
    """SELECT event_id, upper(event_type) AS upper_case, substr(event_type, 2, 3) AS middle, CAST(length(event_type) AS INTEGER) AS len, replace(event_type, 'i', '!') AS replaced,
              string_split(event_type || '/' || user_id, '/')[2] AS tail, CAST(strpos(event_type, 'r') - 1 AS INTEGER) AS index_of, starts_with(event_type, 'p') AS starts, trim('  ' || event_type || ' ') AS trimmed,
              contains(event_type, 'ie') AS has_ie FROM events""",
)
def string_methods(spark, sf_dir):
    a = F.col("action")
    return events(spark, sf_dir).select(
        "event_id",
        F.upper(a).alias("upper_case"),
        F.substring(a, 2, 3).alias("middle"),
        F.length(a).alias("len"),
        F.replace(a, F.lit("i"), F.lit("!")).alias("replaced"),
        F.split(F.concat(a, F.lit("/"), F.col("user_id").cast("string")), "/")[1].alias("tail"),
        (F.instr(a, "r") - 1).alias("index_of"),
        a.startswith("p").alias("starts"),
        F.trim(F.concat(F.lit("  "), a, F.lit(" "))).alias("trimmed"),
        a.contains("ie").alias("has_ie"),
    )
