"""Projection, filter, joins, aggregates and windows over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumberline.functions.times import micros_to_ntz
from lumberline.operators import aggregates as ag
from lumberline.operators import joins as jn
from lumberline.operators import windows as wn
from lumberline.operators.sequence import split_stream
from lumberline.plans.parse import events_of, parse
from lumberline.queries.base import APP_TYPES, events, events_stream, log_lines, query, table
from lumberline.session import fresh_path, written
from lumberline.sinks.writers import tagged_rows
from lumberline.streaming.patterns import LastValueJoin, both_sides
from lumberline.streaming.runner import drain_batches

SECOND = 1_000_000
HOUR = 3600 * SECOND
CENTS = "decimal(18,2)"


def app_events(spark, sf_dir):
    """Log lines parsed into app events, with the prefix time in microseconds."""
    parsed = events_of(parse(log_lines(spark, sf_dir), APP_TYPES), APP_TYPES, "app")
    return parsed.withColumn("t_us", F.col("logts_timestamp") * 1000)


def money(name: str = "value"):
    return F.col(name).cast(CENTS)


def dbl(expr, name):
    return expr.cast("double").alias(name)


# -- projection and filter ---------------------------------------------------


@query(
    "select_all",
    """SELECT 'app' AS event_type, 'host' || (user_id % 5) AS host, CAST(event_id AS VARCHAR) AS pid, CAST(user_id AS INTEGER) AS user_id,
              event_type AS action, CAST(json_extract(props, '$.k') AS INTEGER) AS k, epoch_ms(date_trunc('second', ts)) AS logts_timestamp FROM events""",
)
def select_all(spark, sf_dir):
    parsed = parse(log_lines(spark, sf_dir), APP_TYPES, keep_matches=False, remove_raw=True)
    return parsed.select("*").drop("extra", "_bad_fields", "srcip", "srcport", "dstip", "dstport", "logts", "props")


@query("select_columns", "SELECT CAST(event_id AS VARCHAR) AS id, event_type AS what FROM events")
def select_columns(spark, sf_dir):
    return app_events(spark, sf_dir).select(F.col("pid").alias("id"), F.col("action").alias("what"))


@query(
    "where_filter",
    "SELECT CAST(event_id AS VARCHAR) AS pid, 'host' || (user_id % 5) AS host FROM events WHERE user_id % 5 = 3 AND CAST(json_extract(props, '$.k') AS INTEGER) = 42",
)
def where_filter(spark, sf_dir):
    return app_events(spark, sf_dir).filter((F.col("host") == "host3") & (F.col("k") == 42)).select("pid", "host")


@query(
    "stream_filter",
    """WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase')
       SELECT a.event_id, count(*) AS recent FROM s a JOIN s b ON b.user_id = a.user_id AND b.t > a.t - 86400000000 AND b.t <= a.t GROUP BY a.event_id""",
)
def stream_filter(spark, sf_dir):
    """The filter inside the source comes before the window, so only purchases count."""
    bought = events(spark, sf_dir).filter("action = 'purchase'")
    return wn.time_sliding(bought, ["user_id"], "ts_us", 24 * HOUR, {"recent": F.count(F.lit(1))}).select("event_id", "recent")


@query(
    "multi_query",
    """SELECT 'starting' AS query, to_json(struct_pack(pid := CAST(event_id AS VARCHAR), action := event_type))::VARCHAR AS value FROM events WHERE event_type = 'signup'
       UNION ALL SELECT 'stopping', to_json(struct_pack(pid := CAST(event_id AS VARCHAR), action := event_type))::VARCHAR FROM events WHERE event_type = 'purchase'""",
)
def multi_query(spark, sf_dir):
    """Two queries over one parse of the log."""
    columns = ["pid", "action"]
    rules = {"starting": (F.col("action") == "signup", columns), "stopping": (F.col("action") == "purchase", columns)}
    return tagged_rows(app_events(spark, sf_dir), rules)


@query(
    "insert_into",
    """WITH big AS (SELECT user_id, value FROM events WHERE value > 20), per AS (SELECT user_id, count(*) AS n FROM big GROUP BY 1)
       SELECT user_id, n FROM per WHERE n > 3""",
)
def insert_into(spark, sf_dir):
    """One derived stream feeds the next."""
    big = events(spark, sf_dir).filter("value > 20").select("user_id", "value")
    per_user = big.groupBy("user_id").agg(F.count("*").alias("n"))
    return per_user.filter("n > 3")


@query("struct_constructor", "SELECT event_id, event_type AS action, user_id + 1 AS next_user FROM events")
def struct_constructor(spark, sf_dir):
    built = events(spark, sf_dir).select(
        "event_id", F.struct(F.col("action"), (F.col("user_id") + 1).alias("next_user")).alias("sub")
    )
    return built.select("event_id", "sub.action", "sub.next_user")


@query("nested_access", "SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none FROM events")
def nested_access(spark, sf_dir):
    nested = events(spark, sf_dir).withColumn("p", F.from_json("props", "map<string,string>"))
    return nested.select("event_id", F.col("p")["k"].alias("k"), F.col("p")["none"].alias("none"))


@query("select_distinct", "SELECT DISTINCT user_id, event_type AS action FROM events")
def select_distinct(spark, sf_dir):
    return events(spark, sf_dir).select("user_id", "action").distinct()


@query(
    "split_stream",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'alerts' WHEN value >= 20 THEN 'large' ELSE 'rest' END AS target FROM events""",
)
def split_stream_query(spark, sf_dir):
    routes = {"alerts": F.col("action") == "error", "large": F.col("value") >= 20}
    return split_stream(events(spark, sf_dir), routes, otherwise="rest").select("event_id", "target")


@query(
    "case_cast_coalesce",
    """SELECT event_id, CASE WHEN value BETWEEN 5 AND 10 THEN 'mid' WHEN value > 10 THEN 'high' ELSE 'low' END AS band, CAST(user_id AS VARCHAR) || '-' || event_type AS label,
              coalesce(nullif(event_type, 'error'), 'none') AS kind, event_type IN ('click', 'view') AS browsing, event_type LIKE '%r%' AS has_r,
              regexp_matches(event_type, '^[a-e]') AS early, user_id * 2 + 1 AS arith FROM events""",
)
def case_cast_coalesce(spark, sf_dir):
    v, a = F.col("value"), F.col("action")
    return events(spark, sf_dir).select(
        "event_id",
        F.when(v.between(5, 10), "mid").when(v > 10, "high").otherwise("low").alias("band"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), a).alias("label"),
        F.coalesce(F.nullif(a, F.lit("error")), F.lit("none")).alias("kind"),
        a.isin("click", "view").alias("browsing"),
        a.like("%r%").alias("has_r"),
        a.rlike("^[a-e]").alias("early"),
        (F.col("user_id") * 2 + 1).alias("arith"),
    )


# -- joins -------------------------------------------------------------------


def side(df, action, **names):
    return df.filter(F.col("action") == action).select(*[F.col(c).alias(n) for n, c in names.items()])


@query(
    "unidirectional_window_join",
    """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(date_trunc('second', ts)) AS t FROM events)
       SELECT b.event_id::VARCHAR AS start_source, a.event_id::VARCHAR AS stop_source, CAST(a.user_id AS INTEGER) AS id,
              'purchase ' || a.event_id || ' after signup ' || b.event_id AS text
       FROM e a JOIN e b ON a.event_type = 'purchase' AND b.event_type = 'signup' AND a.user_id = b.user_id AND b.t > a.t - 21600000000 AND b.t <= a.t""",
)
def unidirectional_window_join(spark, sf_dir):
    """Lines -> events; each purchase with the same user's signups of the last 6 hours."""
    both = app_events(spark, sf_dir).filter(F.col("action").isin("purchase", "signup"))
    parsed = written(both.select("pid", "user_id", "t_us", "action"), "both-sides")  # the log is parsed once
    stop = side(parsed, "purchase", stop_source="pid", id="user_id", stop_us="t_us")
    begin = side(parsed, "signup", start_source="pid", begin_id="user_id", begin_us="t_us")
    joined = jn.interval_join(stop, begin, [("id", "begin_id")], "stop_us", "begin_us", 6 * HOUR)
    text = F.concat(F.lit("purchase "), "stop_source", F.lit(" after signup "), "start_source")
    return joined.select("start_source", "stop_source", "id", text.alias("text"))


@query(
    "stream_join_two_sided",
    """SELECT a.event_id AS view_id, b.event_id AS click_id FROM events a JOIN events b ON a.event_type = 'view' AND b.event_type = 'click'
       AND a.user_id = b.user_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) < 7200000000""",
)
def stream_join_two_sided(spark, sf_dir):
    ev = events(spark, sf_dir)
    views = side(ev, "view", view_id="event_id", u="user_id", a_us="ts_us")
    clicks = side(ev, "click", click_id="event_id", v="user_id", b_us="ts_us")
    return jn.interval_join(views, clicks, [("u", "v")], "a_us", "b_us", 2 * HOUR, 2 * HOUR).select("view_id", "click_id")


@query(
    "outer_joins",
    """WITH a AS (SELECT event_id AS stop_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'purchase'),
            b AS (SELECT event_id AS start_id, user_id, epoch_us(ts) AS t FROM events WHERE event_type = 'signup'),
            f AS (SELECT stop_id, start_id FROM a FULL JOIN b ON a.user_id = b.user_id AND b.t > a.t - 21600000000 AND b.t <= a.t)
       SELECT 'full' AS kind, stop_id, start_id FROM f UNION ALL SELECT 'left', stop_id, start_id FROM f WHERE stop_id IS NOT NULL
       UNION ALL SELECT 'right', stop_id, start_id FROM f WHERE start_id IS NOT NULL""",
)
def outer_joins(spark, sf_dir):
    ev = events(spark, sf_dir)
    stop = side(ev, "purchase", stop_id="event_id", u="user_id", stop_us="ts_us")
    start = side(ev, "signup", start_id="event_id", v="user_id", start_us="ts_us")
    out = None
    for how in ("left", "right", "full"):
        one = jn.interval_outer_join(stop, start, [("u", "v")], "stop_us", "start_us", 6 * HOUR, how)
        one = one.select(F.lit(how).alias("kind"), "stop_id", "start_id")
        out = one if out is None else out.unionByName(one)
    return out


_LAST_VALUE_SQL = """WITH a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), b AS (SELECT event_id AS last_id, user_id, ts, value FROM events WHERE event_type = 'view')
       SELECT a.event_id, b.last_id, b.value AS last_value FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.ts >= b.ts"""


@query("last_value_join", _LAST_VALUE_SQL)
def last_value_join(spark, sf_dir):
    ev = events(spark, sf_dir)
    errors = side(ev, "error", event_id="event_id", u="user_id", a_us="ts_us")
    views = side(ev, "view", last_id="event_id", v="user_id", b_us="ts_us", last_value="value")
    found = jn.last_value_join(errors, views, [("u", "v")], "a_us", "b_us", ["last_id", "last_value"])
    return found.select("event_id", "last_id", "last_value")


@query("last_value_join_stream", _LAST_VALUE_SQL)
def last_value_join_stream(spark, sf_dir):
    """The same on a stream: what is available is one batch, so its order of arrival does not matter."""
    ev, base = events_stream(spark, sf_dir), fresh_path(spark, "asof")
    errors = side(ev, "error", event_id="event_id", u="user_id", a_us="ts_us")
    views = side(ev, "view", last_id="event_id", v="user_id", b_us="ts_us", last_value="value")
    both = both_sides(errors, views, "v", "b_us", ["last_id", "last_value"])
    join = LastValueJoin(f"{base}/kept", "u", "a_us", ["last_id", "last_value"], lambda df, n: df.write.mode("overwrite").parquet(f"{base}/out/batch={n}"))
    drain_batches(spark, both, "asof", join)
    return spark.read.parquet(f"{base}/out").select("event_id", "last_id", "last_value")


_RECENT = """EXISTS (SELECT 1 FROM events b WHERE b.event_type = 'error' AND b.user_id = a.user_id
  AND epoch_us(b.ts) > epoch_us(a.ts) - 43200000000 AND b.ts <= a.ts)"""


@query(
    "exists_in_subquery",
    f"""SELECT 'has' AS kind, event_id FROM events a WHERE event_type = 'purchase' AND {_RECENT}
        UNION ALL SELECT 'lacks', event_id FROM events a WHERE event_type = 'purchase' AND NOT {_RECENT}""",
)
def exists_in_subquery(spark, sf_dir):
    ev = events(spark, sf_dir)
    bought = side(ev, "purchase", event_id="event_id", u="user_id", a_us="ts_us")
    errors = side(ev, "error", v="user_id", b_us="ts_us")
    found = jn.found_in_range(bought, errors, [("u", "v")], "a_us", "b_us", 12 * HOUR, "found")
    return found.select(F.when(F.col("found"), "has").otherwise("lacks").alias("kind"), "event_id")


@query(
    "theta_join",
    """WITH bands AS (SELECT n_nationkey AS band, CAST(n_nationkey AS BIGINT) * 300 AS low, CAST(n_nationkey AS BIGINT) * 300 + 450 AS high FROM nation)
       SELECT s.p_partkey, b.band FROM (SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS price FROM part) s JOIN bands b ON s.price >= b.low AND s.price < b.high""",
)
def theta_join(spark, sf_dir):
    """Overlapping price bands: a non-equi condition, joined through buckets."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.floor("p_retailprice").cast("bigint").alias("price"))
    low = F.col("n_nationkey").cast("bigint") * 300
    bands = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("band"), low.alias("low"), (low + 450).alias("high"))
    return jn.range_join(parts, bands, "price", "low", "high", width=250).select("p_partkey", "band")


# -- aggregates ----------------------------------------------------------------


@query("throughput", "SELECT date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY 1")
def throughput(spark, sf_dir):
    counted = wn.time_batch(events(spark, sf_dir), [], "ts", "1 hour", [F.count("*").alias("n")])
    return counted.select("window_start", "n")


@query(
    "aggregate_by_key",
    """SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, min(value) AS lowest, max(value) AS highest,
              CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean FROM events GROUP BY 1 HAVING count(*) >= 60""",
)
def aggregate_by_key(spark, sf_dir):
    grouped = events(spark, sf_dir).groupBy("user_id").agg(
        F.count("*").alias("n"),
        dbl(F.sum(money()), "total"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        (F.sum(money()).cast("double") / F.count("*")).alias("mean"),
    )
    return grouped.filter("n >= 60")


@query("agg_distinct", "SELECT event_type AS action, count(DISTINCT user_id) AS users, count(DISTINCT props) AS kinds FROM events GROUP BY 1")
def agg_distinct(spark, sf_dir):
    return events(spark, sf_dir).groupBy("action").agg(
        F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("kinds")
    )


@query(
    "agg_stats",
    """WITH m AS (SELECT event_type, avg(value) AS mean FROM events GROUP BY 1)
       SELECT e.event_type AS action, count(*) AS n, round(any_value(m.mean), 6) AS mean, round(stddev_samp(value), 6) AS stddev, median(value) AS median, round(avg(abs(value - m.mean)), 6) AS avedev
       FROM events e JOIN m ON m.event_type = e.event_type GROUP BY 1""",
)
def agg_stats(spark, sf_dir):
    stats = ag.distribution(events(spark, sf_dir), ["action"], "value")
    return stats.select(
        "action", "n", F.round("mean", 6).alias("mean"), F.round("stddev", 6).alias("stddev"), "median", F.round("avedev", 6).alias("avedev")
    )


@query(
    "agg_first_last",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events)
       SELECT user_id, arg_min(event_type, event_id) AS first_action, arg_max(event_type, event_id) AS last_action, max(CASE WHEN rn = 3 THEN event_type END) AS third_action,
              arg_max(event_id, struct_pack(a := value, b := event_id)) AS max_by_value, arg_min(event_id, struct_pack(a := value, b := event_id)) AS min_by_value FROM r GROUP BY user_id""",
)
def agg_first_last(spark, sf_dir):
    ev = events(spark, sf_dir)
    by_value = F.struct("value", "event_id")
    ends = ev.groupBy("user_id").agg(
        F.min_by("action", "event_id").alias("first_action"),
        F.max_by("action", "event_id").alias("last_action"),
        F.max_by("event_id", by_value).alias("max_by_value"),
        F.min_by("event_id", by_value).alias("min_by_value"),
    )
    third = ag.nth_per_key(ev, ["user_id"], [F.col("event_id")], 3).select("user_id", F.col("action").alias("third_action"))
    return ends.join(third, "user_id", "left")


@query(
    "agg_filtered",
    """SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS errors, CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'purchase'), 0) AS DOUBLE) AS spent
       FROM events GROUP BY 1""",
)
def agg_filtered(spark, sf_dir):
    spent = F.coalesce(F.sum(F.when(F.col("action") == "purchase", money())), F.lit(0))
    return events(spark, sf_dir).groupBy("user_id").agg(
        F.count_if(F.col("action") == "error").alias("errors"), dbl(spent, "spent")
    )


@query(
    "agg_rollup",
    """SELECT event_type AS action, CAST(user_id % 5 AS BIGINT) AS shard, count(*) AS n, CAST(grouping(event_type) AS INTEGER) AS g1, CAST(grouping(user_id % 5) AS INTEGER) AS g2
       FROM events GROUP BY ROLLUP (event_type, user_id % 5)""",
)
def agg_rollup(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("shard", F.col("user_id") % 5)
    return ev.rollup("action", "shard").agg(
        F.count("*").alias("n"), F.grouping("action").cast("int").alias("g1"), F.grouping("shard").cast("int").alias("g2")
    )


@query(
    "agg_cube",
    """SELECT event_type AS action, CAST(user_id % 5 AS BIGINT) AS shard, count(*) AS n, CAST(grouping(event_type) AS INTEGER) AS g1, CAST(grouping(user_id % 5) AS INTEGER) AS g2
       FROM events GROUP BY CUBE (event_type, user_id % 5)""",
)
def agg_cube(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("shard", F.col("user_id") % 5)
    return ev.cube("action", "shard").agg(
        F.count("*").alias("n"), F.grouping("action").cast("int").alias("g1"), F.grouping("shard").cast("int").alias("g2")
    )


@query(
    "agg_grouping_sets",
    """SELECT event_type AS action, CAST(user_id % 5 AS BIGINT) AS shard, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5))""",
)
def agg_grouping_sets(spark, sf_dir):
    ev = events(spark, sf_dir).withColumn("shard", F.col("user_id") % 5)
    sets = [[F.col("action")], [F.col("shard")]]
    return ev.groupingSets(sets, "action", "shard").agg(F.count("*").alias("n")).select("action", "shard", "n")


@query(
    "agg_running",
    """SELECT event_id, user_id, count(*) OVER w AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total, max(value) OVER w AS highest, min(value) OVER w AS lowest
       FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
)
def agg_running(spark, sf_dir):
    out = wn.running_totals(
        events(spark, sf_dir), ["user_id"], "ts_us",
        sums={"n": F.lit(1), "total": money()}, maxima={"highest": F.col("value")}, minima={"lowest": F.col("value")},
    )
    return out.select("event_id", "user_id", "n", dbl(F.col("total"), "total"), "highest", "lowest")


@query(
    "agg_rate",
    """SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) / 3600.0::DOUBLE AS rate FROM events""",
)
def agg_rate(spark, sf_dir):
    return wn.rate(events(spark, sf_dir), ["action"], "ts_us", 3600).select("event_id", "rate")


# -- windows -------------------------------------------------------------------


@query(
    "win_time_sliding",
    """WITH e AS (SELECT *, epoch_us(ts) AS t FROM events)
       SELECT a.event_id, count(*) AS n, CAST(sum(CAST(b.value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(b.value) AS highest
       FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t - 86400000000 AND b.t <= a.t GROUP BY a.event_id""",
)
def win_time_sliding(spark, sf_dir):
    out = wn.time_sliding(
        events(spark, sf_dir), ["user_id"], "ts_us", 24 * HOUR,
        {"n": F.count(F.lit(1)), "total": F.sum(money()), "highest": F.max("value")},
    )
    return out.select("event_id", "n", dbl(F.col("total"), "total"), "highest")


@query(
    "win_keepall",
    """SELECT event_id, count(*) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS kept FROM events""",
)
def win_keepall(spark, sf_dir):
    """How many events a keep-all window holds at each arrival (no key at all)."""
    kept = wn.running_totals(events(spark, sf_dir), [], "ts_us", sums={"kept": F.lit(1)})
    return kept.select("event_id", "kept")


_LENGTH = "ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW"


@query(
    "win_length",
    f"SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER ({_LENGTH}) AS DOUBLE) AS total, min(value) OVER ({_LENGTH}) AS lowest FROM events",
)
def win_length(spark, sf_dir):
    out = wn.length_sliding(events(spark, sf_dir), [], "ts_us", 5, {"total": F.sum(money()), "lowest": F.min("value")})
    return out.select("event_id", dbl(F.col("total"), "total"), "lowest")


@query(
    "win_grouped",
    """SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER w AS DOUBLE) AS total, count(*) OVER w AS n FROM events
       WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def win_grouped(spark, sf_dir):
    out = wn.length_sliding(events(spark, sf_dir), ["user_id"], "ts_us", 3, {"total": F.sum(money()), "n": F.count(F.lit(1))})
    return out.select("event_id", dbl(F.col("total"), "total"), "n")


@query(
    "win_time_batch",
    """SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, event_type AS action, count(*) AS n, max(value) AS highest FROM events GROUP BY 1, 2""",
)
def win_time_batch(spark, sf_dir):
    out = wn.time_batch(events(spark, sf_dir), ["action"], "ts", "15 minutes", [F.count("*").alias("n"), F.max("value").alias("highest")])
    return out.drop("window_end")


@query(
    "win_length_batch",
    """WITH r AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY ts) - 1) // 10 AS batch FROM events)
       SELECT event_type AS action, batch, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(event_id) AS last_id FROM r GROUP BY 1, 2 HAVING count(*) = 10""",
)
def win_length_batch(spark, sf_dir):
    out = wn.length_batch(
        events(spark, sf_dir), ["action"], "ts_us", 10, [dbl(F.sum(money()), "total"), F.max("event_id").alias("last_id")]
    )
    return out


@query(
    "win_session",
    """WITH f AS (SELECT *, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 7200000000 THEN 0 ELSE 1 END AS fresh FROM events),
            s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM f)
       SELECT user_id, min(ts) AS session_start, max(ts) AS session_end, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM s GROUP BY user_id, sid""",
)
def win_session(spark, sf_dir):
    out = wn.sessions(events(spark, sf_dir), ["user_id"], "ts_us", 2 * HOUR, sums={"n": F.lit(1), "total": money()})
    return out.select(
        "user_id", micros_to_ntz(F.col("session_start")).alias("session_start"),
        micros_to_ntz(F.col("session_end")).alias("session_end"), "n", dbl(F.col("total"), "total"),
    )


@query("win_unique", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS action FROM events GROUP BY 1")
def win_unique(spark, sf_dir):
    return wn.latest_per_key(events(spark, sf_dir), ["user_id"], "ts_us").select("user_id", "event_id", "action")


@query("win_firstunique", "SELECT user_id, min(event_id) AS event_id, arg_min(event_type, event_id) AS action FROM events GROUP BY 1")
def win_firstunique(spark, sf_dir):
    return wn.first_per_key(events(spark, sf_dir), ["user_id"], "ts_us").select("user_id", "event_id", "action")


@query("win_sort_topn", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 20")
def win_sort_topn(spark, sf_dir):
    return wn.sorted_window(events(spark, sf_dir).select("event_id", "value"), 20, [F.col("value").desc(), F.col("event_id")])


@query(
    "win_rank_per_key",
    "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3",
)
def win_rank_per_key(spark, sf_dir):
    best = wn.first_n(events(spark, sf_dir), ["user_id"], [F.col("value").desc(), F.col("event_id")], 3)
    return best.select("user_id", "event_id", "value")


@query(
    "win_prev_prior",
    """SELECT event_id, lag(value, 2) OVER (PARTITION BY user_id ORDER BY ts) AS earlier, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS before_action FROM events""",
)
def win_prev_prior(spark, sf_dir):
    lags = {"earlier": (F.col("value"), 2), "before_action": (F.col("action"), 1)}
    both = wn.with_earlier(events(spark, sf_dir), ["user_id"], "ts_us", lags)
    return both.select("event_id", "earlier", "before_action")


@query(
    "win_expiry",
    "SELECT event_id, ts + INTERVAL 10 DAY AS expires_at FROM events WHERE ts + INTERVAL 10 DAY <= (SELECT max(ts) FROM events)",
)
def win_expiry(spark, sf_dir):
    gone = wn.expiries(events(spark, sf_dir), "ts_us", 240 * HOUR)
    return gone.select("event_id", micros_to_ntz(F.col("expires_us")).alias("expires_at"))


@query("order_limit", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 10 OFFSET 5")
def order_limit(spark, sf_dir):
    ordered = events(spark, sf_dir).select("event_id", "value").orderBy(F.col("value").desc(), "event_id")
    return ordered.offset(5).limit(10)


@query(
    "output_every",
    """WITH e AS (SELECT *, epoch_us(ts) // 86400000000 AS d FROM events), m AS (SELECT max(d) AS last_d FROM e),
            l AS (SELECT event_type, d, max(event_id) AS event_id FROM e GROUP BY 1, 2)
       SELECT 'last' AS mode, event_type AS action, event_id, (d + 1) * 86400000000 AS output_us FROM l
       UNION ALL SELECT 'first', event_type, min(event_id), (d + 1) * 86400000000 FROM e GROUP BY event_type, d
       UNION ALL SELECT 'all', event_type, event_id, (d + 1) * 86400000000 FROM e
       UNION ALL SELECT 'snapshot', l.event_type, max(l.event_id), (g.d + 1) * 86400000000 FROM (SELECT DISTINCT d FROM e) g JOIN l ON l.d <= g.d GROUP BY l.event_type, g.d""",
)
def output_every(spark, sf_dir):
    ev = events(spark, sf_dir).select("action", "event_id", "ts_us")
    out = None
    for mode in ("last", "first", "all", "snapshot"):
        one = wn.output_every(ev, ["action"], "ts_us", 24 * HOUR, mode).select(F.lit(mode).alias("mode"), "action", "event_id", "output_us")
        out = one if out is None else out.unionByName(one)
    return out
