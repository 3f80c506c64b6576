"""Time the headline queries; prints one JSON line.

Data from ``$BENCH_SF_DIR`` (default sf0.1), ``local[$BENCH_CPUS]`` (default 8).
Each query runs ``$BENCH_RUNS`` times (default 2) into the noop sink after a
session warm-up; the best run counts. ``BENCH_KEYS`` (comma separated, or ``all``)
picks other queries.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lumberline.queries import QUERIES  # noqa: E402
from lumberline.session import local_session  # noqa: E402

HEADLINE = [
    "unidirectional_window_join", "scan_lines", "grok_extract", "event_type_hierarchy", "pattern_alternatives",
    "json_merge", "csv_field", "urlargs_merge", "event_time", "parse_stats", "default_type", "sink_template",
    "where_filter", "multi_query", "reference_lookup_join", "cidr_join", "udf_isprivateip", "last_value_join",
    "stream_join_two_sided", "outer_joins", "exists_in_subquery", "aggregate_by_key", "agg_stats", "agg_running",
    "win_time_sliding", "win_length", "win_session", "win_time_batch", "win_rank_per_key", "late_data",
    "multiline_assembly", "sequence_within", "absence_within", "match_sequence", "keyed_context", "window_upsert",
    "dedup_stream", "event_clock", "parse_and_filter_stream", "stream_tail",
]


def run(fn, spark, sf_dir) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_KEYS", "")
    keys = list(QUERIES) if wanted == "all" else [k for k in wanted.split(",") if k] or HEADLINE
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    run(QUERIES["select_distinct"], spark, sf_dir)
    times = {}
    for key in keys:
        times[key] = round(min(run(QUERIES[key], spark, sf_dir) for _ in range(runs)), 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([\d.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
