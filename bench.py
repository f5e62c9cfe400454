"""Wall time of headline queries, warm, median of three; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 4).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from catalog import CASES
from catalog.charts import events
from plumbline.operators.series import Roles
from plumbline.operators.time_weighted import cusum, ewma
from plumbline.session import local_session

HEADLINE = (
    "individuals_chart", "all_rules_at_once", "default_rules_counts", "xbar_r_chart", "xbar_s_chart",
    "range_chart", "three_way_chart", "p_chart", "laney_p_chart", "t_chart", "g_chart",
    "short_run_standardized", "ewma_chart", "cusum_chart", "cusum_vmask_chart", "hotelling_t2_chart",
    "mewma_chart", "capability_indices", "all_findings", "method_disagreements", "season_length",
    "forecast_projection", "replayed_steps", "fill_down", "profile_quantiles", "numeric_profile",
    "first_of_duplicates",
)


def giant(kind, **sizing):
    """All events as one series."""
    return lambda spark, folder: kind(events(spark, folder), Roles("value", "event_id"), **sizing).points


GIANT = {
    "one_series_ewma_windows": giant(ewma),
    "one_series_ewma_blocks": giant(ewma, block_rows=10_000),
    "one_series_cusum_windows": giant(cusum),
    "one_series_cusum_blocks": giant(cusum, block_rows=10_000),
}


def timed(run, spark, folder) -> float:
    start = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus, app="bench", **{"spark.sql.shuffle.partitions": cpus})
    work = {**{n: CASES[n].run for n in HEADLINE}, **GIANT}
    chosen = sys.argv[1:] or list(work)
    seconds = {}
    for name in chosen:
        run = work.get(name) or CASES[name].run
        timed(run, spark, folder)
        seconds[name] = round(statistics.median(timed(run, spark, folder) for _ in range(runs)), 3)
        print(f"{name:32s} {seconds[name]:.3f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
