"""Time the headline queries on one data folder and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyspan.plans import all_queries
from tallyspan.session import local_session

HEADLINE = (
    "projected_rank_with_error", "backtest", "rolling_backtest", "candidate_search", "dense_grid", "weekly_grid", "calendar_lags",
    "decompose", "typed_rows", "label_first_spelling", "column_role_profile", "matrix_expand", "duplicate_keys", "content_signature",
    "dataset_state", "latest_run", "findings_capped", "quality_report", "stream_rollup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cores, partitions=cores)
    queries = all_queries()
    queries["mmwr_year_length"](spark, folder).write.format("noop").mode("overwrite").save()  # start-up, not timed
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
