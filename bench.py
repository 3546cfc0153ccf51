"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tallyspark import plans
from tallyspark.session import session

HEADLINE = ("report_summary", "report_star_list", "eav_pivot", "group_concat_ordered", "date_basis_period", "batch_status_sm", "urgency_rank", "review_topk", "audit_facets", "upsert_latest", "nested_children", "residual_row", "total_precedence", "text_lines", "keyword_score", "dedupe_lines")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.perf_counter()
            plans.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
        print(name, took[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, sum of medians of three runs after a warm-up", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
