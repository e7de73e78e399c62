"""Headline queries, timed one by one; prints one JSON line.

Each query is run once untimed, so that class loading and code generation are not measured, and
then timed to a full materialisation of its result. BENCH_CPUS and BENCH_SF_DIR choose the cores
and the tables.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from escrutinio import catalogue
from escrutinio.session import build_session

HEADLINE = {
    "dense_indicators": "indicators of a dense table",
    "concentration": "concentration of a dense table",
    "totals": "totals of a dense table",
    "map_values": "map, municipalities",
    "map_values_zone": "map, zones",
    "map_common_breaks": "map with common breaks",
    "two_side_comparison": "comparison, whole country",
    "candidate_list": "candidates",
    "candidate_accounts": "finances",
    "votes_by_territory": "votes by territory, a few candidates",
    "section_to_place_votes": "section file to places",
    "section_to_place_totals": "section file to places, totals",
    "cell_aggregate": "places to cells",
    "ledger": "finance ETL",
    "revenue_summary": "revenue summary",
    "window_metrics": "social windows",
    "search_ranked": "search",
    "reconcile": "reconciliation",
    "correlation_bootstrap": "bootstrap correlation",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="16g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    cases = catalogue.queries()
    times: dict[str, float] = {}
    for name in HEADLINE:
        for timed in (False, True):
            start = time.perf_counter()
            cases[name](spark, folder).write.format("noop").mode("overwrite").save()
            if timed:
                times[name] = round(time.perf_counter() - start, 3)
    scale = folder.rstrip("/").rsplit("sf", 1)[-1]
    line = {
        "metric": "headline queries, total warm time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
    }
    spark.stop()
    print(json.dumps(line))


if __name__ == "__main__":
    main()
