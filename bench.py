"""Times the headline queries: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import time

HEADLINE = [
    "summary_stats", "author_stats", "repo_stats", "size_distribution", "weekly_stats", "monthly_stats", "top_authors",
    "author_weekly_stats", "org_baseline_stats", "contributor_review_activity", "contributor_stats_for_repo",
    "team_weekly_trend", "author_weekly_trend", "bus_factor", "normalize_prs",
]


def main() -> None:
    from mergelens.plans import catalog
    from mergelens.session import get_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false"
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    run = lambda name: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:  # compiles and opens the files
        run(name)
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        run(name)
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
