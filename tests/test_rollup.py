"""Refreshed roll-ups, streaks and mergeable quantiles on small frames."""

import math
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F
from test_store import rows

from mergelens.operators import rhythm, rollup

MON = datetime(2024, 1, 29)  # a Monday; its week lies in two months


def told(spark, path):
    return {(r["level"], r["org"], r["repo"], r["period"]): (r["pr_count"], r["merged_count"], r["active_authors"]) for r in rollup.roll_up(rollup.read_sums(spark, path)).collect()}


def test_only_touched_partitions_change(spark, tmp_path):
    path = f"{tmp_path}/sums"
    first = rows(spark, {"pr_number": 1, "created_at": MON}, {"pr_number": 2, "created_at": MON + timedelta(4), "author": "b"}, {"pr_number": 3, "created_at": MON + timedelta(4), "org": "p"})
    assert rollup.refresh(first, path) == -1
    got = told(spark, path)
    # a week over two months is one week, and its authors are counted once
    assert got["week", "o", None, MON] == (2, 0, 2) and got["all", None, None, None] == (3, 0, 2)
    assert got["month", "o", None, datetime(2024, 2, 1)] == (1, 0, 1)
    files = set((tmp_path / "sums").rglob("*.parquet"))
    grown = first.unionByName(rows(spark, {"pr_number": 4, "created_at": MON + timedelta(5), "state": "merged"}))
    touched = grown.where("pr_number = 4").select("org", "year", "month")
    for _ in range(2):
        assert rollup.refresh(grown, path, touched) == 1
        got = told(spark, path)
        assert got["all", None, None, None] == (4, 1, 2) and got["repo", "o", "r", None] == (3, 1, 2) and got["org", "p", None, None] == (1, 0, 1)
    assert len(files & set((tmp_path / "sums").rglob("*.parquet"))) == 2  # January and the other org were not written again
    assert rollup.refresh(grown, path, touched.where("false")) == 0


def test_refresh_prunes_the_store(spark, tmp_path):
    from mergelens.sources import store

    store.write_prs(rows(spark, {"pr_number": 1, "created_at": MON}, {"pr_number": 2, "created_at": MON + timedelta(90)}), f"{tmp_path}/s")
    prs = store.read_store(spark, f"{tmp_path}/s")
    seen = []
    real = rollup.partial_sums
    rollup.partial_sums = lambda df: seen.append(df) or real(df)
    try:
        rollup.refresh(prs, f"{tmp_path}/sums", prs.where("pr_number = 2"))
    finally:
        rollup.partial_sums = real
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    assert len(seen[0].select(F.input_file_name()).distinct().collect()) == 1


def test_streaks_and_pauses(spark):
    weeks = [0, 1, 1, 2, 5, 6, 10]
    df = rows(spark, *[{"pr_number": i, "created_at": MON + timedelta(7 * w + i % 3)} for i, w in enumerate(weeks)], {"pr_number": 50, "created_at": MON, "author": "once"}, {"pr_number": 51, "created_at": MON, "author": None})
    got = sorted(((r["from_week"] - MON).days // 7, (r["to_week"] - MON).days // 7, r["weeks"], r["prs"]) for r in rhythm.streaks(df).where("author = 'a'").collect())
    assert got == [(0, 2, 3, 4), (5, 6, 2, 2), (10, 10, 1, 1)]
    a, once = rhythm.submission_frequency(df).collect()
    assert (a["active_weeks"], a["span_weeks"], a["longest_streak"], a["longest_pause"], a["prs_per_week"]) == (6, 11, 3, 3, 0.64)
    assert (once["author"], once["span_weeks"], once["longest_pause"], once["prs_per_week"]) == ("once", 1, 0, 1.0)


def test_quantiles_of_merged_histograms(spark):
    rnd = random.Random(3)
    hours = [rnd.lognormvariate(2, 2) for _ in range(3000)] + [0.0, -1.0, None]
    df = rows(spark, *[{"pr_number": i, "created_at": MON + timedelta(i % 60), "time_to_first_review_hours": h} for i, h in enumerate(hours)])
    (got,) = rhythm.response_quantiles(rhythm.response_histogram(df), ["org"], (0.1, 0.5, 0.99, 1.0)).collect()
    known = sorted(h for h in hours if h is not None)
    assert got["n"] == len(known)
    for share in (0.1, 0.5, 0.99, 1.0):
        want = known[math.ceil(share * len(known)) - 1]
        assert abs(got[f"p{round(100 * share)}"] - want) <= 0.0101 * want + 1e-4
    assert rhythm.response_quantiles(rhythm.response_histogram(df.where("false")), ["org"]).collect() == []


def test_nothing(spark):
    none = rows(spark)
    assert rhythm.streaks(none).collect() == [] and rhythm.submission_frequency(none).collect() == []
    assert rollup.roll_up(rollup.partial_sums(none)).collect() == []
