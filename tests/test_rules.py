"""Boundaries of buckets, bands, trends and health levels."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from mergelens.functions import expr as E
from mergelens.operators import health, metrics, scope, trends


def values(spark, inputs, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


def test_size_buckets(spark):
    got = values(spark, [50, 51, 200, 201, None], "long", E.size_bucket)
    assert got == ["Small (<50)", "Medium (50-200)", "Medium (50-200)", "Large (>200)", "Large (>200)"]


def test_bands(spark):
    assert values(spark, [69.9, 70.0, 90.0], "double", lambda c: E.rate_band(c, 70)) == ["red", "yellow", "green"]
    assert values(spark, [74.9, 75.0, 89.9], "double", lambda c: E.rate_band(c, 75)) == ["red", "yellow", "yellow"]
    assert values(spark, [23.9, 24.0, 72.0, None], "double", E.time_band) == ["green", "yellow", "red", None]


@pytest.mark.parametrize(
    ("dn", "dr", "team", "contributor"),
    [
        (None, None, "", ""), (1, 0, "up", "up"), (-1, -5.1, "down", "down"), (-1, -5, "stable", "stable"), (2, -5, "stable", "mixed"),
        (-2, 5, "stable", "mixed"), (1, -5.1, "up_lower_quality", "mixed"), (-1, 5.1, "down_better_quality", "mixed"), (-3, 0, "mixed", "mixed"), (0, 0, "stable", "stable"),
    ],
)
def test_trend_rules(spark, dn, dr, team, contributor):
    df = spark.createDataFrame([(dn and float(dn) if dn else dn if dn is None else 0.0, None if dr is None else float(dr))], "n double, r double")
    row = df.select(E.trend(F.col("n"), F.col("r"), 2, True), E.trend(F.col("n"), F.col("r"), 1, False)).first()
    assert tuple(row) == (team, contributor)


def test_day_span(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 23), datetime(2024, 1, 2, 1)), (datetime(2024, 1, 1), datetime(2024, 1, 7))], "a timestamp, b timestamp")
    assert [r[0] for r in df.select(E.day_span(F.col("a"), F.col("b"))).collect()] == [1, 7]


def people(spark, rows):
    return spark.createDataFrame(rows, "author string, pr_count long, merged_count long, self_merged_count long, reviews_given long")


@pytest.mark.parametrize(("n", "k"), [(1, 1), (4, 1), (5, 1), (9, 1), (10, 2)])
def test_bus_factor_top_fifth(spark, n, k):
    assert health.bus_factor(people(spark, [(f"a{i}", 10, 5, 1, 0) for i in range(n)])).first()["top_contributors"] == k


@pytest.mark.parametrize(("top", "level"), [(80, "moderate"), (81, "high"), (60, "good"), (61, "moderate")])
def test_bus_factor_levels(spark, top, level):
    rest = 100 - top
    df = people(spark, [("a", top, 1, 0, 0), ("b", rest - 3, 1, 0, 0), *[(f"c{i}", 1, 0, 0, 0) for i in range(3)]])
    assert health.bus_factor(df).first()["level"] == level


@pytest.mark.parametrize(("own", "merged", "level"), [(50, 100, "moderate"), (51, 100, "high"), (25, 100, "good"), (0, 0, "good")])
def test_self_merges(spark, own, merged, level):
    assert health.self_merge_health(people(spark, [("a", 100, merged, own, 0)])).first()["level"] == level


@pytest.mark.parametrize(("given", "level"), [(2, "active"), (1, "moderate"), (0, "low")])
def test_participation(spark, given, level):
    df = people(spark, [(f"a{i}", 1, 1, 0, int(i < given)) for i in range(4)])
    assert health.review_participation(df).first()["level"] == level


def prs(spark, rows):
    return spark.createDataFrame(rows, "org string, repo string, author string, pr_number long, created_at timestamp, state string, pr_size long, reviews long, time_to_merge_hours double")


def test_empty_frames(spark):
    none = prs(spark, [])
    s = metrics.summary_stats(none).first()
    assert s["total_prs"] == 0 and s["merged_prs"] is None and s["unique_repos"] == 0
    for f in (metrics.author_stats, metrics.weekly_stats, metrics.monthly_stats, metrics.size_distribution, trends.team_trend, trends.author_trends):
        assert f(none).count() == 0
    assert health.throughput_span(none).first()["days_span"] is None


def test_missing_later_columns(spark):
    df = prs(spark, [("o", "r", "a", 1, datetime(2024, 1, 1), "merged", 10, 1, 2.0), ("o", "r", None, 2, datetime(2024, 1, 2), "open", None, 0, None)])
    got = {r["author"]: r for r in metrics.contributor_stats_for_repo(df, "o", "r").collect()}
    assert got["a"]["reviews_given"] == 0 and got["a"]["avg_files_changed"] is None and got["a"]["self_merged_count"] == 0
    assert got[None]["self_merge_rate"] is None
    assert metrics.org_baseline_stats(df).first()["avg_files_changed"] is None


def test_trend_direction_and_two_weeks(spark):
    day = lambda d: datetime(2024, 1, d)
    rows = [("o", "r", "a", i, day(1), "merged", 1, 0, 1.0) for i in range(3)] + [("o", "r", "a", 9, day(8), "merged", 1, 0, 1.0), ("o", "r", "b", 10, day(8), "open", 1, 0, None)]
    newest = [r["trend"] for r in trends.author_trends(prs(spark, rows)).orderBy(F.desc("week")).collect()]
    assert newest == ["", "up"]
    oldest = [r["trend"] for r in trends.author_trends(prs(spark, rows), chronological=True).orderBy("week").collect()]
    assert oldest == ["", "mixed"]


def test_scope_and_min_prs(spark):
    rows = [("o", "r", "a'b", i, datetime(2024, 1, i + 1), "open", 1, 0, None) for i in range(4)] + [("o", "007", "c", 9, datetime(2024, 1, 4), "open", 1, 0, None)]
    df = prs(spark, rows)
    assert scope.scope(df, author="a'b", days_back=2, as_of=datetime(2024, 1, 5, 13)).count() == 2
    assert scope.scope(df, days_back=0).count() == 5
    assert {r["repo"] for r in scope.with_min_prs(df, 2).collect()} == {"r"}
    assert tuple(scope.dropped_repos(df, 2).first()) == (1, 2)
