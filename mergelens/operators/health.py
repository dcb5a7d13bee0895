"""Derived classifications: baselines, bus factor, review culture, bands and bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from . import metrics


def versus_baseline(contributors: DataFrame, baseline: DataFrame) -> DataFrame:
    """Merge rates against the baseline's: five points either way make a difference.

    ``baseline`` has one row.
    """
    base = baseline.select(F.col("avg_merge_rate").alias("base_rate"))
    joined = contributors.crossJoin(F.broadcast(base))
    rate = F.col("merge_rate")
    label = F.when(rate >= F.col("base_rate") + 5, "Better").when(rate <= F.col("base_rate") - 5, "Below").otherwise("Average")
    return joined.withColumn("vs_org", label)


def bus_factor(contributors: DataFrame, total_prs: DataFrame | None = None) -> DataFrame:
    """Share of pull requests by the top fifth of contributors (at least one).

    The ranking window has one partition, over one row a contributor of a repository.
    """
    ranked = contributors.select(
        "pr_count",
        F.row_number().over(W.orderBy(F.desc("pr_count"), F.asc_nulls_last("author"))).alias("place"),
        F.count("*").over(W.partitionBy()).alias("n"),
    )
    top = F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(0.2)))
    out = ranked.agg(
        F.max(top).cast("long").alias("top_contributors"),
        F.sum(F.when(F.col("place") <= top, F.col("pr_count"))).alias("top_prs"),
        F.sum("pr_count").alias("all_prs"),
    )
    share = E.percent(F.col("top_prs"), F.col("all_prs"))
    level = F.when(share > 80, "high").when(share > 60, "moderate").otherwise("good")
    return out.select("top_contributors", "top_prs", F.round(share, 6).alias("top_share"), level.alias("level"))


def self_merge_health(contributors: DataFrame) -> DataFrame:
    out = contributors.agg(F.sum("self_merged_count").alias("self_merged"), F.sum("merged_count").alias("merged"))
    share = F.coalesce(E.percent(F.col("self_merged"), F.col("merged")), F.lit(0.0))
    level = F.when(share > 50, "high").when(share > 25, "moderate").otherwise("good")
    return out.select("self_merged", "merged", F.round(share, 6).alias("self_merge_share"), level.alias("level"))


def review_participation(contributors: DataFrame) -> DataFrame:
    out = contributors.agg(F.count(F.when(F.col("reviews_given") > 0, 1)).alias("reviewers"), F.count("author").alias("contributors"))
    share = F.coalesce(E.percent(F.col("reviewers"), F.col("contributors")), F.lit(0.0))
    level = F.when(share >= 50, "active").when(share >= 25, "moderate").otherwise("low")
    return out.select("reviewers", "contributors", F.round(share, 6).alias("participation"), level.alias("level"))


def throughput_span(prs: DataFrame) -> DataFrame:
    """All pull requests over the observed span of days, with the unrounded merge rate."""
    out = prs.agg(
        F.count("*").alias("total_prs"),
        E.merged_count().alias("merged_prs"),
        E.day_span(F.min("created_at"), F.max("created_at")).alias("days_span"),
    )
    return out.select(
        "total_prs",
        "merged_prs",
        "days_span",
        F.round(F.col("total_prs") / F.col("days_span"), 6).alias("daily_throughput"),
        F.round(E.percent(F.col("merged_prs"), F.col("total_prs")), 6).alias("merge_rate"),
    )


def rate_bands(stats: DataFrame) -> DataFrame:
    """Colours of merge rates in tables (from 70) and in weekly and contributor views (75)."""
    return stats.withColumn("table_band", E.rate_band(F.col("merge_rate"), 70)).withColumn(
        "trend_band", E.rate_band(F.col("merge_rate"), 75)
    )


def time_bands(stats: DataFrame) -> DataFrame:
    return stats.withColumn("time_band", E.time_band(F.col("avg_merge_time")))


def success_bar(stats: DataFrame, width: int = 15) -> DataFrame:
    return stats.withColumn("success_bar", E.bar(F.lit(width) * F.col("merge_rate") / F.lit(100.0), width))


def size_share_bar(prs: DataFrame, width: int = 20) -> DataFrame:
    """Sizes with a bar against the largest and their share of all pull requests."""
    everything = W.partitionBy()  # three rows at most
    return (
        metrics.size_distribution(prs)
        .withColumn("bar", E.bar(F.lit(width) * F.col("pr_count") / F.max("pr_count").over(everything), width))
        .withColumn("share", F.round(E.percent(F.col("pr_count"), F.sum("pr_count").over(everything)), 6))
    )
