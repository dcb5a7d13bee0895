"""What collection reports about freshly fetched pull requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def active_repos(found: DataFrame) -> DataFrame:
    """Distinct non-empty repository names of search results (repository.name), sorted."""
    return found.select(F.col("repository.name").alias("name")).where(F.col("name") != "").distinct().orderBy("name")


def collection_summary(prs: DataFrame, days: int) -> DataFrame:
    """Totals, with merged pull requests a requested day."""
    out = prs.agg(
        F.count("*").alias("total_prs"),
        E.merged_count().alias("merged_prs"),
        F.avg("pr_size").alias("size"),
        F.avg(F.when(E.is_merged(), F.col("time_to_merge_hours"))).alias("hours"),
    )
    return out.select(
        "total_prs",
        "merged_prs",
        F.round(E.percent(F.col("merged_prs"), F.col("total_prs")), 6).alias("merge_rate"),
        F.round(F.col("merged_prs") / F.lit(float(days)), 6).alias("daily_throughput"),
        F.round("size", 6).alias("avg_pr_size"),
        F.round("hours", 6).alias("avg_merge_time"),
    )


def partition_counts(prs: DataFrame) -> DataFrame:
    """One row: the distinct partitions of rows that have a creation time."""
    dated = prs.where(F.col("created_at").isNotNull())
    return dated.select("org", "repo", "year", "month").distinct().agg(F.count("*").alias("partitions"))
