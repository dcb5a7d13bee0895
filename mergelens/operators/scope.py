"""Filters that limit a frame of pull requests."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import cutoff


def scope(
    prs: DataFrame,
    org: str | None = None,
    repo: str | None = None,
    author: str | None = None,
    days_back: int | None = None,
    as_of: datetime | date | None = None,
) -> DataFrame:
    """Rows of the given org, repo and author, created on or after the cutoff's midnight.

    A time limit also bounds the partition columns year and month where the frame has them, so
    that partitions before it are pruned.
    """
    for column, value in (("org", org), ("repo", repo), ("author", author)):
        if value:
            prs = prs.where(F.col(column) == value)
    day = cutoff(days_back, as_of)
    if day is not None:
        prs = prs.where(F.col("created_at") >= F.lit(day.isoformat()).cast("timestamp"))
        if {"year", "month"} <= set(prs.columns):
            prs = prs.where((F.col("year") > day.year) | ((F.col("year") == day.year) & (F.col("month") >= day.month)))
    return prs


def with_min_prs(prs: DataFrame, least: int = 3) -> DataFrame:
    """Rows of repositories that have at least ``least`` pull requests.

    The repositories are counted with partial aggregation and joined back, so that a large one
    is not gathered in one task.
    """
    kept = prs.groupBy("repo").count().where(F.col("count") >= least).select("repo")
    return prs.join(kept, "repo", "left_semi")


def dropped_repos(prs: DataFrame, least: int = 3) -> DataFrame:
    """One row: how many repositories fall below the limit, and how many there are."""
    counts = prs.groupBy("repo").count()
    return counts.agg(
        F.count(F.when(F.col("count") < least, 1)).alias("dropped_repos"), F.count("*").alias("all_repos")
    )
