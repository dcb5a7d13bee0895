"""The named aggregate queries over a frame of pull requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from .scope import scope

TREND_WEEKS, CONTRIBUTOR_WEEKS = 6, 12


def _column(prs: DataFrame, name: str, kind: str) -> Column:
    """The column, or null of its type where an older frame lacks it."""
    return F.col(name) if name in prs.columns else F.lit(None).cast(kind)


def summary_stats(prs: DataFrame) -> DataFrame:
    return prs.agg(
        F.count("*").alias("total_prs"),
        E.merged_count().alias("merged_prs"),
        E.average("pr_size", 0).alias("avg_pr_size"),
        E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
        F.min("created_at").alias("date_min"),
        F.max("created_at").alias("date_max"),
        F.countDistinct("repo").alias("unique_repos"),
        F.countDistinct("author").alias("unique_authors"),
    )


def author_stats(prs: DataFrame) -> DataFrame:
    return (
        prs.groupBy("author")
        .agg(
            F.count("*").alias("pr_count"),
            E.merged_count().alias("merged_count"),
            E.average("pr_size").alias("avg_pr_size"),
            E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
            E.average("reviews").alias("avg_reviews"),
            E.merge_rate().alias("merge_rate"),
        )
        .orderBy(F.desc("pr_count"), F.asc_nulls_last("author"))
    )


def repo_stats(prs: DataFrame) -> DataFrame:
    return (
        prs.groupBy("repo")
        .agg(
            F.count("*").alias("pr_count"),
            E.merged_count().alias("merged_count"),
            F.countDistinct("author").alias("contributor_count"),
            E.average("pr_size").alias("avg_pr_size"),
            E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
            E.merge_rate().alias("merge_rate"),
        )
        .orderBy(F.desc("pr_count"), F.asc_nulls_last("repo"))
    )


def size_distribution(prs: DataFrame) -> DataFrame:
    """Sizes without a row are absent."""
    return (
        prs.groupBy(E.size_bucket(F.col("pr_size")).alias("size_category"))
        .agg(F.count("*").alias("pr_count"), E.average_merged("time_to_merge_hours").alias("avg_merge_time"))
        .orderBy(E.size_order(F.col("size_category")))
    )


def weekly_stats(prs: DataFrame, weeks: int | None = TREND_WEEKS) -> DataFrame:
    """The newest weeks, newest first."""
    out = (
        prs.groupBy(E.week().alias("week"))
        .agg(
            F.count("*").alias("pr_count"),
            E.merged_count().alias("merged_count"),
            F.countDistinct("author").alias("active_authors"),
            E.average("pr_size").alias("avg_pr_size"),
            E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
            E.merge_rate().alias("merge_rate"),
            F.round(F.count("*") * F.lit(1.0) / F.nullif(F.countDistinct("author"), F.lit(0)), 1).alias("prs_per_dev"),
        )
        .orderBy(F.desc_nulls_last("week"))
    )
    return out if weeks is None else out.limit(weeks)


def _by_week(prs: DataFrame, *keys: str, self_merges: bool = False) -> DataFrame:
    extra = [E.count_true(_column(prs, "self_merged", "boolean")).alias("self_merged_count")] if self_merges else []
    return prs.groupBy(*keys, E.week().alias("week")).agg(
        F.count("*").alias("pr_count"),
        E.merged_count().alias("merged_count"),
        E.average("pr_size").alias("avg_pr_size"),
        E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
        E.merge_rate().alias("merge_rate"),
        *extra,
    )


def author_weekly_stats(prs: DataFrame, author: str, weeks: int = TREND_WEEKS) -> DataFrame:
    return _by_week(prs.where(F.col("author") == author)).orderBy(F.desc_nulls_last("week")).limit(weeks)


def weekly_by_author(prs: DataFrame, self_merges: bool = False) -> DataFrame:
    """All authors' weeks at once, in place of a query an author."""
    return _by_week(prs, "author", self_merges=self_merges)


def top_authors(prs: DataFrame, limit: int = 5) -> DataFrame:
    """Ties go to the smaller name."""
    counts = prs.groupBy("author").agg(F.count("*").alias("pr_count"))
    return counts.orderBy(F.desc("pr_count"), F.asc_nulls_last("author")).limit(limit)


def monthly_stats(prs: DataFrame) -> DataFrame:
    return (
        prs.groupBy(E.month().alias("month"))
        .agg(
            F.count("*").alias("pr_count"),
            E.merged_count().alias("merged_count"),
            F.countDistinct("author").alias("active_authors"),
            E.average("pr_size").alias("avg_pr_size"),
        )
        .orderBy(F.asc_nulls_last("month"))
    )


def reviewer_rows(prs: DataFrame, trim: bool = True) -> DataFrame:
    """One row for each reviewer of each pull request; rows without reviewers have none."""
    reviewer = F.explode(F.split(_column(prs, "reviewers", "string"), ",")).alias("reviewer")
    out = prs.where(_column(prs, "reviewers", "string") != "").select("org", "repo", "author", "pr_number", reviewer)
    return out.withColumn("reviewer", F.trim("reviewer")) if trim else out


def contributor_stats_for_repo(prs: DataFrame, org: str, repo: str) -> DataFrame:
    """Authors of a repository with their own work and the pull requests they reviewed.

    Reviewers who wrote nothing there are left out.
    """
    own = scope(prs, org=org, repo=repo)
    self_merged = _column(prs, "self_merged", "boolean")
    authors = own.groupBy("author").agg(
        F.count("*").alias("pr_count"),
        E.merged_count().alias("merged_count"),
        E.merge_rate().alias("merge_rate"),
        E.average("pr_size").alias("avg_pr_size"),
        E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
        F.round(F.avg(_column(prs, "changed_files", "bigint")), 1).alias("avg_files_changed"),
        F.round(F.avg(F.when(E.is_merged(), _column(prs, "time_to_first_review_hours", "double"))), 1).alias("avg_time_to_first_review"),
        E.count_true(self_merged).alias("self_merged_count"),
    )
    given = reviewer_rows(own).groupBy("reviewer").agg(F.count("*").alias("given"))
    return (
        authors.join(given, authors["author"] == given["reviewer"], "left")
        .select(
            "author", "pr_count", "merged_count", "merge_rate", "avg_pr_size", "avg_merge_time", "avg_files_changed",
            "avg_time_to_first_review", F.coalesce("given", F.lit(0)).alias("reviews_given"), "self_merged_count",
            F.round(E.percent(F.col("self_merged_count"), F.col("merged_count")), 1).alias("self_merge_rate"),
        )
        .orderBy(F.desc("pr_count"), F.asc_nulls_last("author"))
    )


def org_baseline_stats(prs: DataFrame) -> DataFrame:
    """Averages over the frame that is passed, whatever its scope."""
    return prs.agg(
        E.merge_rate().alias("avg_merge_rate"),
        E.average_merged("time_to_merge_hours").alias("avg_merge_time"),
        E.average("pr_size").alias("avg_pr_size"),
        E.average("reviews").alias("avg_reviews"),
        F.round(F.avg(_column(prs, "changed_files", "bigint")), 1).alias("avg_files_changed"),
        F.round(F.avg(F.when(E.is_merged(), _column(prs, "time_to_first_review_hours", "double"))), 1).alias("avg_time_to_first_review"),
    )


def contributor_review_activity(prs: DataFrame) -> DataFrame:
    return (
        reviewer_rows(prs)
        .groupBy("reviewer")
        .agg(
            F.countDistinct("repo").alias("repos_reviewed"),
            F.count("*").alias("reviews_given"),
            F.countDistinct("author").alias("developers_reviewed"),
        )
        .orderBy(F.desc("reviews_given"), F.asc_nulls_last("reviewer"))
    )


def contributor_weekly_trends(prs: DataFrame, author: str, repo: str, weeks: int = CONTRIBUTOR_WEEKS) -> DataFrame:
    own = scope(prs, repo=repo, author=author)
    return _by_week(own, self_merges=True).orderBy(F.desc_nulls_last("week")).limit(weeks)


def author_totals(prs: DataFrame, author: str) -> DataFrame:
    own = prs.where(F.col("author") == author)
    return own.agg(F.count("*").alias("total_prs"), E.merged_count().alias("merged_prs"))
