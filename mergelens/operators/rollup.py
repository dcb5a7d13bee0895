"""Roll-ups that follow the store: sums a week, author and repository, refreshed where it changed.

Weekly, monthly and overall figures come from these sums by grouping sets, so a report reads a row
an author and week in place of every pull request, and authors are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E

#: A partition of the sums; the store's partitions of its repositories belong to it.
PARTITIONS = ["org", "year", "month"]
KEYS = ["repo", "week", "author"]
SUMS = ["prs", "merged", "size", "sized", "hours", "timed"]


def partial_sums(prs: DataFrame) -> DataFrame:
    """One row for each org, month, repository, week and author of dated pull requests.

    A week that lies in two months has a row in each.
    """
    hours = F.when(E.is_merged(), F.col("time_to_merge_hours"))
    return prs.where("created_at is not null").groupBy(*PARTITIONS, "repo", E.week().alias("week"), "author").agg(
        F.count("*").alias("prs"),
        F.count(F.when(E.is_merged(), 1)).alias("merged"),
        F.sum("pr_size").alias("size"),
        F.count("pr_size").alias("sized"),
        F.sum(hours).alias("hours"),
        F.count(hours).alias("timed"),
    )


def refresh(prs: DataFrame, path: str, touched: DataFrame | None = None) -> int:
    """Write the sums of the partitions that ``touched`` (org, year, month) names; of all, if None.

    ``prs`` is the whole store: conditions on its partition columns keep the others unread. What
    was in a written partition before is replaced, so running it again changes nothing. Returns
    the number of partitions asked for, -1 for all.
    """
    asked = -1
    if touched is not None:
        keys = touched.select(*PARTITIONS).distinct().where("year is not null and month is not null").collect()  # as many as partitions
        asked = len(keys)
        if not keys:
            return 0
        month = F.col("year") * 100 + F.col("month")
        prs = prs.where(month.isin(sorted({k["year"] * 100 + k["month"] for k in keys})) & F.col("org").isin(sorted({k["org"] for k in keys})))
        prs = prs.join(F.broadcast(prs.sparkSession.createDataFrame(keys)), PARTITIONS, "left_semi")
    sums = partial_sums(prs).hint("rebalance", *PARTITIONS)
    sums.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    return asked


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    schema = "repo string, week timestamp, author string, prs long, merged long, size long, sized long, hours double, timed long, org string, year int, month int"
    return spark.read.schema(schema).parquet(path)


def roll_up(sums: DataFrame) -> DataFrame:
    """(level, org, period, ...): figures of each org's weeks and months, and of each org, repository and everything.

    ``period`` is the first moment of the week or month, else null; ``repo`` is null but for level repo.
    """
    rows = sums.withColumn("start", F.make_timestamp("year", "month", F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    of = rows.groupingSets([["org", "week"], ["org", "start"], ["org", "repo"], ["org"], []], "org", "week", "start", "repo").agg(
        F.grouping_id().alias("g"), *[F.sum(c).alias(c) for c in SUMS], F.countDistinct("author").alias("active_authors")
    )
    # bits of the grouping id from the left: org, week, start, repo; a bit is set where the column is summed over
    level = F.when(F.col("g") == 0b0011, "week").when(F.col("g") == 0b0101, "month").when(F.col("g") == 0b0110, "repo").when(F.col("g") == 0b0111, "org").otherwise("all")
    return of.select(
        level.alias("level"),
        "org",
        "repo",
        F.coalesce("week", "start").alias("period"),
        F.col("prs").alias("pr_count"),
        F.col("merged").alias("merged_count"),
        "active_authors",
        F.round(F.col("size") / F.nullif(F.col("sized"), F.lit(0)), 1).alias("avg_pr_size"),
        F.round(F.col("hours") / F.nullif(F.col("timed"), F.lit(0)), 1).alias("avg_merge_time"),
        F.round(E.percent(F.col("merged"), F.col("prs")), 1).alias("merge_rate"),
    )
