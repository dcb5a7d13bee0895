"""When people submit, and how long reviews take: streaks, gaps and mergeable quantiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E


def streaks(prs: DataFrame) -> DataFrame:
    """(author, from_week, to_week, weeks, prs): runs of consecutive weeks with a pull request.

    Gaps and islands over one row a week and author: within a run the week's number less its rank
    stays the same. Rows without a time or author belong to none.
    """
    weeks = prs.where("created_at is not null and author is not null").groupBy("author", E.week().alias("week")).agg(F.count("*").alias("prs"))
    rank = F.row_number().over(W.partitionBy("author").orderBy("week"))
    island = F.floor(F.datediff("week", F.lit("1970-01-05")) / 7) - rank
    return weeks.withColumn("island", island).groupBy("author", "island").agg(
        F.min("week").alias("from_week"), F.max("week").alias("to_week"), F.count("*").alias("weeks"), F.sum("prs").alias("prs")
    ).drop("island")


def submission_frequency(prs: DataFrame) -> DataFrame:
    """Per author: active weeks, pull requests a week of their span, longest streak and longest pause in weeks.

    The span runs from the first active week to the last; a pause is a number of weeks without a
    pull request between two that have one.
    """
    runs = streaks(prs)
    before = W.partitionBy("author").orderBy("from_week")
    pause = F.datediff("from_week", F.lag("to_week").over(before)) / 7 - 1
    out = runs.withColumn("pause", pause).groupBy("author").agg(
        F.sum("weeks").alias("active_weeks"),
        F.max("weeks").alias("longest_streak"),
        F.coalesce(F.max("pause"), F.lit(0.0)).cast("long").alias("longest_pause"),
        F.sum("prs").alias("prs"),
        (F.datediff(F.max("to_week"), F.min("from_week")) / 7 + 1).alias("span"),
    )
    per_week = F.round(F.col("prs") / F.col("span"), 2)
    return out.select("author", "prs", "active_weeks", F.col("span").cast("long").alias("span_weeks"), "longest_streak", "longest_pause", per_week.alias("prs_per_week")).orderBy(F.desc("prs"), "author")


#: Buckets grow by this factor, so a quantile read from them is off by half of it at most.
GROWTH = 1.02
#: Hours below this share the first bucket.
LEAST = 1.0 / 60


def response_histogram(prs: DataFrame, hours: str = "time_to_first_review_hours") -> DataFrame:
    """(org, week, bucket, n): counts of response times in buckets that grow geometrically.

    Histograms add up: those of weeks give those of months or of several orgs, without the rows.
    Bucket 0 holds times up to LEAST (negative ones too), bucket b those up to LEAST * GROWTH ** b.
    """
    bucket = F.when(F.col(hours) <= LEAST, 0).otherwise(F.ceil(F.log(F.col(hours) / F.lit(LEAST)) / F.log(F.lit(GROWTH)))).cast("int")
    rows = prs.where(F.col(hours).isNotNull() & F.col("created_at").isNotNull())
    return rows.groupBy("org", E.week().alias("week"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def response_quantiles(histogram: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """``by``, n, and a column p<percent> for each share: the response time that so many are at or below.

    Exact in rank; the value is the middle of its bucket, at most 1 % off (GROWTH).
    """
    each = histogram.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    order = W.partitionBy(*by).orderBy("bucket")
    each = each.withColumns({"upto": F.sum("n").over(order), "of": F.sum("n").over(W.partitionBy(*by))})
    middle = F.when(F.col("bucket") == 0, F.lit(LEAST)).otherwise(F.lit(LEAST) * F.pow(F.lit(GROWTH), F.col("bucket") - 0.5))
    found = [
        F.min(F.when(F.col("upto") >= F.ceil(F.lit(s) * F.col("of")), F.struct("bucket", F.round(middle, 4).alias("v"))))["v"].alias(f"p{round(100 * s)}") for s in shares
    ]
    return each.groupBy(*by).agg(F.max("of").alias("n"), *found)
