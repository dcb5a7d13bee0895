"""Week-over-week changes.

Rows are read newest first, so by default a week is compared with the one after it and the
newest has no label; ``chronological`` compares with the week before. Weeks without pull
requests have no row and are not filled in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from .metrics import CONTRIBUTOR_WEEKS, TREND_WEEKS, weekly_by_author, weekly_stats


def _order(chronological: bool):
    return F.asc("week") if chronological else F.desc("week")


def team_trend(prs: DataFrame, weeks: int = TREND_WEEKS, chronological: bool = False) -> DataFrame:
    """The weekly figures with their label.

    The window has one partition: it runs on one row a week.
    """
    w = W.orderBy(_order(chronological))
    label = E.trend(E.change("pr_count", w), E.change("merge_rate", w), steady=2, mixed_signals=True)
    return weekly_stats(prs, weeks).withColumn("trend", label)


def author_trends(
    prs: DataFrame,
    weeks: int = TREND_WEEKS,
    steady: int = 1,
    mixed_signals: bool = True,
    self_merges: bool = False,
    chronological: bool = False,
) -> DataFrame:
    """Every author's newest weeks with labels; authors with fewer than two are left out."""
    newest = W.partitionBy("author").orderBy(F.desc("week"))
    w = W.partitionBy("author").orderBy(_order(chronological))
    rows = weekly_by_author(prs, self_merges).withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= weeks)
    rows = rows.withColumn("of", F.count("*").over(W.partitionBy("author"))).where(F.col("of") >= 2)
    label = E.trend(E.change("pr_count", w), E.change("merge_rate", w), steady, mixed_signals)
    return rows.withColumn("trend", label).drop("nth", "of")


def contributor_trends(prs: DataFrame, weeks: int = CONTRIBUTOR_WEEKS, chronological: bool = False) -> DataFrame:
    """As author_trends, with self-merges and without labels for mixed signals."""
    return author_trends(prs, weeks, steady=1, mixed_signals=False, self_merges=True, chronological=chronological)
