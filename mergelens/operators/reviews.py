"""Review activity from the event table: who reviewed what, when, and what followed.

All operators take the events of ``normalize_events`` (or of the store) and group or order them
within a pull request and person, so no task needs more than one pull request's events at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E

PR = ["org", "repo", "pr_number"]


def _is(kind: str) -> Column:
    return F.col("kind") == kind


def reviewer_stats(events: DataFrame) -> DataFrame:
    """Per person: reviews, the pull requests they cover, decisions, approval rate and comments made.

    ``avg_hours_to_review`` runs from the opening of others' pull requests to each of the person's
    reviews of them. Events of nobody are left out; people with comments alone have no rate.
    """
    review = _is("review")
    others = review & (F.col("actor") != F.col("author"))
    hours = F.when(others, E.hours_between(F.col("created_at"), F.col("happened_at")))
    # pull requests are counted as groups of their own, which keeps the aggregation to one pass;
    # what is not a review needs no such group, so a task's comments of a person are one
    which = [F.when(review, F.col(c)).alias(c) for c in PR]
    each = events.where("actor is not null").groupBy("actor", *which).agg(
        F.count(F.when(review, 1)).alias("reviews"),
        F.count(F.when(review & (F.col("decision") == "APPROVED"), 1)).alias("approvals"),
        F.count(F.when(review & (F.col("decision") == "CHANGES_REQUESTED"), 1)).alias("changes_requested"),
        F.count(F.when(_is("comment"), 1)).alias("comments"),
        F.sum(hours).alias("hours"),
        F.count(hours).alias("timed"),
    )
    total = each.groupBy("actor").agg(
        F.sum("reviews").alias("reviews_given"),
        F.count(F.when(F.col("reviews") > 0, 1)).alias("prs_reviewed"),
        F.sum("approvals").alias("approvals"),
        F.sum("changes_requested").alias("changes_requested"),
        F.sum("comments").alias("comments_made"),
        (F.sum("hours") / F.nullif(F.sum("timed"), F.lit(0))).alias("hours"),
    )
    return (
        total.where((F.col("reviews_given") > 0) | (F.col("comments_made") > 0))
        .select(
            F.col("actor").alias("reviewer"), "reviews_given", "prs_reviewed", "approvals", "changes_requested",
            F.round(E.percent(F.col("approvals"), F.col("reviews_given")), 1).alias("approval_rate"),
            "comments_made", F.round("hours", 1).alias("avg_hours_to_review"),
        )
        .orderBy(F.desc("reviews_given"), "reviewer")
    )


def review_turnaround(events: DataFrame) -> DataFrame:
    """Each timed review with the latest request to its reviewer before it, and the hours between.

    Requests and reviews of a person on a pull request are one stream in order of time; a request
    at a review's own moment comes before it. A review that nobody asked for before has a null
    ``requested_at`` and counts from the opening of the pull request.
    """
    stream = events.where((_is("review") | _is("request")) & F.col("happened_at").isNotNull())
    asked = F.when(_is("request"), F.col("happened_at"))
    before = W.partitionBy(*PR, "actor").orderBy("happened_at", _is("review"), "seq").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = stream.withColumn("requested_at", F.last_value(asked, ignoreNulls=True).over(before)).where(_is("review"))
    since = F.coalesce("requested_at", "created_at")
    return rows.select(
        *PR, F.col("actor").alias("reviewer"), "seq", F.col("happened_at").alias("reviewed_at"), "requested_at", E.hours_between(since, F.col("happened_at")).alias("hours")
    )


def turnaround_by_reviewer(events: DataFrame) -> DataFrame:
    """Per reviewer: reviews, those after a request, and mean and longest hours of both sorts."""
    asked = F.col("requested_at").isNotNull()
    out = review_turnaround(events).where("reviewer is not null").groupBy("reviewer").agg(
        F.count("*").alias("reviews"),
        F.count(F.when(asked, 1)).alias("requested_reviews"),
        F.round(F.avg(F.when(asked, F.col("hours"))), 2).alias("avg_hours_after_request"),
        F.round(F.avg(F.when(~asked, F.col("hours"))), 2).alias("avg_hours_after_opening"),
        F.round(F.max("hours"), 2).alias("longest_hours"),
    )
    return out.orderBy(F.asc_nulls_last("avg_hours_after_request"), "reviewer")


def revision_cycles(events: DataFrame) -> DataFrame:
    """Per pull request with commits or reviews: how often work went on after a review.

    Timed commits and reviews are read in order (at one moment commits first, then by number). A
    cycle begins with a commit whose predecessor is a review; ``rework_hours`` sums the time from
    those reviews to those commits. ``commits_after_review`` counts all commits that follow the
    first review. ``outcome`` is the decision of the last review that approved or asked for
    changes, or null.
    """
    steps = events.where((_is("commit") | _is("review")) & F.col("happened_at").isNotNull())
    steps = steps.dropDuplicates([*PR, "kind", "seq"])  # a commit has a row for each author
    order = W.partitionBy(*PR).orderBy("happened_at", _is("review"), "seq")
    steps = steps.select(
        *PR, "kind", "happened_at", "seq", "decision",
        F.lag("kind").over(order).alias("last_kind"),
        F.lag("happened_at").over(order).alias("last_at"),
        F.max(_is("review")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("reviewed"),
    )
    turn = _is("commit") & (F.col("last_kind") == "review")
    decided = F.when(F.col("decision").isin("APPROVED", "CHANGES_REQUESTED"), F.struct("happened_at", "seq", "decision"))
    return steps.groupBy(*PR).agg(
        F.count(F.when(_is("commit"), 1)).alias("commits"),
        F.count(F.when(_is("review"), 1)).alias("reviews"),
        F.count(F.when(turn, 1)).alias("cycles"),
        F.count(F.when(_is("commit") & F.col("reviewed"), 1)).alias("commits_after_review"),
        F.round(F.coalesce(F.sum(F.when(turn, E.hours_between(F.col("last_at"), F.col("happened_at")))), F.lit(0.0)), 2).alias("rework_hours"),
        F.max(decided)["decision"].alias("outcome"),
    )


def requested_reviews(events: DataFrame) -> DataFrame:
    """Each person asked for, or giving, a review of a pull request that is not their own.

    ``status``: responded (asked and reviewed), silent (asked alone), unasked (reviewed alone). Events
    are grouped once, in which nulls are equal, so unnamed people of a pull request are one.
    ``first_hours`` runs from the first request to the first review at that moment or later.
    """
    both = events.where((_is("review") | _is("request")) & ~F.col("actor").eqNullSafe(F.col("author")))
    asked = F.when(_is("request"), F.col("happened_at"))
    rows = both.withColumn("requested_at", F.min(asked).over(W.partitionBy(*PR, "actor")))
    pairs = rows.groupBy(*PR, "actor").agg(
        F.count(F.when(_is("request"), 1)).alias("requests"),
        F.count(F.when(_is("review"), 1)).alias("reviews"),
        F.min("requested_at").alias("requested_at"),
        F.min(F.when(_is("review") & (F.col("happened_at") >= F.col("requested_at")), F.col("happened_at"))).alias("answered_at"),
    )
    status = F.when((F.col("requests") > 0) & (F.col("reviews") > 0), "responded").when(F.col("requests") > 0, "silent").otherwise("unasked")
    return pairs.select(
        *PR, F.col("actor").alias("reviewer"), "requests", "reviews", status.alias("status"),
        E.hours_between(F.col("requested_at"), F.col("answered_at")).alias("first_hours"),
    )


def response_rates(events: DataFrame) -> DataFrame:
    """Per person: how many requests (one a pull request) led to a review, and how soon; silent people too."""
    asked = F.col("status") != "unasked"
    out = requested_reviews(events).where("reviewer is not null").groupBy("reviewer").agg(
        F.count(F.when(asked, 1)).alias("requested"),
        F.count(F.when(F.col("status") == "responded", 1)).alias("responded"),
        F.count(F.when(~asked, 1)).alias("unasked"),
        F.round(F.avg("first_hours"), 2).alias("avg_first_hours"),
    )
    return out.withColumn("response_rate", F.round(E.percent(F.col("responded"), F.col("requested")), 1)).orderBy(F.desc("requested"), "reviewer")


def co_authors(events: DataFrame) -> DataFrame:
    """(repo, a, b, prs): pairs of people who both wrote commits of a pull request, and of how many.

    Pairs are made by a join on the pull request, which Spark can split where one has very many
    authors, and are counted with partial aggregation.
    """
    wrote = events.where(_is("commit") & F.col("actor").isNotNull()).select(*PR, "actor").distinct()
    other = wrote.withColumnRenamed("actor", "b")
    pairs = wrote.withColumnRenamed("actor", "a").join(other, PR).where(F.col("a") < F.col("b"))
    return pairs.groupBy("org", "repo", "a", "b").agg(F.count("*").alias("prs")).orderBy(F.desc("prs"), "org", "repo", "a", "b")


def co_authorship_rate(events: DataFrame) -> DataFrame:
    """Per repository: pull requests with commits, those of several authors, and their share."""
    each = events.where(_is("commit")).select(*PR, "actor").distinct().groupBy(*PR).agg(F.count("actor").alias("authors"))
    out = each.groupBy("org", "repo").agg(F.count("*").alias("prs"), F.count(F.when(F.col("authors") > 1, 1)).alias("co_authored"))
    return out.withColumn("co_authorship_rate", F.round(E.percent(F.col("co_authored"), F.col("prs")), 1)).orderBy("org", "repo")
