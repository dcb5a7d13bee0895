"""From nested raw pull requests to flat rows, in native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from ..schema import EVENT_KEYS, EVENT_LISTS, FLAT_EVENT, FLAT_PR


_EVENTS = "array<struct<kind: string, seq: int, actor: string, happened_at: timestamp, decision: string>>"


def _moment(text: Column) -> Column:
    return F.try_to_timestamp(text)


def _size(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)).cast("long")


def normalize(raw: DataFrame, org: str | Column) -> DataFrame:
    """Flat rows of a frame with the raw fields and ``repo``.

    A missing author is ``unknown``; missing lists are empty; missing counts are 0. Reviewers
    are distinct, sorted and joined by commas; labels keep their order, an unnamed one is an
    empty string. Times that cannot be read are null.
    """
    org = F.lit(org) if isinstance(org, str) else org
    created, merged, closed = (_moment(F.col(c)) for c in ("createdAt", "mergedAt", "closedAt"))
    login, merger = F.col("author.login"), F.col("mergedBy.login")
    reviewers = F.filter(F.col("reviews.author.login"), lambda x: x.isNotNull() & (x != ""))
    first_review = F.array_min(F.transform(F.col("reviews.submittedAt"), _moment))
    flat = raw.select(
        org.alias("org"),
        F.col("repo"),
        F.year(created).alias("year"),
        F.month(created).alias("month"),
        F.col("number").alias("pr_number"),
        F.coalesce(login, F.lit("unknown")).alias("author"),
        created.alias("created_at"),
        merged.alias("merged_at"),
        F.when(merged.isNotNull(), "merged").when(closed.isNotNull(), "closed").otherwise("open").alias("state"),
        (F.coalesce("additions", F.lit(0)) + F.coalesce("deletions", F.lit(0))).alias("pr_size"),
        _size(F.col("commits")).alias("commits"),
        _size(F.col("reviews")).alias("reviews"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(reviewers)), ","), F.lit("")).alias("reviewers"),
        E.hours_between(created, merged).alias("time_to_merge_hours"),
        E.hours_between(created, first_review).alias("time_to_first_review_hours"),
        merger.alias("merged_by"),
        F.coalesce("changedFiles", F.lit(0)).alias("changed_files"),
        _size(F.col("comments")).alias("comments_count"),
        F.coalesce((login == merger) & (login != ""), F.lit(False)).alias("self_merged"),
        F.coalesce("isDraft", F.lit(False)).alias("is_draft"),
        F.coalesce(F.array_join(F.transform(F.col("labels"), lambda x: F.coalesce(x["name"], F.lit(""))), ","), F.lit("")).alias("labels"),
    )
    return flat.select(*[F.col(f.name).cast(f.dataType) for f in FLAT_PR])


#: The kinds of events, in the order of their lists.
KINDS = ("review", "request", "comment", "commit")


def normalize_events(raw: DataFrame, org: str | Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The events of raw pull requests: a row for each review, request, comment and commit author.

    ``seq`` numbers a pull request's events of a kind from 0 in the order of its list; authors of
    one commit share a number and are distinct. A request without a time counts as made when the
    pull request was opened; other times that are missing or cannot be read are null. A missing
    or empty name is null. Year and month are the pull request's, so both tables have the same partitions.
    Lists of other ``kinds`` than those asked for are neither read nor made.
    """
    # one pass over the raw rows: the lists are joined and then exploded
    flat = event_lists(raw, org, kinds).select(*EVENT_KEYS, F.inline("events"))
    return flat.select(*[F.col(f.name).cast(f.dataType) for f in FLAT_EVENT])


def event_lists(raw: DataFrame, org: str | Column, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same with a row for each raw pull request and its events as a list, which can be empty.

    ``year`` and ``month`` are those of the raw rows, if they have them.
    """
    if not kinds or set(kinds) - set(KINDS):
        raise ValueError(f"kinds are some of {', '.join(KINDS)}")
    org = F.lit(org) if isinstance(org, str) else org
    created = _moment(F.col("createdAt"))

    def name(x: Column) -> Column:
        return F.nullif(x, F.lit(""))

    def event(kind: str, i: Column, actor: Column, at: Column, decision: Column | None = None) -> Column:
        decision = F.lit(None).cast("string") if decision is None else decision
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("seq"), name(actor).alias("actor"), at.alias("happened_at"), decision.alias("decision"))

    reviews = F.transform("reviews", lambda x, i: event("review", i, x["author"]["login"], _moment(x["submittedAt"]), x["state"]))
    requests = F.transform("reviewRequests", lambda x, i: event("request", i, x["login"], F.coalesce(_moment(x["requestedAt"]), created)))
    comments = F.transform("comments", lambda x, i: event("comment", i, x["author"]["login"], _moment(x["createdAt"])))
    nobody = F.array(F.lit(None).cast("string"))
    commits = F.flatten(
        F.transform(
            "commits",
            lambda x, i: F.transform(
                # a commit without authors is an event of nobody
                F.coalesce(F.when(F.size(x["authors"]) > 0, F.array_distinct(x["authors"]["login"])), nobody),
                lambda who: event("commit", i, who, _moment(x["committedDate"])),
            ),
        )
    )
    lists = dict(zip(KINDS, (reviews, requests, comments, commits), strict=True))
    each = F.concat(*[F.coalesce(lists[k], F.array().cast(_EVENTS)) for k in KINDS if k in kinds])
    own = set(raw.columns)
    flat = raw.select(
        org.alias("org"),
        "repo",
        F.col("year") if "year" in own else F.year(created).alias("year"),
        F.col("month") if "month" in own else F.month(created).alias("month"),
        F.col("number").alias("pr_number"),
        F.coalesce("author.login", F.lit("unknown")).alias("author"),
        created.alias("created_at"),
        each.alias("events"),
    )
    return flat.select(*[F.col(f.name).cast(f.dataType) for f in EVENT_LISTS])


def created_since(raw: DataFrame, since: str) -> DataFrame:
    """Raw rows whose creation day, as text, is not before ``since`` (YYYY-MM-DD)."""
    return raw.where(F.substring("createdAt", 1, 10) >= since)
