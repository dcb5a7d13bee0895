"""Schemas of raw and flat pull requests."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_TEXT, _LONG, _TIME, _FLAG, _DOUBLE = StringType(), LongType(), TimestampType(), BooleanType(), DoubleType()


def _struct(**fields: DataType) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


_PERSON = _struct(login=_TEXT)

#: Nested records as the hosting service's command-line tool prints them.
RAW_PR = _struct(
    number=_LONG,
    author=_PERSON,
    title=_TEXT,
    createdAt=_TEXT,
    mergedAt=_TEXT,
    closedAt=_TEXT,
    state=_TEXT,
    additions=_LONG,
    deletions=_LONG,
    isDraft=_FLAG,
    labels=ArrayType(_struct(name=_TEXT)),
    reviewDecision=_TEXT,
    reviews=ArrayType(_struct(author=_PERSON, submittedAt=_TEXT, state=_TEXT)),
    reviewRequests=ArrayType(_struct(login=_TEXT, requestedAt=_TEXT)),
    mergedBy=_PERSON,
    comments=ArrayType(_struct(author=_PERSON, createdAt=_TEXT)),
    changedFiles=_LONG,
    commits=ArrayType(_struct(oid=_TEXT, committedDate=_TEXT, authors=ArrayType(_PERSON))),
)

#: One wide row for each pull request.
FLAT_PR = _struct(
    org=_TEXT,
    repo=_TEXT,
    year=IntegerType(),
    month=IntegerType(),
    pr_number=_LONG,
    author=_TEXT,
    created_at=_TIME,
    merged_at=_TIME,
    state=_TEXT,
    pr_size=_LONG,
    commits=_LONG,
    reviews=_LONG,
    reviewers=_TEXT,
    time_to_merge_hours=_DOUBLE,
    time_to_first_review_hours=_DOUBLE,
    merged_by=_TEXT,
    changed_files=_LONG,
    comments_count=_LONG,
    self_merged=_FLAG,
    is_draft=_FLAG,
    labels=_TEXT,
)

#: One row for each review, request, comment and author of a commit; a pull request's are kept together.
FLAT_EVENT = _struct(
    org=_TEXT,
    repo=_TEXT,
    year=IntegerType(),
    month=IntegerType(),
    pr_number=_LONG,
    author=_TEXT,
    created_at=_TIME,
    kind=_TEXT,
    seq=IntegerType(),
    actor=_TEXT,
    happened_at=_TIME,
    decision=_TEXT,
)

EVENT_KEYS = ("org", "repo", "year", "month", "pr_number", "author", "created_at")

#: The same with the events of a pull request as one list, as the store keeps them.
EVENT_LISTS = StructType(
    [
        *[FLAT_EVENT[c] for c in EVENT_KEYS],
        StructField("events", ArrayType(StructType([f for f in FLAT_EVENT if f.name not in EVENT_KEYS]))),
    ]
)

PARTITIONS = ("org", "repo", "year", "month")

#: Fields that older files lack.
LATER_FIELDS = ("reviewers", "time_to_first_review_hours", "merged_by", "changed_files", "comments_count", "self_merged")
