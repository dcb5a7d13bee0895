import json

import pytest
from pyspark.sql import functions as F

from mergelens.operators.normalize import created_since, normalize
from mergelens.schema import FLAT_PR, RAW_PR

AT = "2025-03-10T08:00:00Z"


def flat(spark, *records):
    rows = spark.createDataFrame([("r", json.dumps({"number": i, "createdAt": AT, **r})) for i, r in enumerate(records)], "repo string, value string")
    raw = rows.select("repo", F.from_json("value", RAW_PR).alias("p")).select("repo", "p.*")
    return normalize(raw, "o").orderBy("pr_number").collect()


def test_schema(spark):
    rows = spark.createDataFrame([], "repo string, value string").select("repo", F.from_json("value", RAW_PR).alias("p")).select("repo", "p.*")
    out = normalize(rows, "o")
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in FLAT_PR]
    assert out.count() == 0


@pytest.mark.parametrize("author", [None, {}])
def test_missing_author(spark, author):
    (r,) = flat(spark, {"author": author, "mergedBy": {"login": "unknown"}})
    assert r["author"] == "unknown" and r["self_merged"] is False


def test_merging(spark):
    own, other, none, both = flat(
        spark,
        {"author": {"login": "a"}, "mergedBy": {"login": "a"}, "mergedAt": "2025-03-10T20:00:00Z"},
        {"author": {"login": "a"}, "mergedBy": {"login": "b"}, "closedAt": AT},
        {"author": {"login": "a"}, "mergedBy": None},
        {"mergedAt": AT, "closedAt": AT, "state": "OPEN"},
    )
    assert (own["self_merged"], own["state"], own["time_to_merge_hours"]) == (True, "merged", 12.0)
    assert (other["self_merged"], other["merged_by"], other["state"]) == (False, "b", "closed")
    assert (none["self_merged"], none["merged_by"], none["state"]) == (False, None, "open")
    assert both["state"] == "merged"


def test_counts_and_lists(spark):
    review = lambda who, at=None: {"author": {"login": who} if who is not None else None, "submittedAt": at}
    a, b = flat(
        spark,
        {"additions": None, "deletions": 7, "labels": [{"name": "b"}, {}, {"name": "a"}],
         "reviews": [review(None), review("z", "2025-03-10T07:00:00Z"), review(""), review("B"), review("z", AT)]},
        {"reviews": [], "labels": None, "changedFiles": None, "isDraft": None},
    )
    assert (a["pr_size"], a["labels"], a["reviews"], a["reviewers"], a["commits"]) == (7, "b,,a", 5, "B,z", 0)
    assert a["time_to_first_review_hours"] == -1.0
    assert (b["reviews"], b["reviewers"], b["labels"], b["changed_files"], b["is_draft"]) == (0, "", "", 0, False)
    assert b["time_to_first_review_hours"] is None


def test_month_edge_and_bad_times(spark):
    edge, bad = flat(spark, {"createdAt": "2025-03-31T23:59:59Z"}, {"createdAt": "soon"})
    assert (edge["year"], edge["month"]) == (2025, 3)
    assert bad["created_at"] is None and bad["year"] is None


def test_created_since(spark):
    raw = spark.createDataFrame([("2025-03-09T23:00:00Z",), (AT,), (None,)], "createdAt string")
    assert created_since(raw, "2025-03-10").count() == 1
