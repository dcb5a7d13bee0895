"""Boundaries of the review operators, and the event table beside the store."""

import json
from datetime import datetime

from pyspark.sql import functions as F

from mergelens.operators import reviews
from mergelens.operators.normalize import normalize, normalize_events
from mergelens.schema import FLAT_EVENT, RAW_PR
from mergelens.sources import store

DAY = "2024-02-01T"


def events(spark, *records):
    return normalize_events(raw(spark, *records), "o")


def raw(spark, *records):
    rows = spark.createDataFrame([("r", json.dumps({"number": i, "createdAt": f"{DAY}00:00:00Z", "author": {"login": "me"}, **r})) for i, r in enumerate(records)], "repo string, value string")
    return rows.select("repo", F.from_json("value", RAW_PR).alias("p")).select("repo", "p.*")


def who(name):
    return {"login": name}


def review(name, hour, state="COMMENTED"):
    return {"author": who(name) if name else None, "submittedAt": f"{DAY}{hour:02d}:00:00Z", "state": state}


def request(name, hour=None):
    return {"login": name} | ({"requestedAt": f"{DAY}{hour:02d}:00:00Z"} if hour is not None else {})


def commit(hour, *names):
    return {"oid": "x", "committedDate": f"{DAY}{hour:02d}:00:00Z", "authors": [who(n) for n in names]}


def test_events_of_every_kind(spark):
    pr = {"reviews": [review("a", 3, "APPROVED"), review(None, 4)], "reviewRequests": [request("b")], "comments": [{"author": who(""), "createdAt": "soon"}],
          "commits": [commit(1, "me", "a", "me"), commit(2)]}
    df = events(spark, pr, {}, {"reviews": None, "commits": []})
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in FLAT_EVENT]
    got = sorted(((r["kind"], r["seq"], r["actor"], r["happened_at"] and r["happened_at"].hour, r["decision"]) for r in df.collect()), key=repr)
    assert got == sorted(
        [("review", 0, "a", 3, "APPROVED"), ("review", 1, None, 4, "COMMENTED"), ("request", 0, "b", 0, None), ("comment", 0, None, None, None),
         ("commit", 0, "me", 1, None), ("commit", 0, "a", 1, None), ("commit", 1, None, 2, None)], key=repr)


def test_turnaround_takes_the_latest_request_before(spark):
    pr = {"reviewRequests": [request("a", 2), request("a", 5), request("a", 9), request("b", 8)], "reviews": [review("a", 5), review("a", 7), review("b", 6), review(None, 1)]}
    got = sorted((str(r["reviewer"]), r["reviewed_at"].hour, r["requested_at"] and r["requested_at"].hour, r["hours"]) for r in reviews.review_turnaround(events(spark, pr)).collect())
    # a request of the review's own moment counts; later ones and those to others do not
    assert got == [("None", 1, None, 1.0), ("a", 5, 5, 0.0), ("a", 7, 5, 2.0), ("b", 6, None, 6.0)]
    (a, b) = reviews.turnaround_by_reviewer(events(spark, pr)).collect()
    assert (a["reviewer"], a["requested_reviews"], a["avg_hours_after_request"], a["avg_hours_after_opening"]) == ("a", 2, 1.0, None)
    assert (b["reviewer"], b["requested_reviews"], b["avg_hours_after_opening"], b["longest_hours"]) == ("b", 0, 6.0, 6.0)


def test_revision_cycles_fold_the_order_of_events(spark):
    pr = {"commits": [commit(1, "me"), commit(4, "me", "a"), commit(5, "me"), commit(9, "me"), commit(7, "me")],
          "reviews": [review("a", 3, "CHANGES_REQUESTED"), review("a", 7, "APPROVED"), review("b", 8)]}
    got = {r["pr_number"]: r for r in reviews.revision_cycles(events(spark, pr, {}, {"reviews": [review("a", 1)]})).collect()}
    # 1c 3r 4c 5c 7c 7r 8r 9c: a commit of a review's own moment comes before it
    r = got[0]
    assert (r["commits"], r["reviews"], r["cycles"], r["commits_after_review"], r["rework_hours"], r["outcome"]) == (5, 3, 2, 4, 2.0, "APPROVED")
    assert 1 not in got and (got[2]["cycles"], got[2]["rework_hours"], got[2]["outcome"]) == (0, 0.0, None)


def test_requests_and_reviews_match_null_safe(spark):
    pr = {"reviewRequests": [request("a", 1), request("quiet", 1), request("me", 1), request("early", 9)],
          "reviews": [review("a", 3), review("a", 2), review("guest", 4), review("me", 5), review("early", 2), review(None, 6)]}
    got = {r["reviewer"]: (r["status"], r["first_hours"]) for r in reviews.requested_reviews(events(spark, pr)).collect()}
    assert got == {"a": ("responded", 1.0), "quiet": ("silent", None), "guest": ("unasked", None), "early": ("responded", None), None: ("unasked", None)}
    rates = {r["reviewer"]: (r["requested"], r["responded"], r["response_rate"]) for r in reviews.response_rates(events(spark, pr)).collect()}
    assert rates == {"a": (1, 1, 100.0), "early": (1, 1, 100.0), "quiet": (1, 0, 0.0), "guest": (0, 0, None)}


def test_reviewer_stats(spark):
    df = events(spark, {"reviews": [review("a", 2, "APPROVED"), review("a", 4), review("me", 6)], "comments": [{"author": who("c"), "createdAt": f"{DAY}01:00:00Z"}]})
    got = [tuple(r) for r in reviews.reviewer_stats(df).collect()]
    assert got == [("a", 2, 1, 1, 0, 50.0, 0, 3.0), ("me", 1, 1, 0, 0, 0.0, 0, None), ("c", 0, 0, 0, 0, None, 1, None)]


def test_co_authors(spark):
    df = events(spark, {"commits": [commit(1, "a", "b"), commit(2, "c")]}, {"commits": [commit(1, "b"), commit(2, "a", "a")]}, {"commits": [commit(1)]})
    assert [(r["a"], r["b"], r["prs"]) for r in reviews.co_authors(df).collect()] == [("a", "b", 2), ("a", "c", 1), ("b", "c", 1)]
    (r,) = reviews.co_authorship_rate(df).collect()
    assert (r["prs"], r["co_authored"], r["co_authorship_rate"]) == (3, 2, 66.7)


def test_nothing(spark):
    empty = events(spark).where("false")
    for f in (reviews.reviewer_stats, reviews.review_turnaround, reviews.revision_cycles, reviews.requested_reviews, reviews.response_rates, reviews.co_authors):
        assert f(empty).collect() == []


def both(spark, *records):
    r = raw(spark, *records)
    return normalize(r, "o"), normalize_events(r, "o")


def kept(spark, folder):
    return sorted((r["pr_number"], r["kind"], r["actor"]) for r in store.read_events(spark, f"{folder}/events").collect())


def test_events_are_stored_with_their_pull_requests(spark, tmp_path):
    folder = str(tmp_path)
    assert store.read_events(spark, f"{folder}/events") is None
    store.write_both(*both(spark, {"reviews": [review("a", 1)]}, {"reviews": [review("b", 1), review("b", 1)]}), folder)
    assert kept(spark, folder) == [(0, "review", "a"), (1, "review", "b"), (1, "review", "b")]
    # an update replaces its own pull request's events and leaves the other's
    store.write_both(*both(spark, {"comments": [{"author": who("c"), "createdAt": f"{DAY}05:00:00Z"}]}), folder, keep_others=True)
    assert kept(spark, folder) == [(0, "comment", "c"), (1, "review", "b"), (1, "review", "b")]
    # the last events of a partition go too
    store.write_both(*both(spark, {}, {}), folder, keep_others=True)
    assert kept(spark, folder) == [] and store.read_store(spark, f"{folder}/data").count() == 2
    later = both(spark, {"number": 7, "createdAt": "2024-03-01T00:00:00Z", "reviews": [review("z", 1)]})
    store.write_both(*later, folder)
    store.write_both(*later, folder)
    assert kept(spark, folder) == [(7, "review", "z")]
    pruned = store.read_events(spark, f"{folder}/events").where(F.col("created_at") >= F.lit(datetime(2024, 3, 1))).where("year = 2024 and month = 3")
    assert "PartitionFilters: [isnotnull(year" in pruned._jdf.queryExecution().executedPlan().toString()
    assert not store.write_both(*both(spark), folder)
