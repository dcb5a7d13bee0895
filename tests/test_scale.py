"""What the larger tables must not bring: shuffles, text and memory that the work does not need."""

import gzip
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from mergelens import checkpoints
from mergelens.operators import normalize, reviews, rollup
from mergelens.plans import catalog, fixture
from mergelens.schema import EVENT_LISTS, RAW_PR
from mergelens.sources import store
from mergelens.sources.tool import LandedTool
from mergelens.streaming import weekly


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def unicast(spark):
    """Joins as on tables too large to broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["review_turnaround", "requested_reviews", "revision_cycles", "review_events"])
def test_events_are_grouped_where_their_lines_are(spark, sf, unicast, name):
    plan = _plan(catalog.queries()[name](spark, sf))
    assert "from_json" not in plan and "Generate inline" in plan
    assert "Exchange" not in plan[: plan.index("Generate inline")]


def test_lines_are_shuffled_once_for_flat_rows(spark, sf, unicast):
    plan = _plan(fixture.derive_prs(spark, sf))
    assert "Expand" not in plan and plan.count("Exchange hashpartitioning(l_orderkey") == 1


def test_events_of_some_kinds(spark, sf):
    raw = fixture.nested_prs(spark, sf)
    every = normalize.normalize_events(raw, "o")
    some = normalize.normalize_events(raw, "o", ("commit", "review"))
    want = every.where("kind in ('commit', 'review')")
    assert some.exceptAll(want).isEmpty() and want.exceptAll(some).isEmpty()
    with pytest.raises(ValueError):
        normalize.normalize_events(raw, "o", ("merge",))


def test_comments_of_a_person_are_one_group(spark):
    rows = "select 'o' org, 'r' repo, id pr_number, 'a' author, timestamp '2024-01-01' created_at, 'comment' kind, 0 seq, 'b' actor, timestamp '2024-01-02' happened_at, cast(null as string) decision from range(50)"
    events = spark.sql(rows)
    (got,) = reviews.reviewer_stats(events).collect()
    assert (got.reviews_given, got.prs_reviewed, got.comments_made, got.approval_rate) == (0, 0, 50, None)


def test_landed_tool_holds_the_newest_alone(tmp_path):
    folder = tmp_path / "org=o" / "repo=r"
    folder.mkdir(parents=True)
    with gzip.open(folder / "part-0.txt.gz", "wt") as f:
        for i in range(20_000):
            f.write(json.dumps({"number": i, "createdAt": f"2024-01-{i % 28 + 1:02d}", "title": "x" * 500}) + "\n")
    LandedTool(str(tmp_path))(["gh", "repo", "list", "o"])  # imports
    tracemalloc.start()
    done = LandedTool(str(tmp_path))(["gh", "pr", "list", "--repo", "o/r", "--limit", "3"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [p["number"] for p in json.loads(done.stdout)] == [19991, 19963, 19935]
    assert peak < 2_000_000  # of 11 MB


def test_batches_do_not_grow_with_files_and_state_is_on_disk(spark, tmp_path, monkeypatch):
    line = json.dumps({"number": 1, "author": {"login": "a"}, "createdAt": "2024-01-01T00:00:00Z"})
    folder = tmp_path / "landed" / "org=o" / "repo=r"
    folder.mkdir(parents=True)
    for i in range(40):
        (folder / f"part-{i}.txt").write_text(line + "\n")
    monkeypatch.setattr(catalog, "landed", lambda *_: str(tmp_path / "landed"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    running = weekly.start(catalog._landed_stream(spark, "", 4), str(tmp_path / "out"), str(tmp_path / "progress"), lateness="36500 days")
    running.awaitTermination()
    offsets = tmp_path / "progress" / "offsets"
    assert len([p for p in (tmp_path / "progress" / "sources" / "0").iterdir() if p.name.isdigit()]) == 4
    assert "RocksDB" in (offsets / "0").read_text()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    assert [r.opened for r in weekly.newest_sums(spark, str(tmp_path / "out")).collect()] == [1]


def _merged_twice(spark, folder):
    """A store of three pull requests in two partitions, and the first of them to upsert."""
    start = ["2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", "2024-02-01T00:00:00Z"]
    raw = spark.createDataFrame(
        [({"login": "a"}, i, t, [({"login": "b"}, t, "APPROVED")] * 2, "r") for i, t in enumerate(start)],
        RAW_PR_ROW,
    )
    prs, lists = normalize.normalize(spread(raw), "o"), normalize.event_lists(spread(raw), "o")
    store.write_both(prs, lists, folder)
    return prs.where("pr_number = 0"), lists.where("pr_number = 0")


RAW_PR_ROW = "author struct<login: string>, number long, createdAt string, reviews array<struct<author: struct<login: string>, submittedAt: string, state: string>>, repo string"


def spread(raw):
    """The other raw fields as nulls."""
    return raw.select("repo", *[F.col(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in RAW_PR])


def test_the_store_has_a_row_for_a_pull_request(spark, tmp_path):
    _merged_twice(spark, str(tmp_path))
    kept = spark.read.parquet(f"{tmp_path}/events").where("events is not null")
    assert sorted((r["pr_number"], len(r["events"])) for r in kept.collect()) == [(0, 2), (1, 2), (2, 2)]
    assert store.read_events(spark, f"{tmp_path}/events").count() == 6


def test_flat_files_of_an_older_store_are_read_and_upserted(spark, tmp_path):
    some, lists = _merged_twice(spark, f"{tmp_path}/new")
    flat = store.read_events(spark, f"{tmp_path}/new/events")
    flat.write.partitionBy("org", "repo", "year", "month").parquet(f"{tmp_path}/old")
    again = store.read_events(spark, f"{tmp_path}/old")
    assert again.exceptAll(flat).isEmpty() and flat.exceptAll(again).isEmpty()
    store.write_events(some, lists.where("false"), f"{tmp_path}/old", keep_others=True)
    assert sorted(r["pr_number"] for r in store.read_events(spark, f"{tmp_path}/old").collect()) == [1, 1, 2, 2]


def test_an_upsert_reads_its_partitions_and_shuffles_nothing_else(spark, unicast, tmp_path, monkeypatch):
    some, lists = _merged_twice(spark, str(tmp_path))
    seen = []
    real = checkpoints.staged
    monkeypatch.setattr(checkpoints, "staged", lambda df: seen.append(df) or real(df))
    store.write_both(some, lists, str(tmp_path), keep_others=True)
    assert len(seen) == 2
    for df, table in zip(seen, ("events", "data"), strict=True):
        plan = _plan(df)
        scan = next(line for line in plan.splitlines() if f"{tmp_path}/{table}" in line)
        assert "month#" in scan[scan.index("PartitionFilters") :] and "PartitionFilters: []" not in scan
        semi = next(line for line in plan.splitlines() if "LeftSemi" in line)
        assert "BroadcastHashJoin" in semi
    assert sorted(r["pr_number"] for r in store.read_events(spark, f"{tmp_path}/events").collect()) == [0, 0, 1, 1, 2, 2]


def test_placed_lists_are_written_as_they_lie(spark, sf, unicast, tmp_path):
    lists = normalize.event_lists(fixture.placed_prs(spark, sf), F.col("org"))
    # the shuffle and the sort are below what makes the lists
    plan = _plan(store.conform(lists, EVENT_LISTS))
    assert plan.count("REBALANCE_PARTITIONS_BY_COL") == 1
    assert "transform(" in plan[: plan.index("REBALANCE_PARTITIONS_BY_COL")] and "transform(" not in plan[plan.index("REBALANCE_PARTITIONS_BY_COL") :]


def test_the_rest_is_rolled_up_without_a_join(spark, sf, unicast, monkeypatch):
    seen = []
    real = rollup.refresh
    monkeypatch.setattr(catalog.rollup, "refresh", lambda prs, path, touched=None: seen.append(touched) or real(prs, path, touched))
    catalog.queries()["incremental_roll_up"](spark, sf)
    assert seen[0] is None and "Join" not in _plan(seen[1])


def test_orders_are_shuffled_before_they_are_described(spark, sf, unicast):
    for df in (fixture.derive_prs(spark, sf), fixture.nested_prs(spark, sf)):
        plan = _plan(df)
        below = plan[plan.index("SortMergeJoin") :]
        assert "area-" in plan and "area-" not in below
