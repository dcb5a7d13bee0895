"""The pull-request data source, and collection under an organization's own name."""

import json
import os
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from mergelens import cli
from mergelens.plans.fixture import landed
from mergelens.sources import hosting, store
from mergelens.sources.pull_requests import PullRequestReader, PullRequestSource, register
from mergelens.sources.tool import LandedTool


def answer(rows, code=0, err=""):
    return SimpleNamespace(returncode=code, stdout=json.dumps(rows), stderr=err)


class Flaky:
    """Fails twice for each repository, then answers; keeps a mark of each call in a folder, as it runs in tasks."""

    def __init__(self, folder):
        self.folder = str(folder)

    def __call__(self, args):
        repo = args[args.index("--repo") + 1].replace("/", "~")
        open(os.path.join(self.folder, f"{repo}#{os.getpid()}#{uuid.uuid4().hex}"), "w").close()
        calls = [f for f in os.listdir(self.folder) if f.startswith(f"{repo}#")]
        if len(calls) < 3:
            return answer([], 1, "HTTP 502")
        return answer([{"number": n, "createdAt": f"2024-0{n}-01T00:00:00Z", "author": {"login": "é"}} for n in (1, 2, 3)])


def test_partition_for_each_repository_and_retries(spark, tmp_path):
    register(spark, Flaky(tmp_path))
    df = spark.read.format("pull_requests").option("org", "o").option("repos", '["a", "b", "c d"]').option("delay", 0.01).load()
    assert df.rdd.getNumPartitions() == 3
    rows = df.collect()
    assert sorted({(r["org"], r["repo"]) for r in rows}) == [("o", "a"), ("o", "b"), ("o", "c d")] and len(rows) == 9
    assert json.loads(rows[0]["value"])["author"]["login"] == "é"
    assert len(os.listdir(tmp_path)) == 9  # three calls a repository, all in tasks
    assert all(f"#{os.getpid()}#" not in f for f in os.listdir(tmp_path))


def test_days_are_pushed_into_the_reader(spark, tmp_path):
    register(spark, Flaky(tmp_path))
    df = spark.read.format("pull_requests").option("org", "o").option("repos", '["a"]').option("delay", 0.01).load()
    late = df.where((F.col("created_day") >= "2024-02-01") & (F.length("value") > 0))
    assert late.count() == 2
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert ">=" not in [x for x in plan.splitlines() if "Filter " in x][0]


def test_reader_takes_conditions_on_the_day_alone():
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan

    reader = PullRequestReader({"org": "o"}, None)
    left = [LessThan(("created_day",), "x"), EqualTo(("repo",), "r")]
    assert list(reader.pushFilters([GreaterThanOrEqual(("created_day",), "b"), *left, GreaterThan(("created_day",), "a")])) == left
    assert [reader._wanted(d) for d in ("a", "b", "c")] == [False, True, True]
    with pytest.raises(ValueError, match="org"):
        PullRequestSource({}).reader(None)


def test_unreadable_repositories_give_no_rows(spark):
    raw = hosting.collect_raw(spark, "o", ["x"], run=lambda _: answer([], 1, "denied"))
    assert raw.count() == 0 and {"org", "repo", "number"} <= set(raw.columns)
    assert hosting.collect_raw(spark, "o", [], run=lambda _: answer([])).count() == 0


def test_landed_tool_reads_the_fixture(spark, sf):
    run = LandedTool(landed(spark, sf))
    repos = hosting.org_repos("ASIA", run)
    assert len(repos) == 5 and hosting.recent_repos(spark, "ASIA", run=run) == repos
    raw = hosting.collect_raw(spark, "ASIA", repos, None, run=run, limit=10**9)
    want = spark.read.schema("value string, org string, repo string").text(landed(spark, sf)).where("org = 'ASIA'").count()
    assert raw.count() == want > 0


def test_own_name_is_asked_and_the_sanitized_one_stored(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def tool(args):
        org = args[args.index("--owner") + 1] if "--owner" in args else args[args.index("--repo") + 1].split("/")[0]
        (asked / org).touch()
        if args[1] == "search":
            return answer([{"repository": {"name": "r"}}])
        review = {"author": {"login": "b"}, "submittedAt": "2024-02-03T00:00:00Z", "state": "APPROVED"}
        return answer([{"number": i, "author": {"login": "z"}, "createdAt": "2024-02-02T00:00:00Z", "reviews": [review]} for i in range(3)])

    args = cli.parser().parse_args(["--org", "My_Org", "--output", str(tmp_path / "out"), "--as-of", "2024-02-10"])
    cli.gather(spark, args, tool)
    assert os.listdir(asked) == ["My_Org"]
    assert {r["org"] for r in store.read_store(spark, f"{tmp_path}/out/data").collect()} == {"my-org"}
    events = store.read_events(spark, f"{tmp_path}/out/events").collect()
    assert {(r["org"], r["kind"], r["actor"], r["decision"]) for r in events} == {("my-org", "review", "b", "APPROVED")} and len(events) == 3
    args.report = True
    assert "| z | 3 |" in cli.report(spark, args)
