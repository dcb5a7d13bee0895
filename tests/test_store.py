import json
from datetime import datetime
from types import SimpleNamespace

import pytest

from mergelens import cli
from mergelens.schema import FLAT_PR, LATER_FIELDS, RAW_PR
from mergelens.sources import hosting, store, tool as host_tool
from mergelens.streaming import ingest


def rows(spark, *specs):
    base = {"org": "o", "repo": "r", "author": "a", "state": "open", "pr_size": 1, "reviewers": "", "self_merged": False}
    out = []
    for spec in specs:
        d = base | spec
        d.setdefault("year", d["created_at"].year), d.setdefault("month", d["created_at"].month)
        out.append(tuple(d.get(f.name) for f in FLAT_PR))
    return spark.createDataFrame(out, FLAT_PR)


JAN, FEB = datetime(2024, 1, 5), datetime(2024, 2, 5)


def numbers(df):
    return sorted(r["pr_number"] for r in df.collect())


def test_replaces_partitions_only(spark, tmp_path):
    path = f"{tmp_path}/s"
    assert store.write_prs(rows(spark, {"pr_number": 1, "created_at": JAN}, {"pr_number": 2, "created_at": FEB}), path)
    store.write_prs(rows(spark, {"pr_number": 3, "created_at": FEB}), path)
    assert numbers(store.read_store(spark, path)) == [1, 3]
    store.upsert_prs(rows(spark, {"pr_number": 4, "created_at": FEB}, {"pr_number": 3, "created_at": FEB, "state": "merged"}), path)
    back = store.read_store(spark, path)
    assert numbers(back) == [1, 3, 4]
    assert back.where("pr_number = 3").first()["state"] == "merged"
    assert not store.write_prs(rows(spark), path)


def test_names_and_pruning(spark, tmp_path):
    path = f"{tmp_path}/s"
    store.write_prs(rows(spark, {"pr_number": 1, "created_at": JAN, "repo": "007", "org": "My Org"}, {"pr_number": 2, "created_at": FEB}), path)
    found = store.load_store(spark, path, org="My Org", repo="007")
    assert found.first()["repo"] == "007"
    plan = store.read_store(spark, path).where("repo = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(repo" in plan
    assert store.load_store(spark, path, org="none") is None
    assert numbers(store.load_store(spark, path, days_back=10, as_of=datetime(2024, 2, 10))) == [2]


def test_missing_and_empty(spark, tmp_path):
    assert store.read_store(spark, f"{tmp_path}/none") is None
    (tmp_path / "empty").mkdir()
    assert store.load_store(spark, f"{tmp_path}/empty") is None


def test_older_files(spark, tmp_path):
    new, old = f"{tmp_path}/new", f"{tmp_path}/old"
    df = rows(spark, {"pr_number": 1, "created_at": JAN})
    df.write.parquet(new)
    df.drop(*LATER_FIELDS).withColumn("labels", df["pr_size"].cast("int")).write.parquet(old)
    both = store.read_foreign(spark, [new, old])
    assert both.count() == 2 and both.where("self_merged is null").count() == 1


def test_foreign_files_are_scanned_by_schema(spark, tmp_path):
    df = rows(spark, {"pr_number": 1, "created_at": JAN}, {"pr_number": 2, "created_at": FEB})
    for i in range(6):
        one = df if i % 3 else df.withColumn("labels", df["pr_size"].cast("int"))
        (one if i % 2 else one.drop("commits")).coalesce(1).write.parquet(f"{tmp_path}/f{i}")
    files = [str(f) for f in tmp_path.rglob("*.parquet")]
    schemas = {r["schema"] for r in store.file_schemas(spark, files).collect()}
    assert len(schemas) == 4
    for given in (files, [f"{tmp_path}/f{i}" for i in range(6)]):
        both = store.read_foreign(spark, given)
        assert both.count() == 12 and both._jdf.queryExecution().executedPlan().toString().count("FileScan") == 4
        assert both.schema.names == FLAT_PR.names
    assert store.read_foreign(spark, []).count() == 0


def test_snapshots(spark, tmp_path):
    df = rows(spark, {"pr_number": 1, "created_at": JAN}, {"pr_number": 2, "created_at": FEB, "repo": "x"})
    df.write.parquet(f"{tmp_path}/pr_data_my-org_20240101.parquet")
    (tmp_path / "pr_data_my-org_20240202.parquet").write_text("damaged")
    got = store.load_prs(spark, f"{tmp_path}/none", str(tmp_path), org="My_Org", repo="r")
    assert numbers(got) == [1]
    assert store.load_prs(spark, f"{tmp_path}/none", str(tmp_path), org="other") is None


def test_csv(spark, tmp_path):
    store.write_csv(rows(spark, {"pr_number": 1, "created_at": JAN}), f"{tmp_path}/c")
    assert store.read_csv(spark, f"{tmp_path}/c").first()["created_at"] == JAN


def test_sanitized_names():
    assert store.sanitize_org_name("My Org_x") == "my-org-x"


def done(out="", code=0, err=""):
    return SimpleNamespace(returncode=code, stdout=out, stderr=err)


def test_retries():
    waits = []
    answers = iter([done(code=1, err="HTTP 502"), done(code=1, err="timeout"), done("[1]")])
    assert host_tool.call(["x"], run=lambda _: next(answers), sleep=waits.append) == [1]
    assert waits == [2.0, 4.0]
    assert host_tool.call(["x"], run=lambda _: done(code=1, err="denied"), sleep=waits.append) == []
    assert host_tool.call(["x"], run=lambda _: done("{"), sleep=waits.append) == []
    assert host_tool.call(["x"], run=lambda _: done(""), sleep=waits.append) == []


def test_resolve_org(monkeypatch):
    monkeypatch.delenv("MERGELENS_ORG", raising=False)
    with pytest.raises(ValueError, match="organization"):
        hosting.resolve_org(None)
    monkeypatch.setenv("MERGELENS_ORG", "e")
    assert hosting.resolve_org(None) == "e" and hosting.resolve_org("x") == "x"


def tool(args):
    if args[1] == "search":
        return done(json.dumps([{"repository": {"name": n}} for n in ("b", "a", "", "b")]))
    if args[1] == "repo":
        return done(json.dumps([{"name": "all"}]))
    repo = args[args.index("--repo") + 1]
    n = 4 if repo.endswith("/a") else 1
    prs = [{"number": i, "author": {"login": "z"}, "createdAt": f"2024-02-0{i + 1}T00:00:00Z", "additions": 3} for i in range(n)]
    return done(json.dumps([*prs, {"number": 99, "createdAt": "2023-01-01T00:00:00Z"}, {"number": 98}]))


def test_collect_and_report(spark, tmp_path):
    args = cli.parser().parse_args(["--org", "My Org", "--output", str(tmp_path), "--as-of", "2024-02-10"])
    text = cli.gather(spark, args, tool)
    assert "Left out of the export: 1 repositories" in text and "Collected 4 pull requests" in text
    assert store.read_store(spark, f"{tmp_path}/data").count() == 5
    args.report = True
    assert "| z | 5 |" in cli.report(spark, args)
    args.terminal = True
    assert "== People ==" in cli.report(spark, args)
    args.repo = "a"
    assert "== Balance ==" in cli.report(spark, args)
    args.repo = "none"
    assert "Nothing has been collected" in cli.report(spark, args)
    assert hosting.recent_repos(spark, "o", run=tool) == ["a", "b"]
    assert hosting.recent_repos(spark, "o", run=lambda a: tool(a) if a[1] == "repo" else done("")) == ["all"]
    args.min_prs = 50
    assert "None of the repositories has 50" in cli.gather(spark, args, tool)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = {"repo": "r", "number": 1, "createdAt": "2024-02-01T00:00:00Z"}
    for i, state in enumerate([{}, {"mergedAt": "2024-02-02T00:00:00Z"}]):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps(line | state) + "\n")
        raw = ingest.read_landed(spark, f"{tmp_path}/in")
        assert set(RAW_PR.names) < set(raw.columns)
        q = ingest.ingest(raw, "o", f"{tmp_path}/store", f"{tmp_path}/progress")
        q.awaitTermination(120)
        assert q.exception() is None
    got = store.read_store(spark, f"{tmp_path}/store").collect()
    assert [(r["pr_number"], r["state"]) for r in got] == [(1, "merged")]
