"""The weekly stream against the batch figures, in any order, over restarts and repeated deliveries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mergelens.operators import metrics
from mergelens.operators.normalize import normalize
from mergelens.streaming import ingest, weekly

WIDE = "36500 days"


def pull_requests(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        day = f"2024-{rnd.randint(1, 3):02d}-{rnd.randint(1, 28):02d}T{rnd.randint(0, 23):02d}:00:00Z"
        pr = {"repo": f"r{i % 3}", "number": i, "author": {"login": f"a{rnd.randint(0, 6)}"}, "createdAt": day, "additions": rnd.randint(0, 300)}
        if rnd.random() < 0.6:
            pr["mergedAt"] = day.replace("T0", "T1") if "T0" in day else day
        out.append(pr)
    return out


def land(folder, name, prs):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("".join(json.dumps(p) + "\n" for p in prs))


def run(spark, tmp_path, lateness=WIDE, files=1):
    raw = ingest.read_landed(spark, f"{tmp_path}/in", files_per_batch=files)
    q = weekly.start(normalize(raw, "o"), f"{tmp_path}/sums", f"{tmp_path}/progress", lateness)
    q.awaitTermination(300)
    assert q.exception() is None
    return q


def rolled(spark, tmp_path):
    return [tuple(r) for r in weekly.roll_up(weekly.newest_sums(spark, f"{tmp_path}/sums")).collect()]


def batch_figures(spark, prs):
    rows = spark.createDataFrame([(p["repo"], json.dumps(p)) for p in prs], "repo string, value string")
    raw = rows.select("repo", F.from_json("value", ingest.RAW_PR).alias("p")).select("repo", "p.*")
    return [tuple(r) for r in metrics.weekly_stats(normalize(raw, "o"), weeks=None).where("week is not null").collect()]


def test_any_order_repeats_and_restart(spark, tmp_path):
    prs = pull_requests(120)
    shuffled = random.Random(4).sample(prs, len(prs))
    for i in range(3):
        land(tmp_path / "in", f"{i}", shuffled[i * 20 : (i + 1) * 20] + shuffled[:7])
    run(spark, tmp_path)
    assert rolled(spark, tmp_path) == batch_figures(spark, shuffled[:60])
    # a restart on the same progress: the rest, repeats of the first half, and rows without a time
    for i in range(3, 6):
        land(tmp_path / "in", f"{i}", shuffled[i * 20 : (i + 1) * 20] + shuffled[10:25] + [{"repo": "r0", "number": 999}])
    run(spark, tmp_path)
    want = batch_figures(spark, prs)
    assert rolled(spark, tmp_path) == want
    run(spark, tmp_path)  # nothing new
    assert rolled(spark, tmp_path) == want
    assert weekly.compact(spark, f"{tmp_path}/sums") and rolled(spark, tmp_path) == want
    land(tmp_path / "in", "last", [{"repo": "x", "number": 1, "createdAt": "2024-01-02T00:00:00Z", "author": {"login": "new"}}])
    run(spark, tmp_path)
    after = rolled(spark, tmp_path)
    assert sum(r[1] for r in after) == 121 and sum(r[3] for r in after) == sum(r[3] for r in want) + 1


def test_a_merge_delivered_later_counts_once(spark, tmp_path):
    opened = [{**p, "mergedAt": None} for p in pull_requests(30, 1)]
    merged = pull_requests(30, 1)
    land(tmp_path / "in", "0", opened)
    run(spark, tmp_path)
    land(tmp_path / "in", "1", merged)
    land(tmp_path / "in", "2", merged)
    run(spark, tmp_path)
    assert rolled(spark, tmp_path) == batch_figures(spark, merged)


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    prs = pull_requests(40, 2)
    land(tmp_path / "in", "0", prs)
    run(spark, tmp_path)
    want = rolled(spark, tmp_path)
    # as after a failure between writing and the commit of a batch
    for f in (tmp_path / "progress" / "commits").iterdir():
        f.unlink()
    run(spark, tmp_path)
    assert rolled(spark, tmp_path) == want


def test_state_is_bounded_and_late_rows_are_counted(spark, tmp_path):
    at = lambda n, day: {"repo": "r", "number": n, "author": {"login": "a"}, "createdAt": f"{day}T00:00:00Z"}
    land(tmp_path / "in", "0", [at(1, "2024-01-01")])
    run(spark, tmp_path, "7 days")
    land(tmp_path / "in", "1", [at(2, "2024-03-01")])
    q = run(spark, tmp_path, "7 days")
    rows = [s["numRowsTotal"] for s in q.lastProgress["stateOperators"]]
    assert rows == [1, 1]  # January's facts and sums have left the state
    land(tmp_path / "in", "2", [at(3, "2024-01-01"), at(4, "2024-02-28")])
    q = run(spark, tmp_path, "7 days")
    assert weekly.late_rows(q) >= 1
    assert sum(r[1] for r in rolled(spark, tmp_path)) == 3  # the January row stays counted, number 3 came too late


def test_nothing_yet(spark, tmp_path):
    assert weekly.newest_sums(spark, f"{tmp_path}/none") is None and not weekly.compact(spark, f"{tmp_path}/none")


@pytest.mark.parametrize("day", ["2023-12-31T23:59:59Z", "2024-01-01T00:00:00Z", "2024-02-29T12:00:00Z"])
def test_weeks_start_on_mondays(spark, day):
    rows = spark.createDataFrame([("r", json.dumps({"number": 1, "createdAt": day}))], "repo string, value string")
    flat = normalize(rows.select("repo", F.from_json("value", ingest.RAW_PR).alias("p")).select("repo", "p.*"), "o")
    (a,), (b,) = weekly.weekly_sums(flat).collect(), flat.select(F.date_trunc("week", "created_at").alias("week")).collect()
    assert a["week"] == b["week"]
