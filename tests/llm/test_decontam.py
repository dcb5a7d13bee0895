import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from mergelens.llm import decontam
from mergelens.llm.oracle import OVERLAPS

RND = random.Random(5)
WORDS = [f"w{i}x" for i in range(500)]
ITEM = RND.choices(WORDS, k=30)


def text(n):
    return RND.choices(WORDS, k=n)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(ITEM)), (2, " ".join(ITEM).upper() + "!"), (3, None), (4, "too short"), (None, "x y z")], "item_id long, text string")


def swapped(words, every):
    return [w if i % every else "other" for i, w in enumerate(words)]


def test_overlaps(spark, docs_of, bench):
    rows = [
        (10, " ".join(text(40) + ITEM + text(40))),
        (11, " ".join(text(5) + swapped(ITEM, 6) + text(5))),
        (12, ", ".join(w.upper() for w in ITEM[5:20])),
        (13, " ".join(text(300))),
        (14, " ".join(ITEM[:9])),
        (15, None),
        (16, ""),
        (None, " ".join(ITEM)),
        (17, " ".join(text(20000) + ITEM)),
        (17, " ".join(ITEM)),
    ]
    got = {r["doc_id"]: r for r in decontam.overlaps(docs_of(rows), bench).collect()}
    assert set(got) == {10, 11, 12, 17}
    assert {r["item_id"] for r in got.values()} == {1}
    assert (got[10]["matches"], got[10]["doc_start"], got[10]["item_start"]) == (30, 40, 0)
    assert got[12]["item_start"] == 5 and got[12]["matches"] == 15
    kept = decontam.drop_contaminated(docs_of(rows), bench)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 13, 14, 15, 16]


def test_best_stretch_matches_brute_force(spark):
    rnd = random.Random(1)
    rows = [([rnd.randint(0, 3) for _ in range(30)], [rnd.randint(0, 3) for _ in range(20)], rnd.randint(-10, 20)) for _ in range(60)]
    df = spark.createDataFrame(rows, "t array<bigint>, i array<bigint>, d int")
    got = [r[0]["score"] for r in df.select(decontam._best_stretch(F.col("t"), F.col("i"), F.col("d"))).collect()]
    for (t, i, d), best in zip(rows, got, strict=True):
        gain = [2 if 0 <= k + d < len(t) and t[k + d] == x else -3 for k, x in enumerate(i)]
        assert best == max(0, *(sum(gain[a:b]) for a in range(len(gain)) for b in range(a + 1, len(gain) + 1)))


def test_masks_hit_most_substituted_stretches():
    rnd, hit = random.Random(2), 0
    marks = [[i for i, c in enumerate(m) if c == "1"] for m in decontam.MASKS]
    for _ in range(2000):
        bad = set(rnd.sample(range(16), rnd.choice((2, 3, 4))))
        hit += any(not bad & {i + o for o in m} for m in marks for i in range(16 - m[-1]))
    assert hit / 2000 > 0.97


def test_substitutions_in_short_items(spark, docs_of):
    """Items of 10 to 16 tokens with 1 to 4 interior substitutions, and one shorter than a mask."""
    items = {1: (16, (5, 10)), 2: (16, (1, 8, 14)), 3: (14, (6,)), 4: (10, (4,)), 5: (16, (2, 7, 11, 14)), 6: (3, ())}
    words = {i: [f"i{i}w{k}" for k in range(n)] for i, (n, _) in items.items()}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in words.items()], "item_id long, text string")
    rows = [(i, " ".join(text(20) + [("other" if k in items[i][1] else x) for k, x in enumerate(w)] + text(20))) for i, w in words.items()]
    rows += [(50, " ".join(text(20) + words[1][:11] + text(20))), (51, " ".join(text(20) + words[6][:2] + text(20)))]
    got = {(r["doc_id"], r["item_id"]) for r in decontam.overlaps(docs_of(rows), bench).collect()}
    assert got == {(i, i) for i in items}


def test_the_sql_agrees_on_short_items_dense_stretches_and_repetitive_texts(spark, docs_of):
    """The SQL of the query, on what the given benchmark lacks; some overlaps count by one of the two rules alone."""
    rnd = random.Random(8)
    items = {i: rnd.choices(WORDS, k=n) for i, n in enumerate([1, 2, 3, 6, 7, 9, 12, 16, 16, 20, 30, 45])}
    items |= {20: ["a"] * 8, 21: ["a", "b"] * 10, 22: ["a"] * 5 + ["b"]}
    rows = []
    for doc in range(120):
        words = rnd.choices(WORDS, k=rnd.randint(0, 40))
        for item in rnd.sample(sorted(items), 2):
            words += [rnd.choice(WORDS) if rnd.random() < rnd.choice((0, 0.1, 0.2, 0.25)) else w for w in items[item]] + rnd.choices(WORDS, k=5)
        rows.append((doc, " ".join(words)))
    rows += [(200, "a " * 300), (201, "a b " * 200), (202, "b " * 50 + "a " * 50), (203, None), (204, ""), (205, "a")]
    bench = [(i, " ".join(w)) for i, w in items.items()] + [(30, " ".join(items[9])), (31, None), (32, "")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(bench, columns=["item_id", "text"]))
    found = con.execute(OVERLAPS)
    names = [d[0] for d in found.description]
    want = sorted(found.fetchall())
    got = decontam.overlaps(docs_of(rows), spark.createDataFrame(bench, "item_id long, text string")).select(names)
    assert sorted(map(tuple, got.collect())) == want
    score = names.index("score")
    assert any(r[score] < decontam.LEAST_MATCHES * decontam.MATCH and r[1] in (7, 8, 9, 10, 11) for r in want)
    assert {0, 1, 2, 3} <= {r[1] for r in want}


def test_no_python_in_the_plan(docs_of, bench):
    plan = decontam.overlaps(docs_of([(1, "a")]), bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark, docs_of, bench):
    assert decontam.overlaps(docs_of([]), bench).count() == 0
    assert decontam.overlaps(docs_of([(1, " ".join(ITEM))]), bench.where("false")).count() == 0
