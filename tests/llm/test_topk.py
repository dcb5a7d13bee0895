import numpy as np
from pyspark.sql import functions as F

from mergelens.llm import topk


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def brute(rows, k=5):
    ok = [(i, np.floor(256 * np.array(v, np.float32).astype(float))) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q in sorted({i for i, _ in ok if i % 50 == 0}):
        own = next(v for i, v in ok if i == q)
        s = sorted((-sum(int(a) * int(b) for a, b in zip(own, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(own))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out


def run(spark, rows, **more):
    v = topk.usable_vectors(frame(spark, [(i, x, 0) for i, x in rows]))
    return sorted(map(tuple, topk.exact_top_k(v, v.where(F.col("vec_id") % 50 == 0), **more).collect()))


def test_random_and_ties(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.1, 16).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(120)]
    rows += [(2000, None), (2001, [float("nan")] * 16), (2050, [float("inf")] * 16), (2002, [None, 1.0]), (None, rows[0][1]), (2100, [0.5, 0.5]), (2003, [0.1, -0.2])]
    assert run(spark, rows, block=64, bins=16) == brute(rows)


def test_few_candidates_and_large_numbers(spark):
    rows = [(0, [1.0, 2.0]), (1, [3.0, -4.0]), (50, [0.0, 0.0])]
    assert run(spark, rows) == brute(rows)
    big = [(0, [3e4, 1.0]), (1, [3e4, 2.0]), (2, [-3e4, 1.0])]
    assert run(spark, big) == brute(big)
    beyond_doubles = [(0, [3e6, 1.0]), (1, [3e6, 2.0]), (2, [3e6, 2.1]), (3, [-3e6, 1.0]), (4, [3e6, 2.0])]
    assert run(spark, beyond_doubles) == brute(beyond_doubles)


def test_many_cells_and_norms(spark, monkeypatch):
    """Several slices on either side, norms that differ so that blocks are left out, and ties over blocks."""
    monkeypatch.setattr(topk, "Q_BLOCKS", 1)
    monkeypatch.setattr(topk, "C_BLOCKS", 2)
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 0.1, 8) * 2.0 ** rng.integers(-3, 4)).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(60)] + [(1500 + i, [0.0] * 8) for i in range(60)]
    for k in (1, 5, 70):
        assert run(spark, rows, k=k, block=32, bins=256) == brute(rows, k)


def test_blocks_of_small_norm_are_not_scored(monkeypatch):
    rng = np.random.default_rng(3)
    scored, real = [], topk._scores
    monkeypatch.setattr(topk, "_scores", lambda q, v, kind: scored.append(len(v)) or real(q, v, kind))
    q = rng.integers(-50, 50, (4, 8))
    blocks = [(np.arange(20) + 20 * i, (rng.integers(-99, 99, (20, 8)) // 10**i).astype(np.float32), 300.0 / 10**i) for i in range(3)]
    low, high = np.full(4, -(2.0**24), np.float32), np.full(4, 2.0**24, np.float32)
    found = list(topk._visits(q, np.arange(4) + 1000, low, high, blocks, np.float32, -np.inf, 3))
    assert scored == [20] * len(scored) and len(scored) < 3 and found


def test_a_repeated_query_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (2, [0.25, 0.5])]
    assert [(r[0], r[2], r[3]) for r in run(spark, rows)] == [(0, 2, 256 * 128), (0, 1, 256 * 64)]


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0])]) == []
