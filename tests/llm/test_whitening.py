import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from mergelens.llm import registry, whitening


def brute(vectors):
    """Rows of numpy's eigen-decomposition, exact sums through Python integers."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x]
    centred = np.array(x, float) - np.array([s / n for s in sums])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return n, deviation, centred @ v / np.sqrt(e), e / e.sum()


def check(df, vectors, d):
    n, deviation, white, explained = brute(vectors)
    got = {}
    for r in df.collect():
        got[r["vec_id"], r["component"]] = r
        assert r["n"] == n and r["identity_error"] <= 1e-9
    k = min(8, d)
    assert len(got) == len(vectors) * k
    for c in range(1, k + 1):
        w = np.array([got[i, c]["whitened"] for i, _ in vectors])
        assert min(np.abs(w - white[:, c - 1]).max(), np.abs(w + white[:, c - 1]).max()) < 1e-6
        assert got[vectors[0][0], c]["explained"] == pytest.approx(explained[c - 1], rel=1e-9)
    assert [int(got[i, 1]["deviation"]) for i, _ in vectors] == deviation


def test_matches_numpy(spark):
    rnd = np.random.default_rng(1)
    rows = [(i, (rnd.normal(size=12) * np.arange(1, 13) / 8).astype(np.float32).tolist()) for i in range(400)]
    bad = [(900, None), (901, [None] * 12), (902, [float("nan")] * 12), (903, [float("inf")] * 12), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").repartition(5)
    for name in ("x", "w", "at", "deviation", "n"):
        df = df.withColumn(name, F.lit("clash"))
    check(whitening.whiten_embeddings(df), rows, 12)


def test_query_on_whole_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = registry.queries()["op13_embedding_whitening"](spark, sf)
    assert dict(got.dtypes)["deviation"] == "bigint" and dict(got.dtypes)["component"] == "int"
    check(got, rows, 64)


def test_few_dimensions_and_no_variance(spark):
    make = lambda rows: whitening.whiten_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    assert make([]).collect() == [] and make([(1, [0.5, 0.5])]).collect() == []
    assert make([(1, [0.5]), (2, [0.5])]).collect() == []
    got = make([(1, [0.0, 1.0]), (2, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [3.0, 4.0])]).collect()
    assert len(got) == 4 and {r["component"] for r in got} == {1}  # the dimensions move together
    assert got[0]["explained"] == pytest.approx(1.0)


def test_deviations_beyond_a_long(spark):
    rows = spark.createDataFrame([(1, [10**6, -(10**6)])], "vec_id long, x array<long>")
    n, sums = 3 * 10**9, [0, 10**15]
    want = sum((n * x - s) ** 2 for x, s in zip((10**6, -(10**6)), sums, strict=True))
    assert int(whitening.with_deviation(rows, n, sums).first()["deviation"]) == want > 2**63
