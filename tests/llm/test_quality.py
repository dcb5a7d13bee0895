import random

import pytest
from pyspark.sql import functions as F

from mergelens.llm import quality

GOOD = "The house of the river is on the hill. And the cat sat there for a while.\nIt was good. "
BAD = "BUY### NOW$$$ &&& !!! WIN%%% CASH*** ||| "


def tables(spark, n=240):
    rnd = random.Random(2)
    rows, labels = [], []
    for i in range(n):
        bad = i % 6 == 0
        rows.append((i, (BAD if bad else GOOD) * rnd.randint(1, 6), "en", "spam" if bad and i % 12 else f"s{i % 5}"))
        if i % 3 == 0:
            labels.append((i, int(not bad), 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifies(spark):
    docs, labels = tables(spark)
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 240
    assert all(r["keep"] == (i % 6 != 0) for i, r in got.items())
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["keep"]}


def test_shrinkage(spark):
    rows = [("a", "a/1", 3.0)] * 200 + [("a", "a/2", -3.0)] + [("b", "b/1", -3.0)] * 200 + [(None, None, 0.0)]
    sites = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, logit double"))
    got = {r["path"]: r for r in sites.collect()}
    good = 1 / (1 + 2.718281828 ** -3)
    assert got["a/1"]["host_share"] == pytest.approx(good, abs=0.02)
    # one document moves its path only part of the way from its host
    assert 1 - good < got["a/2"]["path_share"] < got["a/2"]["host_share"]
    assert got["b/1"]["path_share"] < 0.1 and None in got
    assert all(0 < r["path_share"] < 1 for r in got.values())


def test_edges(spark):
    docs, labels = tables(spark, 60)
    odd = docs.unionByName(spark.createDataFrame([(900, None, None, None), (901, "", "en", "s1"), (None, GOOD, "en", "s1"), (902, GOOD * 3000, "en", "s2")], docs.schema))
    odd = odd.withColumn("host", F.lit(1)).withColumn("path", F.lit("p")).withColumn("logit", F.lit("z")).withColumn("quality", F.lit("q"))
    labels = labels.unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0), (0, 0, 0)], labels.schema))
    assert quality.classify(odd, labels).count() == 64
    kept = quality.keep_good(odd, labels)
    assert kept.columns == odd.columns and {902, None} <= {r["doc_id"] for r in kept.collect()}
    assert quality.classify(odd.where("false"), labels).count() == 0
    assert quality.classify(odd, labels.where("false")).count() == 64
