import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def docs_of(spark):
    """(doc_id, text) rows over several partitions, with columns that clash with ours."""

    def make(rows, extra=True):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        if extra:
            for name in ("n", "score", "item", "key1", "prefix", "host", "quality", "logit", "removed", "b"):
                df = df.withColumn(name, F.lit("x"))
        return df

    return make


@pytest.fixture(scope="session")
def near_copies():
    """Groups of near copies, exact copies, shared lines, and every odd text."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    bases = [rnd.choices(words, k=60) for _ in range(4)]
    rows = []
    for i in range(160):
        b = list(bases[i % 4])
        for _ in range(rnd.randint(0, 4)):
            b[rnd.randrange(60)] = rnd.choice(words)
        cut = [" ".join(b[j : j + 12]) for j in range(0, 60, 12)]
        rows.append((i, ("\n" if i % 2 else " ").join(cut)))
    rows += [(1000, ""), (1001, None), (1002, "a b c"), (1003, "A  b\tc"), (1004, "x"), (1005, "\n \n"), (1006, rows[0][1])]
    rows += [(2000 + i, " ".join(rnd.choices(words, k=5000))) for i in range(2)]
    return rows
