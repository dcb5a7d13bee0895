import random

import numpy as np
from pyspark.sql import functions as F

from mergelens.llm import langid

SOUNDS = {"en": ["th", "ing", "er", "on", "wh"], "de": ["sch", "ung", "ei", "ö", "tz"], "fr": ["eau", "é", "ion", "ou", "ç"]}


def sample(spark, n=400, seed=1):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rnd.choice(sorted(SOUNDS))
        rows.append((i, " ".join("".join(rnd.choices(SOUNDS[lang], k=rnd.randint(1, 4))) for _ in range(rnd.choice([4, 40, 200]))), lang, f"s{i}"))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)


def test_held_out_accuracy(spark):
    df = sample(spark)
    got = langid.identify_languages(df).join(df, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 40 and (held.lang == held.lang_pred).mean() > 0.95
    assert got.score.between(0, 1).all()
    # a higher calibrated score is right more often
    assert held[held.score > 0.9].pipe(lambda d: (d.lang == d.lang_pred).mean()) >= 0.95


def test_edges(spark):
    df = sample(spark, 120).drop("source").unionByName(
        spark.createDataFrame([(900, None, "en"), (901, "", None), (902, "123 !!", "en"), (None, "thing wh", None), (904, "thing " * 50_000, None)], "doc_id long, text string, lang string")
    )
    got = {r["doc_id"]: r for r in langid.identify_languages(df.withColumn("score", F.lit("x"))).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert got[904]["lang_pred"] == "en" and got[None]["held_out"] is False
    assert langid.identify_languages(df.where("false")).count() == 0
    assert {r["lang_pred"] for r in langid.identify_languages(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_lang_is_no_input(spark):
    """Labels of held-out rows do not matter."""
    df = sample(spark, 150)
    other = df.withColumn("lang", F.when(langid.id_remainder(F.col("doc_id"), 5) == 0, "zz").otherwise(F.col("lang")))
    rows = lambda d: sorted(map(tuple, langid.identify_languages(d).collect()))
    assert rows(df) == rows(other)


def test_numbers_and_marks_are_no_letters(docs_of):
    rows = [(i, t) for i, t in enumerate(["½ ② ³", "Ⅷ ①", "12 _ -", None, "", "ª", "日本"])]
    model = langid.train(["ja da ein haus", "oui la maison"] * 20, ["de", "fr"] * 20)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs_of(rows), model).collect()}
    assert [got[i] for i in range(5)] == [("und", 0.0)] * 5
    assert got[5][0] in ("de", "fr") and got[6][0] in ("de", "fr")


def test_a_rare_language_is_learnt(spark):
    rows = [(i, "der hund und das haus", "de") for i in range(3000)] + [(5000 + i, "qua quo quibus", "la") for i in range(8)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_labelled=50)
    assert model.langs == ["de", "la"]


def test_predictions_equal_a_plain_mean_over_whole_texts(spark):
    """Against every subword of a text looked up one by one; texts of several batches of words too."""
    df = sample(spark, 80)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()] + [(1000, "schung  eion " * 15_000)]
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), model).collect()}
    for i, text in rows:
        total, n = np.zeros(len(model.langs)), 0
        for word in langid.letter_runs(text):
            for row in langid.subwords([word])[0]:
                total += model.scores[row]
                n += 1
        z = (total / n + model.bias) * n**model.power / model.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        assert got[i]["lang_pred"] == model.langs[int(p.argmax())]
        assert abs(got[i]["score"] - p.max()) < 1e-6


def test_counts_cover_whole_texts_and_documents_stay_on_one_side():
    rows, counts = langid.counted("ab " * 50_000 + "zq")
    assert counts.sum() == 50_000 * len(langid.subwords(["ab"])[0]) + len(langid.subwords(["zq"])[0])
    assert set(langid.subwords(["zq"])[0]) <= set(rows.tolist())
    ys = np.array([0] * 40 + [1] * 3 + [2])
    held = langid._held_out(ys, np.random.default_rng(0))
    assert held[:40].sum() == 10 and not held[40:].any()


def test_many_languages_and_repeated_rows_are_bounded(spark):
    rows = [(i, f"w{chr(97 + i % 26)} text", f"l{i % 40}") for i in range(200)] + [(None, "der hund", "de")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id is not null"), max_languages=7)
    assert len(model.langs) == 7
    got = langid.identify_languages(df).groupBy("held_out").count().collect()
    assert sum(r["count"] for r in got) == 700
