import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from mergelens.llm import snapdiff

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(docs):
    """The contract's pairs, row by row; keys are unique."""
    later = {}
    for key, text, lang, source in docs:
        k = zlib.crc32(str(key).encode()) % 16
        text = (text or "") + "+" if k == 1 else text
        lang, source = (source, lang) if k == 2 else (lang, source)
        source = None if k == 4 else source
        if k in (3, 4, 5):
            later[-1 - key] = (text, lang, source)
        if k not in (0, 3, 4):
            later[key] = (text, lang, source)
    earlier = {d[0]: d[1:] for d in docs}
    out = []

    def sha(row):
        return hashlib.sha256("\n".join("~" if v is None else v for v in row).encode()).hexdigest()

    def differ(a, b):
        return ",".join(n for n, x, y in zip(("text", "lang", "source"), a, b, strict=True) if x != y)

    for k in earlier.keys() & later.keys():
        d = differ(earlier[k], later[k])
        out.append((k, k, "update" if d else "same", d, sha(later[k])))
    sides = [defaultdict(list), defaultdict(list)]
    for side, rows, other in ((0, earlier, later), (1, later, earlier)):
        for k in sorted(rows.keys() - other.keys()):
            sides[side][rows[k][0]].append(k)
    for text in sides[0].keys() | sides[1].keys():
        a, b = sides[0][text], sides[1][text]
        for i in range(max(len(a), len(b))):
            if i < len(a) and i < len(b):
                out.append((b[i], a[i], "rekey", differ(earlier[a[i]], later[b[i]]), sha(later[b[i]])))
            elif i < len(b):
                out.append((b[i], None, "insert", "", sha(later[b[i]])))
            else:
                out.append((a[i], a[i], "delete", "", None))
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in snapdiff.snapshot_report(df).collect()), key=repr)


def test_matches_brute_force_with_hot_contents(spark):
    rnd = random.Random(5)
    texts = ["copy", "copy", None, "", "é\nx", "rare"]
    docs = [(i, rnd.choice(texts) if rnd.random() < 0.7 else f"t{i}", rnd.choice(["en", None]), rnd.choice(["a", "b", None])) for i in range(3000)]
    docs.append((3001, "x" * 200_000, "en", "a"))
    df = spark.createDataFrame(docs, SCHEMA).repartition(7)
    for name in ("key", "d0", "op", "a_key", "nth", "__range"):
        df = df.withColumn(name, F.lit("clash"))
    assert found(df) == brute(docs)


def test_real_documents(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    docs = [tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()]
    assert found(df) == brute(docs)


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert found(none) == []
    one = spark.createDataFrame([(1, "a", "b", None)], SCHEMA)
    assert [(r["key"], r["op"], r["changed"]) for r in snapdiff.diff_snapshots(none, one).collect()] == [(1, "insert", [])]
    assert [(r["key"], r["old_key"], r["op"]) for r in snapdiff.diff_snapshots(one, none).collect()] == [(1, 1, "delete")]


def test_repeated_and_null_keys(spark):
    old = spark.createDataFrame([(1, "a", "x", None), (1, "b", "x", None), (None, "n", None, None), (2, "m", None, None)], SCHEMA)
    new = spark.createDataFrame([(1, "b", "x", None), (1, "a", "x", None), (1, "a", "x", None), (None, "n", "y", None), (9, "m", None, None)], SCHEMA)
    got = sorted(((r["key"], r["old_key"], r["op"], tuple(r["changed"])) for r in snapdiff.diff_snapshots(old, new).collect()), key=repr)
    # three rows of key 1 pair twice by place; a third is new
    assert [g[2] for g in got].count("insert") == 1
    assert (None, None, "update", ("lang",)) in got and (9, 2, "rekey", ()) in got
    assert len(got) == 5
    same = snapdiff.diff_snapshots(new, new).collect()
    assert len(same) == 5 and {r["op"] for r in same} == {"same"}


def test_directions_and_columns(spark):
    old = spark.createDataFrame([(1, "t", "p"), (2, "t", "q")], "k string, body string, note string")
    new = spark.createDataFrame([(8, "t", "p"), (9, "t", "q")], "k string, body string, note string")
    kw = {"key": "k", "columns": ("body", "note"), "content": ("body",)}
    up = {(r["old_key"], r["key"], tuple(r["changed"])) for r in snapdiff.diff_snapshots(old, new, **kw).collect()}
    assert up == {("1", "8", ()), ("2", "9", ())}
    down = {(r["old_key"], r["key"], tuple(r["changed"])) for r in snapdiff.diff_snapshots(old, new, new_descending=True, **kw).collect()}
    assert down == {("1", "9", ("note",)), ("2", "8", ("note",))}


def test_numbers_go_on_over_ranges(spark):
    df = spark.range(0, 20_000, 1, 5).select((F.col("id") * 7919 % 20_000).alias("k"), F.when(F.col("id") % 3 > 0, "hot").alias("g"))
    got = snapdiff.number_within(df, ["g"], [F.asc("k")], "place").collect()
    for g in (None, "hot"):
        rows = sorted((r["k"], r["place"]) for r in got if r["g"] == g)
        assert [p for _, p in rows] == list(range(1, len(rows) + 1))
