import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st

from mergelens.llm import common


def test_words_and_shingles():
    texts = ["The Cat\tsat\x0bon  THE mat É", "", "a b", "the cat SAT"]
    h, first, starts, ends, buf = common.word_hashes([t.encode() for t in texts])
    got = [buf[s:e].decode() for s, e in zip(starts, ends, strict=True)]
    assert got == ["the", "cat", "sat", "on", "the", "mat", "É", "a", "b", "the", "cat", "sat"]
    assert first.tolist() == [0, 7, 7, 9, 12]
    assert len(set(h.tolist())) == len(set(got))
    sets = common.shingle_sets([t.encode() for t in texts])
    assert [len(s) for s in sets] == [3, 0, 1, 1]
    again = common.shingle_sets([b"a B"])[0]
    assert again.tolist() == sets[2].tolist()


def test_long_texts_are_cut_at_white_space():
    text = (b"word " * 200_000) + b"x" * 600_000 + b" end"
    h, first, *_ = common.word_hashes([text])
    assert first.tolist() == [0, 200_002] and len(set(h.tolist())) == 3


@given(st.lists(st.text("abA \t\né", max_size=60), max_size=5))
def test_token_hashes_tell_the_same_words_apart(texts):
    raw = [t.encode() for t in texts] + [b"abcdefgh abcdefghi abcdefgh\0 abcdefghabcdefgh abcdefgha bcdefgh"]
    h, *places = common.word_hashes(raw)
    again, *same = common.token_hashes(raw)
    assert all(np.array_equal(a, b) for a, b in zip(places[:3], same[:3], strict=True)) and places[3] == same[3]
    assert len(set(h.tolist())) == len(set(again.tolist())) == len(set(zip(h.tolist(), again.tolist(), strict=True)))


def test_memory_is_given_back_at_the_end_of_a_task(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    run = common.giving_back(lambda batches: (b + 1 for b in batches))
    assert list(run([1, 2])) == [2, 3] and len(calls) == 1
    some = run([1, 2])
    next(some)
    some.close()
    assert len(calls) == 2 and common.giving_back_group(lambda x: -x)(3) == -3 and len(calls) == 3


def test_sketches(spark):
    df = spark.range(1000).selectExpr("id % 10 as id").repartition(5)
    counts = common.count_sketch(df, lambda batch: [common.mix64(batch.column("id").to_numpy().view(np.uint64))], 17)
    assert counts.sum() == 1000
    h = common.mix64(np.arange(10, dtype=np.uint64))
    assert (counts[(h & np.uint64(2**17 - 1)).astype(int)] >= 100).all()


def test_flags(spark):
    rng = np.random.default_rng(2)
    held, other = rng.integers(-(2**63), 2**63 - 1, 500), rng.integers(-(2**63), 2**63 - 1, 5000)
    rows = spark.createDataFrame([(int(x), None, -i) for i, x in enumerate(held)], "a long, b long, c long").repartition(5)
    for bits in (17, 23):
        flags = common.flag_sketch(rows, ["a", "b", "c"], bits)
        assert len(flags) == 2**bits // 8
        assert common.flagged(flags, held).all() and common.flagged(flags, -np.arange(500)).all()
        assert common.flagged(flags, other).mean() < 0.02
    assert not common.flag_sketch(rows.where("false"), ["a"], 17).any()


@pytest.mark.parametrize("local", [common.LOCAL_EDGES, 0, 7])
def test_components(spark, local, monkeypatch):
    monkeypatch.setattr(common, "LOCAL_EDGES", local)
    edges = [(1, 2), (2, 3), (10, 11), (12, 11), (20, 20), (3, 2), (30, 31), *[(100, i) for i in range(101, 140)]]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[12] == 10 and got[31] == 30 and got[139] == 100 and 20 not in got
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
