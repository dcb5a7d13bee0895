import dataclasses
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from mergelens.llm import lm


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\0end"]


def small_vocab(spark, texts, neural=40):
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    return lm.vocabulary(lm.word_counts(df), neural=neural, frequent=100)


def test_base_scores(spark, docs_of, near_copies):
    rows = [r for r in near_copies if r[0] < 1100] + [(None, "w1 w2"), (None, "w1 w2")]
    got = lm.score_documents(docs_of(rows)).collect()
    assert len(got) == len(rows)
    train = [t for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    texts = dict(rows)
    for r in got:
        own = tokens(texts[r["doc_id"]])
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel=1e-9)
        assert r["score"] < 0


def test_probabilities_add_up(spark):
    """Over all known words and the unknown one, from any state."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(400)]
    vocab = small_vocab(spark, [" ".join(rng.choice(words, 300, p=np.arange(400, 0, -1) / 80200)) for _ in range(10)])
    p = lm.start_parameters(vocab)
    p["wc"] += rng.normal(0, 1, p["wc"].shape).astype(np.float32)
    h = np.repeat(rng.normal(0, 1, (1, lm.HIDDEN)).astype(np.float32), len(vocab.words) + 1, axis=0)
    unknown = lm.locate(vocab, np.array([1], np.uint64))
    _, cls, slot, within, _ = (np.concatenate(x) for x in zip(lm.locate(vocab, vocab.words), unknown, strict=True))
    logp = lm._output(p, h, cls, slot) + within
    # the rare class's share belongs to all its words and the unknown one together
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-4)
    assert vocab.rare_mass == pytest.approx(vocab.n - vocab.counts.sum() + 0.5 * (vocab.v - len(vocab.words) + 1))


def test_gradients(spark):
    rng = np.random.default_rng(1)
    vocab = small_vocab(spark, [" ".join(f"w{i % 50}" for i in range(400))])
    p = {k: v.astype(np.float64) for k, v in lm.start_parameters(vocab).items()}
    x = rng.integers(0, 20, (5, 3))
    cls, slot = vocab.cls[:15], vocab.slot[:15]
    h0 = rng.normal(0, 0.3, (3, lm.HIDDEN))
    goes_on = np.array([[1, 0, 1], [1, 1, 1], [0, 1, 1], [1, 1, 0], [1, 0, 1]], float)  # texts begin within the window

    def loss(grads=None):
        states, kept, _ = lm._forward(p, p["emb"] @ p["wx"] + p["b"], x, h0, goes_on)
        flat = states
        out = lm._output(p, flat.reshape(-1, lm.HIDDEN), cls, slot, grads)
        if grads is not None:
            lm._backward(p, grads, x, kept, out[1].reshape(flat.shape), goes_on)
            out = out[0]
        return -out.sum()

    grads = {k: np.zeros_like(v) for k, v in p.items()}
    loss(grads)
    for k in p:
        for _ in range(4):
            i = tuple(rng.integers(0, n) for n in p[k].shape)
            if k == "emb":
                i = (x[rng.integers(0, 5), rng.integers(0, 3)], i[1])
            keep, e = p[k][i], 1e-5
            p[k][i] = keep + e
            up = loss()
            p[k][i] = keep - e
            down = loss()
            p[k][i] = keep
            assert grads[k][i] == pytest.approx((up - down) / (2 * e), abs=1e-3, rel=1e-3)


def test_windows_carry_the_state(spark, monkeypatch):
    vocab = small_vocab(spark, [" ".join(f"w{i % 50}" for i in range(400))])
    p = lm.start_parameters(vocab)
    p = {k: v + np.random.default_rng(2).normal(0, 0.3, v.shape).astype(np.float32) for k, v in p.items()}
    texts = [" ".join(f"w{(i * 7) % 53}" for i in range(n)) for n in (0, 1, 23, 24, 25, 130)]
    h, first = lm.token_hashes(texts)
    alone = [lm.score_texts(p, vocab, *lm.token_hashes([t]))[0][0] for t in texts]
    monkeypatch.setattr(lm, "WINDOW", 7)
    assert lm.score_texts(p, vocab, h, first)[0] == pytest.approx(alone, rel=1e-4)


def test_streams_hold_every_token_once():
    sizes = np.array([5, 1, 40, 7, 7, 1, 1])
    first = np.concatenate(([0], np.cumsum(sizes)))
    for streams in (1, 3, 50):
        place, length = lm._streams(first, streams)
        columns = [place[:n, c].tolist() for c, n in enumerate(length)]
        assert sorted(i for c in columns for i in c) == list(range(62)) and (np.diff(length) <= 0).all()
        for c in columns:  # texts stay whole and in one stream
            assert all(b == a + 1 or b in first for a, b in zip(c, c[1:], strict=False))
    assert lm._streams(np.zeros(1, np.int64), 4)[1].size == 0


def test_trains_on_every_document(spark):
    """Each document has a word of its own; all their embeddings move, also if the corpus counts as large."""
    texts = [f"d{i} " * 20 for i in range(90)]
    vocab = dataclasses.replace(small_vocab(spark, texts, neural=400), n=1 << 30)
    df = spark.createDataFrame([(i * (1 << 30) // 90, t) for i, t in enumerate(texts)], "draw long, text string").repartition(3)
    own = vocab.entry[vocab.words != lm.END]
    moved = np.abs(lm.train(df, vocab)["emb"] - lm.start_parameters(vocab)["emb"])[own].max(axis=1)
    assert len(own) == 90 and (moved > 1e-4).all()


def test_learns_and_handles_empty_tables(spark, docs_of):
    rows = [(i, " ".join(["the cat sat on the mat .", "der hund lief in das haus ."][i % 2] for _ in range(30))) for i in range(300)]
    got = lm.score_documents(docs_of(rows)).toPandas()
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() * 0.8
    assert lm.score_documents(docs_of([])).count() == 0
    only_held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    (r,) = lm.score_documents(docs_of([(only_held, "a b")])).collect()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (3, 0, 0)
