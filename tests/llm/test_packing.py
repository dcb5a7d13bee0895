import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from mergelens.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "Ⅻ ﬁ İstanbul ΑΣ ας' it's I'LL don't 'S", "é é ́x ≠ a<|endoftext|>b x\x1cy z w ⅷ 日本語 12345 a1b2 ß ẞ ŉ ĳ ŀ DŽ",
    "", "   ", "😀😀👍🏽 o'clock d'ré l'été 'tis", "\x00\x01 ﻿ Ĳ İi ı K Å", "don't DON'T 'Ve x'llama", "a​b　c d",
]


def reference_ids(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def ids_of(coder, texts):
    flat, cuts = coder.ids([t.encode() for t in texts])
    return [flat[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_ids_equal_the_tokenizer(monkeypatch):
    coder = packing.WordTokenizer(PATH)
    want = [reference_ids(t)[:-1] for t in ODD]
    assert [ids_of(coder, [t])[0] for t in ODD] == want
    assert ids_of(coder, ODD) == want and ids_of(packing.WordTokenizer(PATH), ODD[::-1]) == want[::-1]
    assert ids_of(coder, []) == []
    monkeypatch.setattr(packing, "CACHE_WORDS", 25)
    small, rnd = packing.WordTokenizer(PATH), random.Random(1)
    words = [f"{rnd.choice(['the', 'Haus', 'œuf', '#', 'x1', 'THE', '<|endoftext|>', '½'])}{rnd.choice(['', '.', i % 40])}" for i in range(300)]
    for at in range(0, 300, 10):
        text = " ".join(words[at : at + 10])
        assert ids_of(small, [text, "", text.upper()]) == [reference_ids(text)[:-1], [], reference_ids(text.upper())[:-1]]


def first_fit(sizes, capacity):
    room, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, left in enumerate(room):
            if left >= sizes[i]:
                break
        else:
            b = len(room)
            room.append(capacity)
        out[i] = (b, capacity - room[b])
        room[b] -= sizes[i]
    return out


@given(st.lists(st.integers(1, 50), max_size=60))
def test_tree_is_first_fit(sizes):
    assert packing.first_fit_decreasing(sizes, 50) == first_fit(sizes, 50)


def test_every_id_once(docs_of):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(["the", "house", "of", "quatre", "x1"], k=rnd.choice([3, 60, 400, 5000])))) for i in range(60)]
    rows += [(900 + i, t) for i, t in enumerate(ODD)] + [(1, rows[1][1]), (None, "a b"), (999, None)]
    got = packing.pack_documents(docs_of(rows), PATH, group_docs=20).collect()
    texts = defaultdict(list)
    for i, t in rows:
        texts[i].append(reference_ids(t))
    pieces, bins = Counter(), defaultdict(list)
    for r in got:
        ids = texts[r["doc_id"]][0]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces[r["doc_id"]] += r["length"]
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces == {i: sum(map(len, ts)) for i, ts in texts.items()}
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= packing.SEQUENCE


def test_empty(docs_of):
    assert packing.pack_documents(docs_of([]), PATH).count() == 0
