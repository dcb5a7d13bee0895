"""Language-model scoring: a gated recurrent network with a class-factored softmax, in numpy.

Words are counted over all training documents. The most frequent ``NEURAL`` words have
embeddings of their own and fall into output classes of ``CLASS_SIZE``; all others share one
class for each range of counts, within which a word's probability is its smoothed share of the
class. So p(word) = p(class | state) * p(word | class, state), and the probabilities of the V
known words and of "unknown" add up to one.

The network is trained by truncated backpropagation in rounds: the training documents are split
over the rounds, every partition trains a copy on its share of them, slice by slice, and the
copies are averaged, weighted by their tokens, by grouped aggregation. So every training
document is trained on once, at every size of corpus. In training as in
scoring the state is carried from window to window, so a text's score is the log-likelihood of
the complete document.

Words in the table of frequent words (2**18 at most) are scored where the texts are; rarer ones
leave as hashes and meet their counts in a shuffled join.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_text, checkpoint, encoded, id_remainder, text_slices, word_hashes

NEURAL = 2048
CLASS_SIZE = 64
#: Classes of the other frequent words, by powers of four of their counts.
BANDS = 12
#: Bound of the table of frequent words that every executor gets.
FREQUENT = 1 << 18
EMBED, HIDDEN = 24, 24
WINDOW = 24
ROUNDS = 2
#: Streams of texts that run side by side at most, the steps that training on a slice of texts
#: takes at least where it can (by fewer streams), and bytes of text dealt to them at once.
STREAMS, STEPS = 128, 64
DEALT_BYTES = 24 << 20
_COUNT_TOKENS = 4 << 20
#: Rows of the network's output that are worked on at once, and of a class within these.
_ROWS, _BLOCK = 1536, 16
_LEAST = 8  # streams
#: Parts that a copy's parameters are averaged in, each by a task of its own.
PARTS = 16

#: The end of a text counts as a token.
END = np.uint64(0x2545F4914F6CDD1D)
_LN10 = float(np.log(10.0))


def token_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' words, each text followed by END; first token of each text)."""
    raw = encoded(texts)
    parts, sizes = [], []
    for part in batches_of_text(raw, 4 << 20):
        h, first, *_ = word_hashes(raw[part])
        parts.append(np.insert(h, first[1:], END))
        sizes.append(np.diff(first) + 1)
    if not parts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


# --- counts -------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """(word, c): exact counts of all tokens' hashes over the rows of (text).

    Each task merges the counts of about 4 million tokens at a time before they are shuffled.
    """

    def run(batches):
        held, n = [], 0

        def settle():
            words, c = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(c.astype(np.int64))], names=["word", "c"])

        for batch in batches:
            h, _ = token_hashes(batch.column("text").to_pylist())
            held.append(h)
            n += len(h)
            if n > _COUNT_TOKENS:
                n = 0
                yield settle()
        if n:
            yield settle()

    return train.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    words: np.ndarray  # sorted hashes of the frequent words
    counts: np.ndarray
    entry: np.ndarray  # row of the input table
    cls: np.ndarray
    slot: np.ndarray  # place in a neural class, or -1
    within: np.ndarray  # log p(word | class) of words in bands, 0 in neural classes
    neural_classes: int
    neural: int
    class_mass: np.ndarray
    neural_counts: np.ndarray
    n: int
    v: int
    rare_mass: float
    _jump: np.ndarray | None = None
    _ended: np.ndarray | None = None

    def find(self, h: np.ndarray) -> np.ndarray:
        """The place of each hash in ``words``, -1 if it is not there."""
        if self._jump is None:
            # first word of each range of hashes, which holds few; one more than all ends the last
            self._jump = np.searchsorted(self.words, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44)).astype(np.int32)
            self._ended = np.append(self.words, np.uint64(2**64 - 1))
        at = self._jump[(h >> np.uint64(44)).astype(np.int64)]
        behind = np.flatnonzero(self._ended[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self._ended[at[behind]] < h[behind]]
        return np.where((self._ended[at] == h) & (at < len(self.words)), at, -1)

    @property
    def rare(self) -> int:
        """The class of rare and unknown words."""
        return len(self.class_mass) - 1

    @property
    def inputs(self) -> int:
        """Rows of the input table: words, bands, rare, and the start of a text."""
        return self.neural + BANDS + 2


def vocabulary(counts: DataFrame, neural: int = NEURAL, frequent: int = FREQUENT) -> Vocabulary:
    """Totals and the table of frequent words, cut at a count so that it keeps its bound."""
    grade = F.floor(F.log2(F.col("c").cast("double")) * 32).cast("int")
    hist = counts.groupBy(grade.alias("g")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()
    n, v = sum(r["tokens"] for r in hist), sum(r["words"] for r in hist)
    kept, cut = 0, 1 << 30
    for r in sorted(hist, key=lambda r: -r["g"]):
        if kept + r["words"] > frequent:
            break
        kept, cut = kept + r["words"], r["g"]
    rows = counts.where(grade >= cut).collect()
    pairs = np.array([(r["word"], r["c"]) for r in rows], np.int64).reshape(-1, 2)
    words, c = pairs[:, 0].view(np.uint64), pairs[:, 1]
    order = np.argsort(words)
    words, c = words[order], c[order]
    by_count = np.lexsort((words, -c))
    m = min(neural, len(words))
    classes = -(-m // CLASS_SIZE)
    entry, cls, slot = (np.empty(len(words), np.int32) for _ in range(3))
    top, rest = by_count[:m], by_count[m:]
    entry[top] = np.arange(m)
    cls[top], slot[top] = np.arange(m) // CLASS_SIZE, np.arange(m) % CLASS_SIZE
    band = np.minimum(BANDS - 1, np.floor(np.log2(np.maximum(c[rest], 1)) / 2)).astype(np.int32)
    entry[rest], cls[rest], slot[rest] = neural + band, classes + band, -1
    mass = np.zeros(classes + BANDS + 1)
    np.add.at(mass, cls, c + 0.5)
    known = v - len(words)
    mass[-1] = (n - int(c.sum())) + 0.5 * (known + 1)
    within = np.where(slot < 0, np.log((c + 0.5) / mass[cls]), 0.0)
    return Vocabulary(words, c, entry, cls, slot, within, classes, neural, mass, c[top].astype(float), int(n), int(v), float(mass[-1]))


# --- the network --------------------------------------------------------------------------


def start_parameters(vocab: Vocabulary, seed: int = 11) -> dict[str, np.ndarray]:
    """Small random weights; output biases give the smoothed word frequencies."""
    rng = np.random.default_rng(seed)
    f = lambda *s, k=0.15: rng.normal(0, k, s).astype(np.float32)
    inner = np.full(vocab.neural_classes * CLASS_SIZE, -30.0, np.float32)
    inner[: len(vocab.neural_counts)] = np.log(vocab.neural_counts + 0.5)
    mass = np.maximum(vocab.class_mass, 1e-9)
    return {
        "emb": f(vocab.inputs, EMBED),
        "wx": f(EMBED, 3 * HIDDEN),
        "b": np.zeros(3 * HIDDEN, np.float32),
        "wh": f(HIDDEN, 3 * HIDDEN),
        "wc": f(HIDDEN, len(mass), k=0.02),
        "bc": np.where(vocab.class_mass > 0, np.log(mass), -30.0).astype(np.float32),
        "wi": f(vocab.neural_classes * CLASS_SIZE, HIDDEN, k=0.02),
        "bi": inner,
    }


def _turned(x: np.ndarray) -> np.ndarray:
    """The matrices of a stack transposed."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


#: The gates' arguments are kept negated, and the new state's times -2, so that exp gives
#: sigmoid as 1 / (1 + exp) and tanh as 2 / (1 + exp) - 1.
_SCALE = np.repeat(np.array([-1, -1, -2], np.float32), HIDDEN)


def _forward(p, table: np.ndarray, x: np.ndarray, h: np.ndarray, goes_on=None):
    """States after each step of a window: x is (steps, texts); table is emb @ wx + b.

    Where ``goes_on`` (of x's shape) is 0 a new text begins, from the zero state. Returns the
    states, what ``_backward`` needs, and the last states.
    """
    k = HIDDEN
    # one column a text, so that each gate lies together
    acts = _turned((table * _SCALE).take(x, axis=0))
    wh, h = np.ascontiguousarray((p["wh"] * _SCALE).T), np.ascontiguousarray(h.T)
    products = np.empty_like(acts)
    states = np.empty((len(x), k, x.shape[1]), acts.dtype)
    begins = np.zeros(len(x), bool) if goes_on is None else (goes_on == 0).any(axis=1)
    before = h
    for t in range(len(x)):
        if begins[t]:
            h = h * goes_on[t]
        if t == 0:
            before = h
        a, g, new = acts[t], np.matmul(wh, h, out=products[t]), states[t]
        gates, n = a[: 2 * k], a[2 * k :]
        gates += g[: 2 * k]
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        n += np.multiply(gates[k:], g[2 * k :], out=new)
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        np.subtract(h, n, out=new)
        new *= gates[:k]
        new += n
        h = new
    return _turned(states), (before, acts, products, states), h.T


def _softmax(z: np.ndarray, at: np.ndarray, chosen: np.ndarray, whole: bool) -> np.ndarray:
    """Log probabilities of the chosen places; ``z``, held within 60 of 0, is turned into all probabilities if ``whole``."""
    np.clip(z, -60, 60, out=z)
    own = z[at, chosen]
    np.exp(z, out=z)
    total = z @ np.ones(z.shape[1], z.dtype)
    if whole:
        z *= (1 / total)[:, None]
    own -= np.log(total)
    return own


def _output(p, h, cls, slot, grads=None):
    """Natural log probabilities of (class, place) given the states; adds gradients to grads."""
    at = np.arange(len(h))
    out, back = np.empty(len(h), h.dtype), np.empty_like(h) if grads is not None else None
    over = np.ascontiguousarray(p["wc"].T)
    # all classes of a block of rows fit in a core's cache
    for i in range(0, len(h), _ROWS):
        rows, own = h[i : i + _ROWS], cls[i : i + _ROWS]
        d = rows @ p["wc"]
        d += p["bc"]
        out[i : i + _ROWS] = _softmax(d, at[: len(rows)], own, grads is not None)
        if grads is not None:
            d[at[: len(rows)], own] -= 1
            grads["wc"] += rows.T @ d
            grads["bc"] += d.sum(axis=0)
            np.matmul(d, over, out=back[i : i + _ROWS])
    own = np.flatnonzero(slot >= 0)
    if len(own):
        _places(p, h, own, cls, slot, out, back, grads)
    return out if grads is None else (out, back)


def _places(p, h, own, cls, slot, out, back, grads) -> None:
    """Adds log p(place | class) of the rows ``own`` to ``out``, by blocks of rows of one class.

    A class's rows fill its blocks up from the first; what is left of its last one is padding.
    """
    k = HIDDEN
    own = own[np.argsort(cls[own].astype(np.int16), kind="stable")]
    classes = cls[own]
    begin = np.flatnonzero(np.diff(classes, prepend=-1))
    size = np.diff(begin, append=len(own))
    used, blocks = classes[begin], -(-size // _BLOCK)
    first_block = np.concatenate(([0], np.cumsum(blocks)))
    place = np.arange(len(own)) + np.repeat(first_block[:-1] * _BLOCK - begin, size)
    n = int(first_block[-1])
    of = np.repeat(used, blocks)
    rows, chosen = np.zeros((n * _BLOCK, k), h.dtype), np.zeros(n * _BLOCK, np.intp)
    rows[place], chosen[place] = h[own], slot[own]
    wi = p["wi"].reshape(-1, CLASS_SIZE, k)[of]
    stacked = rows.reshape(n, _BLOCK, k)
    d = stacked @ wi.transpose(0, 2, 1)
    d += p["bi"].reshape(-1, 1, CLASS_SIZE)[of]
    flat, at = d.reshape(n * _BLOCK, CLASS_SIZE), np.arange(n * _BLOCK)
    out[own] += _softmax(flat, at, chosen, grads is not None)[place]
    if grads is None:
        return
    flat[at, chosen] -= 1
    padding = np.ones(n * _BLOCK, bool)
    padding[place] = False
    flat[padding] = 0
    grads["wi"].reshape(-1, CLASS_SIZE, k)[used] += np.add.reduceat(d.transpose(0, 2, 1) @ stacked, first_block[:-1], axis=0)
    grads["bi"].reshape(-1, CLASS_SIZE)[used] += np.add.reduceat(d.sum(axis=1), first_block[:-1], axis=0)
    back[own] += (d @ wi).reshape(-1, k)[place]


def _backward(p, grads, x, kept, d_states, goes_on):
    """Backpropagation through one window, within each text."""
    k = HIDDEN
    first, acts, products, states = kept
    z, r, n = acts[:, :k], acts[:, k : 2 * k], acts[:, 2 * k :]
    before = np.concatenate((first[None], states[:-1] * goes_on[1:, None].astype(states.dtype)))
    # each step's derivatives but for what comes back to it, for the whole window at once
    by_new = (1 - z) * (1 - n * n)
    by_update = (before - n) * z * (1 - z)
    by_reset = products[:, 2 * k :] * r * (1 - r)
    by_reset *= -0.5  # the scale that the products are kept in
    begins = (goes_on == 0).any(axis=1)
    da, dg = np.empty_like(acts), np.empty_like(acts)
    d_states = _turned(d_states)
    dh = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        dh += d_states[t]
        a, g = da[t], dg[t]
        dn = np.multiply(dh, by_new[t], out=a[2 * k :])
        np.multiply(dh, by_update[t], out=a[:k])
        np.multiply(dn, by_reset[t], out=a[k : 2 * k])
        g[: 2 * k] = a[: 2 * k]
        np.multiply(dn, r[t], out=g[2 * k :])
        dh *= z[t]
        dh += p["wh"] @ g
        if begins[t]:
            dh *= goes_on[t]
    grads["wh"] += (before @ dg.transpose(0, 2, 1)).sum(axis=0)
    # one row for each word of the window
    order = np.argsort(x.astype(np.int16), axis=None, kind="stable")
    ids = x.ravel()[order]
    cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    d_table, ids = np.add.reduceat(_turned(da).reshape(-1, 3 * k)[order], cut), ids[cut]
    grads["b"] += d_table.sum(axis=0)
    grads["wx"] += p["emb"][ids].T @ d_table
    grads["emb"][ids] += d_table @ p["wx"].T


def locate(vocab: Vocabulary, h: np.ndarray):
    """(input row, class, place, log p within the class, count or -1 if not in the table)."""
    at = vocab.find(h)
    if not len(vocab.words):
        return np.full(len(h), vocab.neural + BANDS, np.int32), np.full(len(h), vocab.rare, np.int32), at.astype(np.int32), np.zeros(len(h)), at
    here = at >= 0
    return (
        np.where(here, vocab.entry[at], vocab.neural + BANDS).astype(np.int32),
        np.where(here, vocab.cls[at], vocab.rare).astype(np.int32),
        np.where(here, vocab.slot[at], -1).astype(np.int32),
        np.where(here, vocab.within[at], 0.0),
        np.where(here, vocab.counts[at], -1),
    )


def _views(flat: np.ndarray, like: dict) -> dict:
    """The arrays of ``like`` as views of one flat array, in the order of their names."""
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


class _Adam:
    """Parameters in one flat array with Adam's state, kept from slice to slice."""

    def __init__(self, p0: dict, rate: float):
        self.flat = _flat(p0)
        self.p = _views(self.flat, p0)
        self.gradient = np.zeros_like(self.flat)
        self.grads = _views(self.gradient, p0)
        self.m, self.v2, self.work = (np.zeros_like(self.flat) for _ in range(3))
        self.rate, self.step = rate, 0

    def move(self, scale: float) -> None:
        """One step along the scaled and clipped gradients, which start again from zero."""
        g, m, v2, work = self.gradient, self.m, self.v2, self.work
        self.step += 1
        g *= np.float32(scale)
        np.clip(g, -1, 1, out=g)
        m += np.multiply(np.subtract(g, m, out=work), np.float32(0.1), out=work)
        g *= g
        v2 += np.multiply(np.subtract(g, v2, out=work), np.float32(0.01), out=work)
        np.sqrt(np.divide(v2, np.float32(1 - 0.99**self.step), out=work), out=work)
        work += np.float32(1e-6)
        np.divide(m, work, out=work)
        work *= np.float32(self.rate / (1 - 0.9**self.step))
        self.flat -= work
        g[:] = 0


def train_copy(p0: dict, vocab: Vocabulary, slices, rate: float):
    """Train a copy of the parameters by Adam on lists of texts in turn; (parameters, tokens)."""
    adam = _Adam(p0, rate)
    tokens = 0
    for texts in slices:
        tokens += _train_slice(adam, vocab, texts)
    return adam.p, tokens


def deal(size: np.ndarray, streams: int) -> list[list[int]]:
    """Texts of these sizes over at most ``streams`` streams of about equal length, the longest stream first."""
    loads = [(0, i) for i in range(min(streams, len(size)))]
    out: list[list[int]] = [[] for _ in loads]
    for t in np.argsort(-size, kind="stable").tolist():
        load, i = heapq.heappop(loads)
        out[i].append(t)
        heapq.heappush(loads, (load + int(size[t]), i))
    return [out[i] for _, i in sorted(loads, reverse=True)]


def _streams(first: np.ndarray, streams: int) -> tuple[np.ndarray, np.ndarray]:
    """(token numbers, one column a stream; the streams' lengths, falling)."""
    size = np.diff(first)
    dealt = deal(size, streams)
    length = np.array([size[ts].sum() for ts in dealt], np.int64)
    place = np.zeros((int(length[0]) if len(length) else 0, len(dealt)), np.int32)
    for c, ts in enumerate(dealt):
        place[: length[c], c] = np.concatenate([np.arange(first[t], first[t + 1], dtype=np.int32) for t in ts])
    return place, length


def _train_slice(adam: _Adam, vocab: Vocabulary, texts: list[str | None], streams: int = STREAMS) -> int:
    """One pass over the texts, dealt to streams that run side by side; a text's state is carried
    from window to window of its stream, and the next text begins anew."""
    p, grads = adam.p, adam.grads
    h_all, first = token_hashes(texts)
    entry, cls, slot, *_ = locate(vocab, h_all)
    prev = np.concatenate(([0], entry[:-1]))
    prev[first[:-1]] = vocab.inputs - 1
    begins = np.zeros(len(h_all), bool)
    begins[first[:-1]] = True
    place, length = _streams(first, min(streams, max(_LEAST, len(h_all) // (WINDOW * STEPS))))
    if not len(length):
        return 0
    h = np.zeros((len(length), HIDDEN), np.float32)
    for at in range(0, len(place), WINDOW):
        k = int(np.searchsorted(-length, -at, side="left"))  # streams that reach this window
        idx = place[at : at + WINDOW, :k].astype(np.intp)
        whole = int(length[k - 1]) >= at + len(idx)  # no stream ends in this window
        there = (at + np.arange(len(idx)))[:, None] < length[:k]
        x, goes_on = prev[idx], (~begins[idx]).astype(np.float32)
        table = p["emb"] @ p["wx"] + p["b"]
        states, kept, h = _forward(p, table, x, h[:k], goes_on)
        flat, sel = states, slice(None) if whole else np.flatnonzero(there.ravel())
        of, rows = idx.ravel()[sel], flat.reshape(-1, HIDDEN)[sel]
        _, d = _output(p, rows, cls[of], slot[of], grads)
        if not whole:
            back, d = d, np.zeros((flat.shape[0] * flat.shape[1], HIDDEN), np.float32)
            d[sel] = back
        _backward(p, grads, x, kept, d.reshape(flat.shape), goes_on)
        adam.move(1.0 / max(len(of), 1))
    return len(h_all)


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def train(docs: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS, rate: float = 0.004) -> dict:
    """Rounds of local training and averaging over the training rows of (draw, text).

    A round trains on the rows whose draw (below 2**30) falls into its part; the parts together
    are all rows.
    """
    sc = docs.sparkSession.sparkContext
    p = start_parameters(vocab)

    merged = "part long, weighted binary, tokens long"

    def merge(rows: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(b.as_buffer(), np.float64) for b in rows["weighted"]], axis=0)
        tokens = [sum(rows["tokens"].to_pylist())]
        return pa.table({"part": rows["part"][:1], "weighted": pa.array([total.tobytes()], pa.binary()), "tokens": tokens})

    for r in range(rounds):
        sent = sc.broadcast((p, vocab))  # a fixed number of parameters and 2**18 words at most

        def run(batches, sent=sent, r=r):
            from pyspark import TaskContext

            p0, voc = sent.value

            def slices():
                held, total = [], 0
                for batch in (part for whole in batches for part in text_slices(whole)):
                    for text in batch.column("text").to_pylist():
                        held.append(text)
                        total += len(text or "")
                        if total >= DEALT_BYTES:
                            yield held
                            held, total = [], 0
                if held:
                    yield held

            own, n = train_copy(p0, voc, slices(), rate / (r + 1))
            if n:
                blobs = [x.tobytes() for x in np.array_split(_flat(own).astype(np.float64) * n, PARTS)]
                level = TaskContext.get().partitionId() // 256
                yield pa.RecordBatch.from_arrays(
                    [pa.array([level] * PARTS), pa.array(range(PARTS), pa.int64()), pa.array(blobs, pa.binary()), pa.array([n] * PARTS)],
                    names=["level", "part", "weighted", "tokens"],
                )

        low, high = ((1 << 30) * (r + k) // rounds for k in (0, 1))
        copies = docs.where((F.col("draw") >= low) & (F.col("draw") < high)).select("text").mapInArrow(run, f"level long, {merged}")
        halfway = copies.groupBy("level", "part").applyInArrow(merge, merged)
        rows = sorted(halfway.groupBy("part").applyInArrow(merge, merged).collect(), key=lambda x: x["part"])
        if rows:
            flat = np.concatenate([np.frombuffer(bytes(x["weighted"]), np.float64) / x["tokens"] for x in rows])
            p = _views(flat.astype(np.float32), p)
    return p


def score_texts(p: dict, vocab: Vocabulary, h: np.ndarray, first: np.ndarray, streams: int = STREAMS) -> tuple[np.ndarray, np.ndarray]:
    """(natural log probability of each text without p(word | rare), count of each token or -1 if it is rare).

    Texts are dealt to streams that run side by side; each begins from the zero state.
    """
    entry, cls, slot, within, counts = locate(vocab, h)
    prev = np.concatenate(([0], entry[:-1])).astype(np.int32)
    prev[first[:-1]] = vocab.inputs - 1
    begins = np.zeros(len(h), bool)
    begins[first[:-1]] = True
    place, length = _streams(first, streams)
    table = p["emb"] @ p["wx"] + p["b"]
    logp = within.copy()
    state = np.zeros((len(length), HIDDEN), np.float32)
    for at in range(0, len(place), WINDOW):
        k = int(np.searchsorted(-length, -at, side="left"))
        idx = place[at : at + WINDOW, :k].astype(np.intp)
        there = slice(None) if int(length[k - 1]) >= at + len(idx) else ((at + np.arange(len(idx)))[:, None] < length[:k]).ravel()
        states, _, state = _forward(p, table, prev[idx], state[:k], (~begins[idx]).astype(np.float32))
        idx = idx.ravel()[there]
        logp[idx] += _output(p, states.reshape(-1, HIDDEN)[there], cls[idx], slot[idx])
    return np.add.reduceat(logp, first[:-1]) if len(first) > 1 else np.empty(0), counts


def score_documents(docs: DataFrame, held_out=None) -> DataFrame:
    """Score every row of (doc_id, text); learn from the rows that are not held out.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score. Null and
    empty texts have the end as their one token. ``held_out`` is a boolean column, by default
    crc32(doc_id as text) mod 5 = 1; a null id is not held out. Repeated rows count and are
    scored each. Without any training token every token is unknown.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    held = id_remainder(F.col("doc_id"), 5) == 1 if held_out is None else held_out
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held_out"), "text")
    learnt = rows.where(~F.col("held_out"))
    counts = checkpoint(word_counts(learnt.select("text")))
    vocab = vocabulary(counts)
    draws = learnt.select(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)).alias("draw"), "text")
    sent = sc.broadcast((train(draws, vocab), vocab))
    n, v = vocab.n, vocab.v
    base_total = float(np.log10(n + 0.5 * (v + 1)))

    def run(batches):
        p, voc = sent.value
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for part in batches_of_text(encoded(texts), 24 << 20):
                h, first = token_hashes(texts[part])
                logp, c = score_texts(p, voc, h, first)
                rare = c < 0
                c = np.where(rare, 0, c)
                base = np.add.reduceat(np.where(rare, 0.0, np.log10(c + 0.5) - base_total), first[:-1])
                known = np.add.reduceat((~rare).astype(np.int64), first[:-1])
                words = h.view(np.int64)
                rare_sizes = np.add.reduceat(rare.astype(np.int64), first[:-1])
                offsets = np.concatenate(([0], np.cumsum(rare_sizes))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[part.start : part.stop],
                        batch.column("held_out")[part.start : part.stop],
                        pa.array(np.diff(first)),
                        pa.array(known),
                        pa.array(base),
                        pa.array(logp / _LN10),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(words[rare])),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "logp", "rare"],
                )

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, logp double, rare array<long>"
    scored = rows.mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id())
    scored = checkpoint(scored)
    # Rare words meet their counts; words without a training count keep c = 0.
    rare = scored.select("row", F.explode("rare").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"), F.count("*").alias("n_rare"), F.count("c").alias("rare_known")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    n_rare = zero("n_rare")
    return scored.drop("rare").join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + zero("rare_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + zero("logs") - n_rare * F.lit(base_total)).alias("base_score"),
        (F.col("logp") + zero("logs") - n_rare * F.lit(float(np.log10(vocab.rare_mass)))).alias("score"),
    )
