"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its subwords (character 1- to 4-grams of each letter
run, in boundary marks, hashed into a fixed number of rows); a linear layer and a softmax give
the languages' probabilities. Embeddings and layer are trained together by stochastic gradient
descent in numpy on the driver, on the subword counts of a bounded sample of labelled rows,
which tasks take from their whole texts. A temperature that depends on a text's length, fitted
on whole documents kept out of training, calibrates the probabilities; a text whose probability
is below the calibrated threshold is marked as rejected.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, mix64, text_slices

BUCKETS = 1 << 15
DIM = 16
#: Bounds of the sample for training: labelled rows of each language, and languages.
MAX_LABELLED, MAX_LANGUAGES = 1000, 256
UNDETERMINED = "und"

_LETTERS = regex.compile(r"\p{L}+")
_CACHE_WORDS = 300_000


def letter_runs(text: str) -> list[str]:
    return _LETTERS.findall(text.lower())


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, index of its word) of every 1- to 4-gram of the words, with boundary marks."""
    marked = [f"<{w}>" for w in words]
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    of = np.repeat(np.arange(len(marked)), sizes)
    end = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(code))
    rows, index = [], []
    acc = np.zeros(len(code), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, 5):
            live = at[at + n <= end]
            acc = acc.copy()
            acc[live] = acc[live] * np.uint64(0x100000001B3) + code[live + n - 1] + np.uint64(n)
            rows.append((mix64(acc[live]) % np.uint64(BUCKETS)).astype(np.int64))
            index.append(of[live])
    return np.concatenate(rows), np.concatenate(index)


@dataclass
class LanguageModel:
    langs: list[str]
    scores: np.ndarray  # BUCKETS x langs: each row's embedding times the linear layer
    bias: np.ndarray
    temperature: float  # of a text of one subword
    power: float  # of a text's number of subwords, that its temperature falls with
    threshold: float

    def logits(self, total: np.ndarray, count: np.ndarray) -> np.ndarray:
        count = np.maximum(count, 1)[:, None]
        return (total / count + self.bias) * count**self.power / self.temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their counts) of a whole text's subwords: BUCKETS numbers at most, however long it is."""
    total = np.zeros(BUCKETS, np.int64)
    runs = letter_runs(text)
    for i in range(0, len(runs), 20_000):
        total += np.bincount(subwords(runs[i : i + 20_000])[0], minlength=BUCKETS)
    rows = np.flatnonzero(total)
    return rows, total[rows].astype(np.float32)


def train(texts: list[str], labels: list[str], **more) -> LanguageModel:
    """Fit to whole texts; those without a letter are left out."""
    features = [counted(t) for t in texts]
    some = [i for i, (rows, _) in enumerate(features) if len(rows)]
    return train_counted([features[i] for i in some], [labels[i] for i in some], **more)


def _held_out(ys: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A quarter of each language's documents; a language of fewer than four keeps all for training."""
    held = np.zeros(len(ys), bool)
    for y in np.unique(ys):
        own = rng.permutation(np.flatnonzero(ys == y))
        held[own[: len(own) // 4]] = True
    return held


def train_counted(features: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dim: int = DIM, epochs: int = 6, rate: float = 1.0, batch: int = 64, seed: int = 5) -> LanguageModel:
    """Fit by SGD on three quarters of the documents; the others, whole, calibrate."""
    langs = sorted(set(labels))
    number = {lang: i for i, lang in enumerate(langs)}
    ys = np.array([number[x] for x in labels])
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, dim))
    out, bias = np.zeros((dim, len(langs))), np.zeros(len(langs))
    held = _held_out(ys, rng)
    fit, held = np.flatnonzero(~held), np.flatnonzero(held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        turn = rng.permutation(fit)
        for some in (turn[i : i + batch] for i in range(0, len(turn), batch)):
            sizes = np.array([len(features[i][0]) for i in some])
            flat, of = np.concatenate([features[i][0] for i in some]), np.repeat(np.arange(len(some)), sizes)
            share = np.concatenate([features[i][1] / features[i][1].sum() for i in some])[:, None]
            mean = np.add.reduceat(emb[flat] * share, np.concatenate(([0], np.cumsum(sizes)[:-1])))
            p = _softmax(mean @ out + bias)
            p[np.arange(len(some)), ys[some]] -= 1
            back = (p @ out.T)[of] * share
            out -= step * mean.T @ p / len(some) * 8
            bias -= 0.1 * step * p.mean(axis=0)
            for d in range(dim):
                emb[:, d] -= 2 * step * np.bincount(flat, back[:, d], minlength=BUCKETS)
    model = LanguageModel(langs, emb @ out, bias, 1.0, 0.0, 0.0)
    if len(held):
        sizes = np.array([features[i][1].sum() for i in held], float)
        z = np.array([features[i][1] @ model.scores[features[i][0]] for i in held])
        y, at = ys[held], np.arange(len(held))
        best = np.inf
        for power in (0.0, 0.125, 0.25, 0.375, 0.5):
            for temperature in np.geomspace(0.05, 50, 60):
                tried = LanguageModel(langs, model.scores, bias, float(temperature), power, 0.0)
                loss = -np.log(_softmax(tried.logits(z, sizes))[at, y] + 1e-12).mean()
                if loss < best:
                    best, model = loss, tried
        p = _softmax(model.logits(z, sizes))
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(np.quantile(right, 0.005)) if len(right) else 0.0
    return model


def _counts(batches):
    """Each whole text's counted subwords in place of the text; none for texts without a letter."""
    import pyarrow as pa

    for batch in (part for whole in batches for part in text_slices(whole)):
        found = [counted(t) for t in batch.column("text").to_pylist()]
        some = [i for i, (rows, _) in enumerate(found) if len(rows)]
        blobs = [pa.array([found[i][j].astype(kind).tobytes() for i in some], pa.binary()) for j, kind in enumerate(("<i4", "<f4"))]
        taken = pa.array(some, pa.int64())
        yield pa.RecordBatch.from_arrays([*blobs, batch.column("lang").take(taken), batch.column("draw").take(taken)], names=["rows", "counts", "lang", "draw"])


def fit(docs: DataFrame, max_labelled: int = MAX_LABELLED, max_languages: int = MAX_LANGUAGES) -> LanguageModel | None:
    """Train on the whole texts of about ``max_labelled`` labelled rows of each language at most.

    They are drawn by a hash of id and text, so a rare language is learnt as well, and equal
    rows count once. Of more than ``max_languages`` values of lang those with most rows are
    learnt, ties by name. Rows of null text or lang, or whose crc32(doc_id) is divisible by 5,
    are not looked at. The driver gets BUCKETS counts of a row at most. None if there is no row
    with a letter to learn from.
    """
    rows = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), 5) != 0)
    ).select("text", "lang", F.xxhash64("doc_id", "text").alias("draw"))
    # max_languages rows at most
    shares = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_languages)
    shares = shares.select("lang", F.least(F.lit(1 << 30), F.lit((1 << 30) * max_labelled) / F.col("n")).alias("below"))
    drawn = rows.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1 << 30)) < F.col("below")).select("text", "lang", "draw")
    kept = drawn.mapInArrow(_counts, "rows binary, counts binary, lang string, draw long").dropDuplicates(["lang", "draw"]).collect()
    kept = sorted(kept, key=lambda r: (r["draw"], r["lang"]))
    features = [(np.frombuffer(r["rows"], "<i4"), np.frombuffer(r["counts"], "<f4")) for r in kept]
    return train_counted(features, [r["lang"] for r in kept]) if kept else None


class Scorer:
    """Scores whole texts; sums of words seen before are kept in a bounded cache."""

    def __init__(self, model: LanguageModel):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.sums = np.empty((0, len(self.model.langs) + 1))

    def _learn(self, words: list[str]) -> None:
        rows, of = subwords(words)
        new = [np.bincount(of, w, minlength=len(words)) for w in self.model.scores[rows].T]
        new.append(np.bincount(of, minlength=len(words)))
        self.at.update(zip(words, range(len(self.sums), len(self.sums) + len(words)), strict=True))
        self.sums = np.concatenate([self.sums, np.stack(new, axis=1)])

    def predict(self, texts: list[str | None]):
        m = self.model
        langs, scores, rejected = [], [], []
        runs = [letter_runs(t) if t else [] for t in texts]
        if len(self.at) > _CACHE_WORDS:
            self._clear()
        at = self.at
        new = list({w for r in runs for w in r if w not in at})
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        for r in runs:
            if not r:
                langs.append(UNDETERMINED), scores.append(0.0), rejected.append(True)
                continue
            total = self.sums[[at[w] for w in r]].sum(axis=0)
            p = _softmax(m.logits(total[None, :-1], total[-1:]))[0]
            best = int(p.argmax())
            langs.append(m.langs[best]), scores.append(float(p[best])), rejected.append(bool(p[best] < m.threshold))
        return langs, scores, rejected


PREDICTED = "doc_id long, lang_pred string, score double, rejected boolean"


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """A prediction for each row's whole text.

    ``und`` with score 0 where the text is null or has no letter (or nothing was learnt);
    ``rejected`` marks these and texts below the calibrated threshold.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x langs numbers at most

    def run(batches):
        import pyarrow as pa

        own = sent.value
        scorer = Scorer(own) if own else None
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = batch.column("text").to_pylist()
            if scorer:
                langs, scores, rejected = scorer.predict(texts)
            else:
                langs, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "lang_pred", "score", "rejected"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PREDICTED)


def identify_languages(docs: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """Train on and label the same table; adds held_out (the rows not learnt from)."""
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, fit(docs, max_labelled)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")
