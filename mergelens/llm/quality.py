"""Quality classifier: a document model combined with site posteriors by empirical Bayes.

A logistic model on surface features gives each document's evidence. A host's share of good
documents is shrunk towards the global share, and a path's towards its host's, each by a
pseudo-count fitted from the spread of the observed shares (method of moments), so sites with
few documents stay close to their prior. A document's final log-odds add what its path's
posterior says beyond the global prior to its own evidence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, batches_of_text, checkpoint, encoded, giving_back, text_slices, word_hashes

#: Bound of the labelled sample that the document model is fitted on.
MAX_LABELLED = 8000
#: Weight of the site's posterior in the final log-odds.
SITE_WEIGHT = 0.5
#: Documents are rejected below this probability of being good.
REJECT_BELOW = 0.5

FEATURES = (
    "log_words", "upper", "digit", "symbol", "mark", "space", "non_ascii", "word_length",
    "long_words", "distinct", "line_length", "repeated_lines", "pipes", "exclaims", "stops",
)

_CLASS = np.zeros((256, 8), np.int64)
_CLASS[ord("A") : ord("Z") + 1, 0] = 1
_CLASS[ord("0") : ord("9") + 1, 1] = 1
_CLASS[[ord(c) for c in "#$%&*+<=>@^_~{}[]\\/`"], 2] = 1
_CLASS[[ord(c) for c in ".,;:?!'\"()-"], 3] = 1
_CLASS[[0x20, *range(9, 14)], 4] = 1
_CLASS[128:, 5] = 1
_CLASS[ord("|"), 6] = 1
_CLASS[ord("!"), 7] = 1


def features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; null counts as empty, whose row is all zeros."""
    out = np.zeros((len(texts), len(FEATURES)))
    raw = encoded(texts)
    for part in batches_of_text(raw):
        some = raw[part]
        h, first, starts, ends, _ = word_hashes(some)
        rows = out[part]
        for i, text in enumerate(some):
            n = len(text)
            if not n:
                continue
            counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _CLASS / n
            a, b = first[i], first[i + 1]
            words = int(b - a)
            lengths = ends[a:b] - starts[a:b]
            lines = [x for x in text.split(b"\n") if x]
            stops = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
            rows[i] = (
                np.log1p(words), *counts[:6], lengths.mean() if words else 0.0,
                (lengths > 20).mean() if words else 0.0, len(np.unique(h[a:b])) / max(words, 1),
                np.log1p(n / max(len(lines), 1)), 1 - len(set(lines)) / max(len(lines), 1),
                counts[6], counts[7], min(1.0, 10 * stops / max(words, 1)),
            )
    return out


@dataclass
class DocumentModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(_expand((x - self.mean) / self.scale) @ self.weights + self.bias, -12, 12)


def _expand(z: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6], axis=1)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> DocumentModel:
    """Ridge logistic regression by Newton steps; with one class only, its smoothed log-odds."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    width = 2 * x.shape[1]
    prior = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    w = np.zeros(width + 1)
    w[-1] = prior
    if 0 < y.sum() < len(y):
        z = np.hstack([_expand((x - mean) / scale), np.ones((len(x), 1))])
        keep = np.full(width + 1, ridge)
        keep[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(keep), z.T @ (y - p) - keep * w)
            w += step / max(1.0, np.abs(step).max() / 5)
            if np.abs(step).max() < 1e-6:
                break
    return DocumentModel(mean, scale, w[:-1], float(w[-1]))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DocumentModel | None:
    """Fit on about ``max_labelled`` labelled rows, drawn by a hash of the id; None without any.

    Labels of null id or quality are not used; of several labels of an id the highest holds.
    """
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    drawn = marked.select(F.col("doc_id").alias("label_id"), "quality", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("draw"))
    n = drawn.count()
    drawn = drawn.where(F.col("draw") < int((1 << 30) * min(1.0, max_labelled / max(n, 1))))
    # at most about max_labelled rows of three numbers: small enough for every executor
    rows = docs.select(F.col("doc_id").alias("label_id"), "text").join(F.broadcast(drawn), "label_id").select("draw", "quality", "text")

    def measure(batches):
        for batch in batches:
            x = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("draw"), batch.column("quality").cast(pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["draw", "quality", "x"])

    got = sorted(tuple(r) for r in rows.mapInArrow(giving_back(measure), "draw long, quality long, x array<double>").collect())
    if not got:
        return None
    return train(np.array([r[2] for r in got]), np.array([float(r[1] > 0) for r in got]))


def evidence(docs: DataFrame, model: DocumentModel | None, keys: list[Column], within: str | None = None) -> DataFrame:
    """The key columns and ``logit``, the document model's log-odds of each whole text.

    ``within`` names a key, a struct, that holds the text; else the frame's text is read.
    """
    kinds = docs.select(*keys).withColumn("logit", F.lit(0.0)).schema
    names = kinds.names[:-1]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keys, *([] if within else [F.col("text").alias("__text")]))

    def run(batches):
        for batch in (part for whole in batches for part in text_slices(whole)):
            texts = (batch.column(within).field("text") if within else batch.column("__text")).to_pylist()
            z = sent.value.logits(features(texts)) if sent.value else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(z, pa.float64())], names=[*names, "logit"])

    return source.mapInArrow(giving_back(run), kinds)


def _shrink(share: Column, n: Column, prior: Column, strength: Column) -> Column:
    return (share * n + prior * strength) / (n + strength)


def site_posteriors(scored: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """(host, path, prior, host_share, path_share, host_n, path_n) for each path.

    Null hosts and paths are sites of their own. The pseudo-count at each level is
    m(1-m) / between-site variance - 1, at least 1 and at most 1e6.
    """
    p = 1 / (1 + F.exp(-F.col("logit")))
    paths = scored.groupBy(host, path).agg(F.count("*").alias("path_n"), F.sum(p).alias("good"))
    hosts = paths.groupBy(F.col(host).alias("__host")).agg(F.sum("path_n").alias("host_n"), F.sum("good").alias("host_good"))
    # one row: the global share and the hosts' spread
    whole = hosts.agg(
        (F.sum("host_good") / F.sum("host_n")).alias("prior"),
        F.coalesce(F.var_pop(F.col("host_good") / F.col("host_n")), F.lit(0.0)).alias("spread"),
    )
    level = lambda m, v: F.greatest(F.lit(1.0), F.least(F.lit(1e6), m * (1 - m) / F.greatest(v, F.lit(1e-9)) - 1))
    prior = whole.select("prior", level(F.col("prior"), F.col("spread")).alias("host_strength"))
    hosts = hosts.join(F.broadcast(prior)).withColumn(
        "host_share", _shrink(F.col("host_good") / F.col("host_n"), F.col("host_n"), F.col("prior"), F.col("host_strength"))
    )
    both = paths.join(hosts, F.col(host).eqNullSafe(F.col("__host")))
    gap = F.pow(F.col("good") / F.col("path_n") - F.col("host_share"), 2)
    within = both.agg(F.coalesce(F.avg(gap), F.lit(0.0)).alias("within"), F.max("prior").alias("__prior"))
    strength = within.select(level(F.coalesce("__prior", F.lit(0.5)), F.col("within")).alias("path_strength"))
    return both.join(F.broadcast(strength)).select(
        host, path, "prior", "host_share",
        _shrink(F.col("good") / F.col("path_n"), F.col("path_n"), F.col("host_share"), F.col("path_strength")).alias("path_share"),
        "host_n", "path_n",
    )


def combine(scored: DataFrame, sites: DataFrame, host: str = "host", path: str = "path", weight: float = SITE_WEIGHT) -> DataFrame:
    """Adds ``quality`` (the final probability) and the site's shares to the scored rows."""
    site = sites.select(F.col(host).alias("__h"), F.col(path).alias("__p"), "prior", "host_share", "path_share")
    if site.count() <= BROADCAST_ROWS:
        site = F.broadcast(site)
    odds = lambda c: F.log(F.greatest(c, F.lit(1e-6)) / F.greatest(1 - c, F.lit(1e-6)))
    joined = scored.join(site, F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p")))
    z = F.col("logit") + weight * (odds(F.col("path_share")) - odds(F.col("prior")))
    return joined.withColumn("quality", 1 / (1 + F.exp(-z))).drop("__h", "__p", "prior")


def _sites(host: Column, path: Column) -> list[Column]:
    return [host.alias("host"), path.alias("path")]


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """(doc_id, host, path, logit, host_share, path_share, quality, keep) for every row.

    The defaults take ``source`` as the host and source/lang as the path. Null and empty texts
    are scored by their all-zero features; without labels the evidence is 0 for all rows.
    """
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if path is None else path
    model = fit(docs, labels)
    # the texts are read once for all that follows
    scored = checkpoint(evidence(docs, model, [F.col("doc_id").cast("long").alias("doc_id"), *_sites(host, path)]))
    sites = site_posteriors(scored)
    return combine(scored, sites).withColumn("keep", F.col("quality") >= REJECT_BELOW)


def keep_good(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None) -> DataFrame:
    """The input rows, all columns, whose documents are not rejected."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit(""))) if path is None else path
    model = fit(docs, labels)
    sites = site_posteriors(checkpoint(evidence(docs, model, _sites(host, path))))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    scored = evidence(docs, model, [row, *_sites(host, path)], within="__row")
    return combine(scored, sites).where(F.col("quality") >= REJECT_BELOW).select("__row.*")
