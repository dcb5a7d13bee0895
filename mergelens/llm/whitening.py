"""Whitening of embeddings by the singular values of their centred rows.

Every remaining component becomes a whole number; sums and deviations are exact. The centred
rows form a distributed row matrix whose singular vectors are the principal components: a
singular value's square over n is a component's variance. The total variance comes from the
exact deviations, apart from the decomposition.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Context, Decimal

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, done, map_arrow, shared

SCALE, OFFSET = 1024.0, 100_000
COMPONENTS = 8
#: Share of the largest variance below which a component counts as one without variance.
LEAST_VARIANCE = 1e-12


def whole_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>): floor(SCALE * c) + OFFSET of each usable vector.

    Vectors that are null, empty, or hold null or non-finite components take no part; of several
    lengths the most frequent one does (of equally frequent ones the longest). A component beyond
    the range of a long raises Spark's overflow error.
    """
    c = F.col(f"`{column}`").cast("array<double>")
    fine = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = F.transform(c, lambda v: F.floor(v * SCALE) + F.lit(OFFSET).cast("long"))
    # the condition stands in the value too, as filters may be evaluated in any order
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fine, x).alias("x")).where("x is not null")
    lengths = out.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d"))
    most = lengths.first()
    return out.where(F.size("x") == (most["d"] if most else 0))


@dataclass
class Whitening:
    """n, the sums of each dimension, unit components (a row each) by falling variance, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    total: float


def with_deviation(rows: DataFrame, n: int, sums: list[int]) -> DataFrame:
    """``rows`` with the exact sum over dimensions of (n * x - S)^2."""
    whole = "decimal(38,0)"
    s = F.array(*[F.lit(v).cast("long") for v in sums])
    apart = F.zip_with("x", s, lambda x, t: (x * F.lit(n).cast("long") - t).cast("decimal(19,0)"))
    squares = F.aggregate(apart, F.lit(0).cast(whole), lambda acc, d: (acc + (d * d).cast(whole)).cast(whole))
    return rows.withColumn("deviation", squares)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of all ``rows`` (x array<long>); None without rows.

    The driver gets the sums and the components, both bounded by the dimension; the centred rows
    are multiplied where they lie. All singular values are asked for, so that the decomposition
    of the products is a direct one, to double precision.
    """
    per = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum("x").alias("s")).orderBy("i").collect()
    if not per:
        return None
    n, sums = per[0]["n"], [r["s"] for r in per]
    mean = F.array(*[F.lit(s / n) for s in sums])
    centred = rows.select(array_to_vector(F.zip_with("x", mean, lambda x, m: x.cast("double") - m)).alias("v"))
    dense = MLUtils.convertVectorColumnsFromML(centred, "v")
    found = RowMatrix(dense, n, len(sums)).computeSVD(len(sums), computeU=False)
    variances = np.asarray(found.s.toArray()) ** 2 / n
    axes = np.asarray(found.V.toArray()).T
    kept = [i for i in range(min(components, len(variances))) if variances[i] > LEAST_VARIANCE * variances[0]]
    spread = with_deviation(rows, n, sums).agg(F.sum("deviation").alias("t")).first()["t"]
    total = float(Context(prec=60).divide(Decimal(spread), Decimal(n) ** 3))
    return Whitening(n, sums, axes[kept], variances[kept], total)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w array<double>): the rows' coordinates on the components, of variance 1."""
    mean = np.array([s / model.n for s in model.sums])
    sent = shared(rows.sparkSession, (mean, (model.components / np.sqrt(model.variances)[:, None]).T))
    width = model.components.shape[0]

    def run(batch):
        centre, axes = sent.value
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(centre))
        w = (x - centre) @ axes
        import pyarrow as pa

        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * width), pa.array(w.ravel()))
        yield {"vec_id": batch.column("vec_id"), "deviation": batch.column("deviation"), "w": lists}

    out = checkpoint(map_arrow(with_deviation(rows, model.n, model.sums), run, "vec_id long, deviation decimal(38,0), w array<double>"))
    done(sent)
    return out


def identity_error(white: DataFrame, width: int) -> float:
    """The largest absolute entry of the coordinates' covariance (divisor n, centred) minus the identity."""
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    if not pairs:
        return 0.0
    row = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


WHITENED = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten_embeddings(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: its coordinate, with the fit's figures.

    Components are numbered from 1 by falling variance, at most ``components`` and the dimension.
    Those without variance (LEAST_VARIANCE) are left out, so a table of one vector or of equal
    vectors gives no rows, as does an empty one. Repeated rows count and return as often as they
    occur; a null vec_id stays null; other columns are not read. ``deviation`` is exact.
    """
    rows = whole_vectors(vectors, column)
    model = fit(rows, components)
    if model is None or not len(model.variances):
        return vectors.sparkSession.createDataFrame([], WHITENED)
    white = whiten(rows, model)
    error = identity_error(white, len(model.variances))
    explained = F.array(*[F.lit(float(v / model.total)) for v in model.variances])
    out = white.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(explained, F.col("at")).alias("explained"),
        F.lit(float(error)).alias("identity_error"),
    )
