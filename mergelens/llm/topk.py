"""Exact top-k inner products by distributed histogram selection.

Vectors are packed into blocks of similar norm. Query blocks and candidate blocks are dealt to
slices, and each pair of slices is one cell of a grid, a bounded group of a co-grouped shuffle.
Scores are integers. In each round all scores are computed and counted into a histogram of each
query's current score range; the bin that holds the k-th largest score becomes the next range,
until it is one score wide. A last pass keeps the scores at or above it and breaks ties by the
smaller id.

A cell reports only scores not below its own k-th in the range: the global k-th score is never
lower, so the counts that place it are complete. For the same reason a cell visits its blocks by
falling norm and leaves out those whose norm, times the query's, cannot reach that score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, shuffle_width, slices

BLOCK = 4096
#: Numbers in a block at most, so that long vectors give blocks of fewer rows.
BLOCK_NUMBERS = 1 << 19
BINS = 1024
#: Blocks of a slice of queries and of candidates, on average: a cell holds these at once.
Q_BLOCKS, C_BLOCKS = 8, 16
#: Distinct dimensions up to which their table, 24 bytes a row, is broadcast.
BROADCAST_DIMS = 100_000
#: Queries scored at once against a block.
_ROWS = 256
#: Products and sums of integers below these are exact in floats and doubles.
_EXACT_FLOAT, _EXACT = 2.0**24, 2.0**53
#: Above every score.
_NO_HIGH = 1 << 62

_BLOCKS = "block long, dim long, vec_id binary, data binary, kind string, most double"
_CELL = ["dim", "q_slice", "c_slice"]


def usable_vectors(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v array<double>): floor(scale * x), without rows that hold null or non-finite."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale).cast("double")).alias("v")
    )


def _norms(v: np.ndarray) -> np.ndarray:
    return np.sqrt((v.astype(float) ** 2).sum(axis=1))


def _narrow(v: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them."""
    most = np.abs(v).max(initial=0)
    return v.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8")


def _pack(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of at most ``size`` vectors of one dimension and similar norms, without a shuffle."""

    def run(batches):
        number = 0
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            lists = batch.column("v")
            flat, cuts = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            dims = np.diff(cuts)
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                for part in slices(len(own), max(1, min(size, BLOCK_NUMBERS // max(dim, 1)))):
                    some = own[part]
                    v = np.concatenate([flat[cuts[i] : cuts[i + 1]] for i in some]).reshape(len(some), dim)
                    packed = _narrow(v)
                    row = {"block": number, "dim": int(dim), "vec_id": ids[some].tobytes(), "data": packed.tobytes(), "kind": packed.dtype.str, "most": float(_norms(v).max())}
                    yield pa.RecordBatch.from_pylist([row])
                    number += 1

    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    packed = rows.sortWithinPartitions(F.size("v"), norm).mapInArrow(run, _BLOCKS)
    # a block's number within its partition made unique over partitions
    return packed.withColumn("block", F.spark_partition_id().cast("long") * (1 << 32) + F.col("block"))


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["vec_id"], np.int64)
    return ids, np.frombuffer(row["data"], row["kind"]).reshape(len(ids), row["dim"])


def _kind_of_scores(queries: list[np.ndarray], candidates: list[np.ndarray], dim: int) -> type:
    """The fastest type in which all inner products of these vectors are exact."""
    largest = [max((float(np.abs(v.astype(float)).max(initial=0)) for v in side), default=0.0) for side in (queries, candidates)]
    reach = largest[0] * largest[1] * max(dim, 1)
    return np.float32 if reach < _EXACT_FLOAT else np.float64 if reach < _EXACT else np.int64


def _scores(q: np.ndarray, v: np.ndarray, kind: type) -> np.ndarray:
    """Inner products; through Python integers where doubles could round."""
    if kind is not np.int64:
        return q @ v.T
    whole = np.frompyfunc(int, 1, 1)
    return (whole(q) @ whole(v).T).astype(np.int64) if q.shape[1] else np.zeros((len(q), len(v)), np.int64)


def _best(s: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, in no order."""
    return s if s.shape[1] <= k else np.partition(s, s.shape[1] - k, axis=1)[:, -k:]


def _cell(cands: pa.Table, asked: pa.Table, k: int):
    """For each query block its queries' states and an iterator of (query's index, candidate's id, score).

    Left out are a query's own id, scores outside its range, and some below the k-th of the cell.
    """
    blocks = sorted(((*_opened(r), r["most"]) for r in cands.to_pylist()), key=lambda b: -b[2])
    states = asked.column("state").combine_chunks()
    opened = [_opened(r) for r in asked.select(["vec_id", "data", "kind", "dim"]).to_pylist()]
    dim = asked.column("dim")[0].as_py()
    kind = _kind_of_scores([q for _, q in opened], [v for _, v, _ in blocks], dim)
    none = -np.inf if kind is not np.int64 else np.iinfo(np.int64).min
    if kind is not np.int64:
        blocks = [(vi, v.astype(kind), most) for vi, v, most in blocks]
    bound = {np.float32: int(_EXACT_FLOAT), np.float64: int(_EXACT), np.int64: _NO_HIGH}[kind]
    for number, (qi, q) in enumerate(opened):
        fields = states[number].values
        state = {name: fields.field(name).to_numpy() for name in ("query_id", "low", "high", "width")}
        order = np.argsort(qi)
        at = order[np.searchsorted(qi[order], state["query_id"])]
        # scores lie inside the bound, so limits beyond it may be moved to it
        low, high = (np.clip(state[name], -bound, bound).astype(kind) for name in ("low", "high"))
        yield state, _visits(q[at], state["query_id"], low, high, blocks, kind, none, k)


def _visits(q, ids, low, high, blocks, kind, none, k):
    norm = _norms(q)
    q = q if kind is np.int64 else q.astype(kind)
    for part in slices(len(ids), _ROWS):
        run = np.full((len(ids[part]), k), none, kind)
        for vi, v, most in blocks:
            least = np.maximum(low[part], run.min(axis=1))
            near = np.flatnonzero(norm[part] * most * 1.0000001 + 1 >= least)
            if not len(near):
                break  # the other blocks' norms are no larger
            at = near + part.start
            s = _scores(q[at], v, kind)
            fine = (s >= low[at, None]) & (s < high[at, None])
            own = np.flatnonzero(np.isin(vi, ids[at]))
            fine[:, own] &= ids[at, None] != vi[own]
            s[~fine] = none
            run[near] = _best(np.concatenate([run[near], _best(s, k)], axis=1), k)
            rows, columns = np.nonzero(s >= np.maximum(run[near].min(axis=1), low[at])[:, None])
            yield at[rows], vi[columns], s[rows, columns].astype(np.int64)


def _table(columns: list[tuple[str, list[np.ndarray]]]) -> pa.Table:
    return pa.table({name: pa.array(np.concatenate([np.empty(0, np.int64), *parts]), pa.int64()) for name, parts in columns})


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, bins: int = BINS) -> DataFrame:
    """The k best candidates of each query: (query_id, rank, vec_id, score).

    Both inputs are (vec_id, v) of whole numbers. A query's own id is no candidate. Vectors of
    different lengths are not compared. Fewer candidates than k: all are returned; none: no
    rows. Repeated rows of a candidate count separately and tie; a query's id that repeats asks
    once, with the smallest of its vectors. Products of norms from 2**61 on raise an error.
    """
    cands = checkpoint(_pack(vectors, block))
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = checkpoint(_pack(once, max(1, block // 4)).withColumnRenamed("block", "q_block"))
    ranges = _first_ranges(asked, cands, k, bins)
    dealt, deal_asked = _grid(cands, asked)

    def visit(state: DataFrame, fn, schema: str) -> DataFrame:
        packed = state.groupBy("q_block").agg(F.sort_array(F.collect_list(F.struct("query_id", "low", "high", "width"))).alias("state"))
        queries = deal_asked(asked.join(packed, "q_block"))
        return dealt.groupBy(*_CELL).cogroup(queries.groupBy(*_CELL)).applyInArrow(fn, schema)

    def count(cands: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if cands.num_rows and asked.num_rows:
            for state, visits in _cell(cands, asked, k):
                keys, ns = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for rows, _, s in visits:
                    key, n = np.unique(rows * bins + (s - state["low"][rows]) // state["width"][rows], return_counts=True)
                    keys.append(key), ns.append(n)
                key, of = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.zeros(len(key), np.int64)
                np.add.at(n, of, np.concatenate(ns))
                out[0].append(state["query_id"][key // bins]), out[1].append(key % bins), out[2].append(n)
        return _table(list(zip(("query_id", "bin", "n"), out, strict=True)))

    def keep(cands: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if cands.num_rows and asked.num_rows:
            for state, visits in _cell(cands, asked, k):
                kept = [np.empty(0, np.int64)] * 3
                for found in visits:
                    # no more than k of a cell's can be among the k best: highest, then smallest ids
                    rows, vec, s = (np.concatenate(pair) for pair in zip(kept, found, strict=True))
                    order = np.lexsort((vec, -s, rows))
                    rows = rows[order]
                    order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < k]
                    kept = [np.concatenate(pair)[order] for pair in zip(kept, found, strict=True)]
                out[0].append(state["query_id"][kept[0]]), out[1].append(kept[1]), out[2].append(kept[2])
        return _table(list(zip(("query_id", "vec_id", "score"), out, strict=True)))

    while True:
        widest = ranges.agg(F.max("width")).first()[0]
        if widest is None or widest == 0:
            break
        live = ranges.where("width > 0")
        counts = visit(live, count, "query_id long, bin long, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = W.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(W.unboundedPreceding, 0)
        reached = counts.withColumn("upto", F.sum("n").over(down)).join(live, "query_id")
        total = W.partitionBy("query_id")
        # fewer scores than needed: all of them are wanted, from the lowest bin on
        hit = (
            reached.withColumn("all", F.max("upto").over(total))
            .where((F.col("upto") >= F.least("need", "all")) & (F.col("upto") - F.col("n") < F.least("need", "all")))
            .select(
                "q_block",
                "query_id",
                (F.col("low") + F.col("bin") * F.col("width")).alias("low"),
                F.least("high", F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("high"),
                F.when(F.col("width") == 1, F.lit(0)).otherwise(F.ceil(F.col("width") / F.lit(bins))).cast("long").alias("width"),
                (F.col("need") - (F.col("upto") - F.col("n"))).alias("need"),
            )
        )
        ranges = checkpoint(hit.unionByName(ranges.where("width = 0")))

    kept = visit(ranges.withColumn("high", F.lit(_NO_HIGH)), keep, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return kept.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _grid(cands: DataFrame, asked: DataFrame):
    """The candidate blocks with the cells they visit, and what gives query blocks theirs.

    A block belongs to one slice, by a hash of its number, and visits every slice of the other
    side. Slices are counted from the blocks of each dimension; a table of few blocks is dealt
    to more candidate slices, so that there are cells for all tasks.
    """
    width = shuffle_width(cands.sparkSession)
    sizes = asked.groupBy("dim").agg(F.count("*").alias("n_q")).join(cands.groupBy("dim").agg(F.count("*").alias("n_c")), "dim")
    sizes = sizes.withColumn("q_slices", F.ceil(F.col("n_q") / Q_BLOCKS))
    more = F.least("n_c", F.ceil(F.lit(width) / F.col("q_slices")))
    sizes = sizes.withColumn("c_slices", F.greatest(F.ceil(F.col("n_c") / C_BLOCKS), more))
    sizes = checkpoint(sizes.select("dim", "q_slices", "c_slices"))
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_DIMS else sizes

    def deal(blocks: DataFrame, number: str, own: str, other: str) -> DataFrame:
        visited = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_slices") - 1))
        slice_of = F.pmod(F.xxhash64(number), F.col(f"{own}_slices"))
        dealt = blocks.join(sizes, "dim").withColumn(f"{own}_slice", slice_of).withColumn(f"{other}_slice", visited)
        return dealt.drop("q_slices", "c_slices").repartition(width, *_CELL)

    return deal(cands, "block", "c", "q"), lambda blocks: deal(blocks, "q_block", "q", "c")


def _first_ranges(asked: DataFrame, cands: DataFrame, k: int, bins: int) -> DataFrame:
    """Each query's widest possible range, [low, high): its norm times the candidates' largest norm."""

    def norms(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, q = _opened(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q_block"]] * len(ids)), pa.array([row["dim"]] * len(ids)), pa.array(ids), pa.array(_norms(q))],
                    names=["q_block", "dim", "query_id", "norm"],
                )

    most = cands.groupBy("dim").agg(F.max("most").alias("most"))
    reach = F.ceil(F.col("norm") * F.col("most") * 1.0000001 + 1).cast("long")
    asked_norms = asked.mapInArrow(norms, "q_block long, dim long, query_id long, norm double")
    return checkpoint(
        asked_norms.join(most, "dim").select(
            "q_block", "query_id", (-reach).alias("low"), (reach + 1).alias("high"), F.ceil((2 * reach + 1) / F.lit(bins)).cast("long").alias("width"), F.lit(k).cast("long").alias("need")
        )
    )
