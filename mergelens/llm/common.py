"""Shared pieces: table access, word hashing in numpy, connected components."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Rows above which a table counts as too large to broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """The maximal runs of characters other than space and \\t-\\r; null text gives no words."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def id_remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's shared checkpoint folder; set one only where none is set, on a single machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or "/tmp/mergelens-checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the name with underscores before it that no column of ``df`` has (case does not tell names apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared(spark: SparkSession, value):
    """A broadcast; ``done`` takes it back once all that reads it is checkpointed."""
    return spark.sparkContext.broadcast(value)


def done(*sent) -> None:
    """Destroy broadcasts, on the driver and the executors, that no later job can need."""
    for b in sent:
        b.destroy()


def give_back() -> None:
    """Free memory of a Python worker goes back to the system: workers wait for other tasks, and several run beside one JVM."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def giving_back(run):
    """``run(batches)``, and free memory is given back at its end."""

    def mapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return mapped


def giving_back_group(run):
    """The same for ``run(table)`` of a group."""

    def applied(rows):
        out = run(rows)
        give_back()
        return out

    return applied


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``fn(record batch)`` yields dicts of columns; nulls in integer columns stay nulls."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            for out in fn(batch):
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, k.type) for k in kinds for c in (out[k.name],)],
                    names=kinds.names,
                )

    return df.mapInArrow(giving_back(run), schema)


# --- word hashing -------------------------------------------------------------------------

#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLOCK = 1 << 17  # what it takes fits in a core's cache
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    got = _powers.get(base)
    if got is None or len(got) < n:
        out = np.empty(max(n, _BLOCK + 1), np.uint64)
        out[0] = 1
        out[1:] = base
        with np.errstate(over="ignore"):
            np.cumprod(out, out=out)
        _powers[base] = got = out
    return got


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64, so that every bit depends on all bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _hash_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(block, np.uint8)
    n = len(raw)
    space = np.empty(n + 2, bool)
    space[0] = space[-1] = True
    np.less(raw - np.uint8(9), 5, out=space[1:-1])
    space[1:-1] |= raw == 32
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    with np.errstate(over="ignore"):
        acc = np.empty(n + 1, np.uint64)
        acc[0] = 0
        worth = raw.astype(np.uint64)
        worth += np.uint64(1)
        worth *= _power_table(_BASE, n)[:n]
        np.cumsum(worth, out=acc[1:])
        h = (acc[ends] - acc[starts]) * _power_table(_INVERSE, n)[starts]
        h = h * np.uint64(0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)
    return mix64(h), starts, ends


#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _token_block(block: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _hash_block, with other hashes and less work: a word is read eight bytes at a time."""
    n = len(block)
    raw = np.frombuffer(block + bytes(8), np.uint8)
    space = np.empty(n + 2, bool)
    space[0] = space[-1] = True
    np.less(raw[:n] - np.uint8(9), 5, out=space[1:-1])
    space[1:-1] |= raw[:n] == 32
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts, ends
    size = ends - starts
    eight = np.ndarray(n + 1, "<u8", raw.data, strides=(1,))  # the eight bytes from each position on
    with np.errstate(over="ignore"):
        h = mix64(eight[starts] & _FIRST_BYTES[np.minimum(size, 8)])
        long = np.flatnonzero(size > 8)
        if len(long):
            more = (size[long] - 1) >> 3
            cut = np.cumsum(more) - more
            step = np.arange(int(more.sum())) - np.repeat(cut, more) + 1
            left = np.repeat(size[long], more) - 8 * step
            rest = eight[np.repeat(starts[long], more) + 8 * step] & _FIRST_BYTES[np.minimum(left, 8)]
            h[long] += np.add.reduceat(mix64(rest + step.astype(np.uint64) * np.uint64(_BASE)), cut)
        return mix64(h + size.astype(np.uint64)), starts, ends


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """As word_hashes with ``lower``, for sets that are only compared: other hashes in less time.

    Models that are trained on hashes keep those of word_hashes.
    """
    return word_hashes(texts, block_hashes=_token_block, size=1 << 18)


def word_hashes(texts: list[bytes], lower: bool = True, block_hashes=_hash_block, size: int = _BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """64-bit hashes of the words of all texts, ASCII-lower-cased if ``lower``, in order.

    Returns (hashes, first word of each text plus an end mark, word starts, word ends, buffer);
    starts and ends are byte positions in the buffer. Work is done in blocks of about ``size``
    bytes cut at white space, so memory stays a small multiple of the input.
    """
    buf = b"\n".join(texts)
    buf = buf.lower() if lower else buf
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(buf):
        to = min(at + size, len(buf))
        if to < len(buf):
            cut = max(buf.rfind(c, at, to) for c in (b" ", b"\n"))
            if cut > at:
                to = cut + 1
            else:
                ahead = [p for p in (buf.find(b" ", to), buf.find(b"\n", to)) if p >= 0]
                to = min(ahead) + 1 if ahead else len(buf)
        h, s, e = block_hashes(buf[at:to])
        hashes.append(h)
        starts.append(s + at)
        ends.append(e + at)
        at = to
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    s = np.concatenate(starts) if starts else np.empty(0, np.int64)
    e = np.concatenate(ends) if ends else np.empty(0, np.int64)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.concatenate(([0], np.searchsorted(s, np.cumsum(lengths))))
    return h, first, s, e, buf


def shingle_sets(texts: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles.

    A text of fewer than k words has its whole sequence as its one shingle; a text without
    words has none.
    """
    h, first, *_ = token_hashes(texts)
    out = []
    n = len(h)
    with np.errstate(over="ignore"):
        mult = [np.uint64((_BASE * (2 * i + 1) ** 3) & (2**64 - 1) | 1) for i in range(k)]
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for i in range(k):
            if n >= k:
                rolled += h[i : n - k + 1 + i] * mult[i]
        rolled = mix64(rolled)
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                own = sum((h[a + i] * mult[i] for i in range(b - a)), np.uint64(int(b - a)))
                out.append(mix64(np.array([own], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def encoded(texts: Iterable[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def slices(n: int, size: int) -> Iterator[slice]:
    for at in range(0, n, size):
        yield slice(at, min(at + size, n))


def batches_of_text(texts: list[bytes], limit: int = 4 << 20) -> Iterator[slice]:
    """Slices of consecutive texts of about ``limit`` bytes (one text at least)."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > limit:
            yield slice(at, i)
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield slice(at, len(texts))


# --- counting sketch ----------------------------------------------------------------------

_CHUNK_BITS = 14


def _sparse(part: np.ndarray) -> bytes:
    """Counters as places and values if that is shorter: a task sees few of a corpus's words."""
    at = np.flatnonzero(part)
    values = part[at].astype(np.uint32 if part.max() < 1 << 32 else np.int64)
    if len(at) * (2 + values.itemsize) < len(part) * values.itemsize:
        return b"s%d " % len(at) + at.astype(np.uint16).tobytes() + values.tobytes()
    return b"d " + part.astype(values.dtype).tobytes()


def _add_to(total: np.ndarray, blob: bytes) -> None:
    head, _, rest = blob.partition(b" ")
    if head == b"d":
        total += np.frombuffer(rest, np.uint32 if len(rest) == 4 * len(total) else np.int64)
    else:
        n = int(head[1:])
        total[np.frombuffer(rest, np.uint16, n)] += np.frombuffer(rest[2 * n :], np.uint32 if len(rest) == 6 * n else np.int64)


def count_sketch(df: DataFrame, hashes_of, bits: int) -> np.ndarray:
    """Counts of all hashes over every row of ``df``, modulo 2**bits counters (int64).

    ``hashes_of(record batch)`` yields uint64 arrays. Each task sends its counters by ranges of
    2**14, packed, which are added up in two levels of 256 tasks and more; the driver gets
    8 * 2**bits bytes at most whatever the size of the input. A counter is an upper bound of each
    of its hashes' counts, so sorting by it puts frequent hashes last.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    size, span = 1 << bits, 1 << min(_CHUNK_BITS, bits)

    def tally(batches):
        total, one = np.zeros(size, np.uint32), np.uint32(1)
        for batch in batches:
            for h in hashes_of(batch):
                np.add.at(total, (h & np.uint64(size - 1)).astype(np.int64), one)
        level = TaskContext.get().partitionId() // 256
        for i in range(size // span):
            part = total[i * span : (i + 1) * span]
            if part.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([level], pa.int32()), pa.array([_sparse(part)], pa.binary())],
                    names=["chunk", "level", "packed"],
                )

    def merge(rows):
        total = np.zeros(span, np.int64)
        for blob in rows["packed"]:
            _add_to(total, blob.as_py())
        return pa.table({"chunk": rows["chunk"][:1], "packed": pa.array([_sparse(total)], pa.binary())})

    parts = df.mapInArrow(giving_back(tally), "chunk int, level int, packed binary")
    parts = parts.groupBy("chunk", "level").applyInArrow(merge, "chunk int, packed binary")
    out = np.zeros(size, np.int64)
    for r in parts.groupBy("chunk").applyInArrow(merge, "chunk int, packed binary").collect():
        _add_to(out[r["chunk"] * span : (r["chunk"] + 1) * span], bytes(r["packed"]))
    return out


# --- flags --------------------------------------------------------------------------------

#: Bits of one row of Spark's bitmap functions.
_BITMAP = 32768


def flag_sketch(df: DataFrame, columns: list[str], bits: int) -> np.ndarray:
    """Which residues the whole numbers in the columns have, as 2**bits packed bits; nulls have none.

    Built by Spark's bitmap aggregate; the driver gets 2**bits / 8 bytes.
    """
    flat = df.select(F.col(columns[0]).cast("long").alias("x"))
    for c in columns[1:]:
        flat = flat.union(df.select(F.col(c).cast("long")))
    flat = flat.where("x is not null")
    x = F.col("x")
    for shift in (bits, 2 * bits):
        if shift < 64:
            x = x.bitwiseXOR(F.shiftrightunsigned("x", shift))
    flat = flat.select((x.bitwiseAND(F.lit((1 << bits) - 1)) + 1).alias("r"))
    maps = flat.groupBy(F.bitmap_bucket_number("r").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("r")).alias("bits"))
    out = np.zeros(max((1 << bits) // 8, _BITMAP // 8), np.uint8)
    for r in maps.collect():
        out[(r["k"] - 1) * _BITMAP // 8 : r["k"] * _BITMAP // 8] = np.frombuffer(r["bits"], np.uint8)
    return out[: (1 << bits) // 8]


def flagged(flags: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whether the flags hold each number's residue: true for all that went in, and for few others."""
    bits = (8 * len(flags)).bit_length() - 1
    x = x.view(np.uint64)
    at = x.copy()
    for shift in (bits, 2 * bits):
        if shift < 64:
            at ^= x >> np.uint64(shift)
    at &= np.uint64((1 << bits) - 1)
    return ((flags[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def text_slices(batch, rows: int = 512):
    """Consecutive slices of a record batch, so that few texts are held as objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def sketch_bits(rows: int, least: int = 16, most: int = 22) -> int:
    """Counters for a corpus of ``rows`` documents: about 8 a document, 2**22 (32 MB) at most."""
    return min(most, max(least, math.ceil(math.log2(max(rows, 1) * 8))))


# --- connected components -----------------------------------------------------------------


#: Edges that one task joins: 16 MB of them.
LOCAL_EDGES = 1 << 20


def _union_find(batches):
    """(u, v) for each node of a partition's edges but the smallest of its component there, v."""
    import pyarrow as pa

    ends = [np.stack([b.column("u").to_numpy(), b.column("v").to_numpy()], axis=1) for b in batches]
    if not ends:
        return
    nodes, at = np.unique(np.concatenate(ends), return_inverse=True)
    at = at.reshape(-1, 2)
    root = np.arange(len(nodes))
    while True:
        # hook the larger root to the smaller of every edge, then shorten all paths
        a, b = root[at[:, 0]], root[at[:, 1]]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[root[moved]])], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id in ``edges`` that differ; component is the smallest id reachable.

    Each partition joins its own edges by union-find, at most LOCAL_EDGES in a task; where those
    of all fit in one task, that is the result. Else rounds of large-star and small-star follow
    until no edge changes, each checkpointed: every step is a grouped minimum and an equi-join
    against a table with one row an id, so hubs are pre-aggregated and skewed joins can be split.
    """
    cur = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where(F.col("u") != F.col("v"))
    cur = checkpoint(cur.distinct())
    n = cur.count()
    if n:
        cur = checkpoint(cur.repartition(max(1, -(-n // max(1, LOCAL_EDGES)))).mapInArrow(_union_find, "u long, v long"))
    if n <= LOCAL_EDGES:
        return _labelled(cur)
    state = cur.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
    while True:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("low", "u").alias("m"))
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = (
            small.where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        cur = checkpoint(nxt)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("long")).alias("s")).first()
        if now == state:
            break
        state = now
    return _labelled(cur)


def _labelled(stars: DataFrame) -> DataFrame:
    roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


ASCII_SPACE = re.compile(r"[\x20\x09-\x0D]+")
