"""N-gram Jaccard join: documents whose sets of 5-word shingles have a Jaccard of 0.8 or more.

Documents with equal sets are one item, named by a hash of the set. Items are joined by
rare-first prefixes (rarity measured by a counting sketch over all documents) under length,
positional and parity filters; each candidate pair is verified once, by the suffix filter and then
on the whole sets.
Links are joined to components in two rounds: long lists first contribute a star, and then
only pairs of different components, so groups of copies are not expanded into all pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    batches_of_text,
    checkpoint,
    connected_components,
    count_sketch,
    done,
    encoded,
    flag_sketch,
    flagged,
    free_name,
    giving_back,
    mix64,
    shared,
    shingle_sets,
    sketch_bits,
    text_slices,
)
from .setjoin import candidate_pairs, least_overlap, parity, prefix_length

WORDS = 5
PCT = 80
#: Bits of a flag sketch: 16 a value, these at least and at most.
_FLAG_BITS, _MOST_FLAG_BITS = 23, 30
#: How often the suffix filter halves two sets.
_DEPTH = 4
#: Bits of the parity in postings of the first round and of the second, over long lists alone.
_FIRST_BITS, _SECOND_BITS = 64, 512


def _sets(texts, k: int):
    raw = encoded(texts)
    for part in batches_of_text(raw, 1 << 20):
        yield from shingle_sets(raw[part], k)


def suffix_difference(x: np.ndarray, y: np.ndarray, depth: int = _DEPTH) -> int:
    """A lower bound of the symmetric difference of two sorted sets.

    Both are split at the middle token of the longer one; what lies below it in one set can only
    meet what lies below it in the other, and so on for the halves.
    """
    if depth == 0 or not len(x) or not len(y):
        return abs(len(x) - len(y))
    if len(x) < len(y):
        x, y = y, x
    middle = len(x) // 2
    cut = int(np.searchsorted(y, x[middle]))
    return suffix_difference(x[:middle], y[:cut], depth - 1) + suffix_difference(x[middle:], y[cut:], depth - 1)


def _set_parity(tokens: np.ndarray) -> bytes:
    """A parity bitmap of about one bit a token, packed; lengths are powers of two."""
    bits = 64
    while bits < len(tokens):
        bits *= 2
    return parity(tokens, bits).tobytes()


def _fold(bits: np.ndarray, size: int) -> np.ndarray:
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] ^ bits[half:]
    return bits


def within_parity_filter(n_a: int, sig_a: bytes, n_b: int, sig_b: bytes, pct: int = PCT) -> bool:
    """Whether the parity bitmaps leave room for an overlap that reaches pct/100."""
    a, b = np.frombuffer(sig_a, np.uint8), np.frombuffer(sig_b, np.uint8)
    size = min(len(a), len(b))
    differ = int(np.bitwise_count(_fold(a, size) ^ _fold(b, size)).sum())
    return differ <= n_a + n_b - 2 * int(least_overlap(n_a + n_b, pct))


def _item(s: np.ndarray) -> int:
    """A 64-bit hash of a set, as a signed number."""
    with np.errstate(over="ignore"):
        low, high = mix64(s).sum(dtype=np.uint64), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
        return int(mix64(np.array([low * np.uint64(3) + high + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def _describe(docs: DataFrame, counts, k: int, pct: int) -> DataFrame:
    """(doc_id, n, item, sig, wide, big, prefix) of each document; without words item is null."""
    mask = np.uint64(len(counts.value) - 1)
    names = ["doc_id", "n", "item", "sig", "wide", "big", "prefix"]

    def run(batches):
        for batch in (part for whole in batches for part in text_slices(whole)):
            n, item, sig, wide, big, prefix = [], [], [], [], [], []
            for s in _sets(batch.column("text").to_pylist(), k):
                m = len(s)
                n.append(m)
                item.append(_item(s) if m else None)
                sig.append(parity(s, _FIRST_BITS).tobytes())
                wide.append(parity(s, _SECOND_BITS).tobytes())
                big.append(_set_parity(s))
                p = prefix_length(m, pct) if m else 0
                rare = np.lexsort((s, counts.value[(s & mask).astype(np.int64)]))[:p]
                prefix.append(s[rare].tobytes())
            ints = [pa.array(x, pa.int64()) for x in (n, item)]
            blobs = [pa.array(x, pa.binary()) for x in (sig, wide, big, prefix)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *ints, *blobs], names=names)

    return docs.mapInArrow(giving_back(run), "doc_id long, n long, item long, sig binary, wide binary, big binary, prefix binary")


def flags_of(df: DataFrame, *columns: str) -> np.ndarray:
    """Which residues the mixed values of the columns have: a filter sized by the number of rows."""
    bits = (16 * len(columns) * max(df.count(), 1)).bit_length()
    return flag_sketch(df, list(columns), min(_MOST_FLAG_BITS, max(_FLAG_BITS, bits)))


def _sets_of(docs: DataFrame, wanted, k: int) -> DataFrame:
    """(item, set) of the documents whose id, and the sets whose item, pass the flag sketch."""

    def run(batches):
        for batch in batches:
            at = np.flatnonzero(flagged(wanted.value, batch.column("doc_id").to_numpy()))
            texts = batch.column("text").take(pa.array(at))
            for some in range(0, len(at), 256):
                sets = [s for s in _sets(texts.slice(some, 256).to_pylist(), k) if len(s)]
                items = np.array([_item(s) for s in sets], np.int64)
                own = np.flatnonzero(flagged(wanted.value, items)) if len(items) else []
                yield pa.RecordBatch.from_arrays([pa.array(items[own]), pa.array([sets[i].tobytes() for i in own], pa.binary())], names=["item", "set"])

    return docs.mapInArrow(giving_back(run), "item long, set binary").groupBy("item").agg(F.first("set").alias("set"))


def _verify(pairs: DataFrame, docs: DataFrame, items: DataFrame, k: int, pct: int) -> DataFrame:
    """The candidate pairs (a, b) of items that pass the parity and suffix filters and then the exact test."""
    side = lambda c: items.select(*[F.col(x).alias(f"{x}_{c}" if x != "item" else c) for x in ("item", "n", "big", "rep")])

    def by_parity(batches):
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("n_a", "big_a", "n_b", "big_b")]
            ok = [within_parity_filter(*x, pct) for x in zip(*cols, strict=True)]
            out = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column(c) for c in ("a", "b", "rep_a", "rep_b")], names=["a", "b", "rep_a", "rep_b"])

    left = checkpoint(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(giving_back(by_parity), "a long, b long, rep_a long, rep_b long"))
    wanted = shared(docs.sparkSession, flags_of(left, "a", "b", "rep_a", "rep_b"))
    sets = _sets_of(docs, wanted, k)

    def test(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                total = len(x) + len(y)
                if suffix_difference(x, y) > total - 2 * int(least_overlap(total, pct)):
                    ok.append(False)
                    continue
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= pct * (len(both) - common))
            out = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([out.column("a"), out.column("b")], names=["a", "b"])

    with_a = left.select("a", "b").join(sets.select(F.col("item").alias("a"), F.col("set").alias("set_a")), "a")
    with_b = with_a.join(sets.select(F.col("item").alias("b"), F.col("set").alias("set_b")), "b")
    out = checkpoint(with_b.mapInArrow(giving_back(test), "a long, b long"))
    done(wanted)
    return out


def jaccard_components(docs: DataFrame, k: int = WORDS, pct: int = PCT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text).

    A text of fewer than k words has its whole sequence as its one shingle; null texts and
    texts without words have an empty set, link with nothing and are their own component.
    Rows with a null id are returned with their set size and a null component and link with
    nothing. Repeated ids count as one document with any of their texts' links. Shingles are
    compared by 64-bit hashes.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hashes(batch):
        for part in text_slices(batch):
            yield from _sets(part.column("text").to_pylist(), k)

    counts = count_sketch(docs.select("text"), hashes, sketch_bits(docs.count()))
    counts = shared(spark, np.minimum(counts, 2**31 - 1).astype(np.int32))
    described = checkpoint(_describe(docs, counts, k, pct))
    usable = described.where("doc_id is not null and item is not null")
    kept = [F.first(c).alias(c) for c in ("n", "sig", "wide", "big", "prefix")]
    items = checkpoint(usable.groupBy("item").agg(F.min("doc_id").alias("rep"), *kept))
    known = docs.where("doc_id is not null")

    def postings(frame, probe, sig):
        return frame.select("item", "n", F.col(sig).alias("sig"), "prefix", F.col("rep").alias("place"), probe.alias("probe"), *(["label"] if "label" in frame.columns else []))

    # First round: all pairs of short lists, stars of long ones. One candidate of each item, its
    # earliest, is verified before the others: most of a group of copies then hangs together.
    first = checkpoint(candidate_pairs(postings(items, F.lit(False), "sig"), counts, pct))
    pairs = checkpoint(first.where("b is not null").groupBy("a", "b").agg(F.min("place").alias("place")))
    tried = pairs.groupBy("a").agg(F.min_by("b", "place").alias("b"))
    links = _verify(tried, known, items, k, pct)
    part = checkpoint(connected_components(links))

    # Second round: the pairs not yet verified, of long lists too, whose components differ.
    label = part.select(F.col("id").alias("item"), F.col("component").alias("label"))
    largest = part.groupBy("component").count().orderBy(F.desc("count"), "component").limit(1).collect()
    # of two different components one is not the largest, so its items probe
    probe = F.col("label") != F.lit(largest[0]["component"]) if largest else F.lit(True)
    marked = items.join(label, "item", "left").withColumn("label", F.coalesce("label", "item"))
    live = shared(spark, flags_of(first.where("list is not null"), "list"))
    more = candidate_pairs(postings(marked, probe, "wide"), counts, pct, live=live, labelled=True).select("a", "b")
    apart = (
        pairs.join(label.withColumnRenamed("item", "a").withColumnRenamed("label", "la"), "a", "left")
        .join(label.withColumnRenamed("item", "b").withColumnRenamed("label", "lb"), "b", "left")
        .where(F.coalesce("la", "a") != F.coalesce("lb", "b"))
        .select("a", "b")
    )
    # a pair that failed in the first round is not tried again
    more = checkpoint(more.unionByName(apart).distinct().join(tried, ["a", "b"], "left_anti"))
    done(live, counts)
    # the texts of a repeated id are linked as well
    own = usable.select("doc_id", "item").distinct()
    low = own.groupBy("doc_id").agg(F.min("item").alias("low"), F.count("*").alias("times")).where("times > 1")
    same = own.join(low, "doc_id").select(F.col("item").alias("a"), F.col("low").alias("b"))
    links = links.unionByName(same)
    if not more.isEmpty():
        links = links.unionByName(_verify(more, known, items, k, pct))
    part = connected_components(links)
    # a component is named by its least document
    named = items.select("item", "rep").join(part.withColumnRenamed("id", "item"), "item", "left").withColumn("component", F.coalesce("component", "item"))
    least = named.groupBy("component").agg(F.min("rep").alias("c"))
    of_item = named.join(least, "component").select("item", "c")
    of_doc = own.join(of_item, "item").groupBy("doc_id").agg(F.min("c").alias("c"))
    return (
        described.select("doc_id", F.col("n").alias("n_shingles"))
        .join(of_doc, "doc_id", "left")
        .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    )


def keep_one(docs: DataFrame, k: int = WORDS, pct: int = PCT) -> DataFrame:
    """The rows, all columns, of one document of each component: the smallest id.

    Rows of null id stay; rows that repeat a kept id all stay.
    """
    found = jaccard_components(docs.select("doc_id", "text"), k, pct)
    name = free_name(docs, "__gone")
    gone = found.where("doc_id is not null and component_id != doc_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id") == F.col(name), "left_anti")
