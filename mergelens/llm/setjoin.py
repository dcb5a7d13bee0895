"""Candidate pairs of an exact set-similarity join (Jaccard of at least pct/100).

Items are token sets sorted rare-first; two similar sets share a token among their first
n - ceil(pct * n / 100) + 1 tokens, so only those prefixes are joined. Postings travel packed:
each task sorts its postings by bucket and sends arrays, and a bucket's lists are joined in
numpy under the length filter, the positional filter and a parity filter (each token flips one
of some bits, so the bits in which two sets differ bound their symmetric difference from below).

Lists of at most ``small`` postings yield all their candidate pairs. A longer list first yields
one star for each length class, against its first item; once those pairs are verified, a second
round compares only the items that still matter (``probe``) with the rest of the list. Lists
that can exceed ``HOT`` postings are dealt into parts: every item stays in one part and only
probes visit the others, so no group grows with a hot token and no pair is lost.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flagged, giving_back, giving_back_group, mix64, shuffle_width

HOT = 200_000
#: Postings that a task's group holds on average at most.
GROUP = 1 << 20
_CLASS_STEP = 1.25

PAIRS = "a long, b long, place long, list long"


def prefix_length(n, pct: int):
    return n - (pct * n + 99) // 100 + 1


def least_overlap(total, pct: int):
    """Smallest overlap of two sets of ``total`` tokens together that reaches pct/100."""
    return -((-pct * total) // (100 + pct))


def parity(tokens: np.ndarray, bits: int = 64) -> np.ndarray:
    """A bit for each residue of the mixed tokens: whether an odd number of tokens has it."""
    counts = np.bincount((mix64(tokens) & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in as few bytes as hold them all, others as they are."""
    return x if x.min(initial=0) < 0 else x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _widen(blobs: list[bytes], sizes: list[int], kind=np.int32) -> np.ndarray:
    """Eight bytes are signed numbers."""
    parts = [np.frombuffer(b, "i8" if len(b) == 8 * n else f"u{len(b) // n}").astype(kind) for b, n in zip(blobs, sizes, strict=True) if n]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def list_parts(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Into how many parts the tokens' lists are dealt."""
    return (1 + counts[(h & np.uint64(len(counts) - 1)).astype(np.int64)] // HOT).astype(np.uint64)


def still_open(h: np.ndarray, counts: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Tokens whose lists the first round did not finish: long ones, and those in parts."""
    return flagged(live, h) | (list_parts(h, counts) > 1)


def _postings(columns: list[str], counts, live, buckets: int):
    """Of record batches (item, n, prefix, ..., probe): packed postings by bucket."""
    kinds = {"n": np.int32}

    def run(batches):
        for batch in batches:
            prefix = batch.column("prefix")
            sizes = pc.binary_length(prefix).to_numpy(zero_copy_only=False) // 8
            h = np.frombuffer(b"".join(prefix.to_pylist()), np.uint64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            pos = (np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            cols = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(kinds.get(c, np.int64)) for c in columns if c != "sig"}
            cols["sig"] = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint64).reshape(len(sizes), -1)
            probe = batch.column("probe").to_numpy(zero_copy_only=False).astype(bool)
            parts = list_parts(h, counts.value)
            if live is not None:
                keep = still_open(h, counts.value, live.value)
                h, row, pos, parts = h[keep], row[keep], pos[keep], parts[keep]
            salt = mix64(cols["item"].view(np.uint64))[row] % parts
            role = probe[row].astype(np.int8)
            if live is not None and (parts > 1).any():
                # probes of a list in parts also visit the other parts, as probes only
                hot = np.flatnonzero((parts > 1) & probe[row])
                times = parts[hot].astype(np.int64) - 1
                more = np.repeat(hot, times)
                step = (np.arange(len(more)) - np.repeat(np.cumsum(times) - times, times) + 1).astype(np.uint64)
                h, row, pos = np.concatenate([h, h[more]]), np.concatenate([row, row[more]]), np.concatenate([pos, pos[more]])
                salt = np.concatenate([salt, (salt[more] + step) % parts[more]])
                role = np.concatenate([role, np.full(len(more), 2, np.int8)])
            with np.errstate(over="ignore"):
                key = np.where(salt > 0, mix64(h + salt * np.uint64(0x9E3779B97F4A7C15)), h)
            bucket = (mix64(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            key, row, pos, role = key[order], row[order], pos[order], role[order]
            packed = [key, _narrow(pos), role, *[_narrow(cols[c])[row] if c in ("n", "place") else cols[c][row] for c in columns]]
            some = np.flatnonzero(np.diff(cuts))
            if not len(some):
                continue
            blobs = [pa.array([x[cuts[b] : cuts[b + 1]].tobytes() for b in some], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *blobs], names=["bucket", "key", "pos", "role", *columns])

    return run


def candidate_pairs(
    items: DataFrame, counts, pct: int = 80, small: int = 6, live=None, labelled: bool = False
) -> DataFrame:
    """(a, b, place, list): candidate pairs with b earlier than a, and b's place; with null b, the long lists.

    ``items`` has (item, n, prefix, sig, place, probe[, label]) without nulls, each item once.
    Earlier is the smaller (place, item). The ``sig`` is the packed parity, of as many bits for
    all. ``counts`` is the broadcast counting sketch of the tokens. With ``live`` (a broadcast
    flag sketch of lists) it is the second round: only pairs of a probe, with different labels
    if ``labelled``.
    """
    spark = items.sparkSession
    posted = items.agg(F.sum(F.octet_length("prefix"))).first()[0] or 0
    buckets = max(4 * shuffle_width(spark), -(-posted // (8 * GROUP)))
    columns = ["item", "n", "sig", "place", *(["label"] if labelled else [])]
    blobs = items.select(*columns, "prefix", "probe").mapInArrow(
        giving_back(_postings(columns, counts, live, buckets)), "bucket long, " + ", ".join(f"{c} binary" for c in ("key", "pos", "role", *columns))
    )
    second = live is not None

    def join(table: pa.Table) -> pa.Table:
        kinds = {"key": np.uint64, "role": np.int8, "sig": np.uint64}

        counted = [len(r) for r in table["role"].to_pylist()]

        def column(c):
            blobs = table[c].to_pylist()
            return _widen(blobs, counted, np.int64 if c == "place" else np.int32) if c in ("pos", "n", "place") else np.frombuffer(b"".join(blobs), kinds.get(c, np.int64))

        x = {c: column(c) for c in ("key", "pos", "role", *columns)}
        x["sig"] = x["sig"].reshape(len(x["key"]), -1)
        # an item's rank by (place, item); one in several lists has one
        order = np.lexsort((x["item"], x["place"]))
        x["rank"] = np.empty(len(order), np.int64)
        x["rank"][order] = np.cumsum(np.concatenate(([True], x["item"][order[1:]] != x["item"][order[:-1]])))[: len(order)]
        order = np.lexsort((x["rank"], x["n"], x["key"]))
        x = {c: v[order] for c, v in x.items()}
        key, n, rank = x["key"], x["n"].astype(np.int64), x["rank"]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.concatenate((start, [len(key)])))
        size_of, last = np.repeat(size, size), np.repeat(start + size, size)
        found: list[tuple[np.ndarray, ...]] = []

        def take(i: np.ndarray, j: np.ndarray) -> None:
            """Keep what passes the filters; i and j are positions in the same list."""
            need = least_overlap(n[i] + n[j], pct)
            p, q = x["pos"][i].astype(np.int64), x["pos"][j].astype(np.int64)
            ok = 100 * np.minimum(n[i], n[j]) >= pct * np.maximum(n[i], n[j])
            ok &= np.minimum(p, q) + 1 + np.minimum(n[i] - p - 1, n[j] - q - 1) >= need
            ok &= rank[i] != rank[j]
            i, j, need = i[ok], j[ok], need[ok]
            differ = np.bitwise_count(x["sig"][i] ^ x["sig"][j]).sum(axis=1, dtype=np.int64)
            ok = differ <= n[i] + n[j] - 2 * need
            if second:
                if labelled:
                    ok &= x["label"][i] != x["label"][j]
                ri, rj = x["role"][i], x["role"][j]
                ok &= (ri < 2) | (rj < 2)
                ok &= (ri > 0) | (rj > 0)
            i, j = i[ok], j[ok]
            a, b = np.where(rank[i] > rank[j], i, j), np.where(rank[i] > rank[j], j, i)
            found.append((x["item"][a], x["item"][b], x["place"][b]))

        def by_offset(i: np.ndarray) -> None:
            """Each position with those after it while the list and the length filter last."""
            d = 1
            while len(i):
                i = i[i + d < last[i]]
                i = i[pct * n[i + d] <= 100 * n[i]]
                take(i, i + d)
                d += 1

        if second:
            # lists with something left to compare: a probe, and more than one label
            open_lists = (size > 1) & (np.maximum.reduceat(x["role"], start) > 0)
            if labelled:
                open_lists &= np.minimum.reduceat(x["label"], start) != np.maximum.reduceat(x["label"], start)
            by_offset(np.flatnonzero(np.repeat(open_lists, size) & (size_of <= 512)))
            huge = open_lists & (size > 512)
            for s, m in zip(start[huge], size[huge], strict=True):
                # one probe at a time against its length window
                own = n[s : s + m]
                for i in np.flatnonzero(x["role"][s : s + m] > 0).tolist():
                    lo, hi = np.searchsorted(own, [-((-pct * own[i]) // 100), 100 * own[i] // pct + 1])
                    j = np.arange(lo, hi)
                    j = j[j != i]
                    take(np.full(len(j), s + i), s + j)
        else:
            by_offset(np.flatnonzero((size_of > 1) & (size_of <= small)))
            long = size_of > small
            if long.any():
                at = np.flatnonzero(long)
                step = np.floor(np.log(n[at]) / math.log(_CLASS_STEP)).astype(np.int64)
                cut = np.flatnonzero(np.concatenate(([True], (key[at][1:] != key[at][:-1]) | (step[1:] != step[:-1]))))
                width = np.diff(np.concatenate((cut, [len(at)])))
                # the first item of each length class, by rank
                first = at[np.lexsort((rank[at], np.repeat(np.arange(len(cut)), width)))[cut]]
                take(at, np.repeat(first, width))
        a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        b = np.concatenate([f[1] for f in found]) if found else np.empty(0, np.int64)
        place = np.concatenate([f[2] for f in found]) if found else np.empty(0, np.int64)
        if len(a):
            order = np.lexsort((b, a))
            a, b, place = a[order], b[order], place[order]
            cut = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b, place = a[cut], b[cut], place[cut]
        lists = np.empty(0, np.int64) if second else key[start[size > small]].view(np.int64)
        none = lambda m: pa.nulls(m, pa.int64())
        return pa.table(
            {
                "a": pa.concat_arrays([pa.array(a), none(len(lists))]),
                "b": pa.concat_arrays([pa.array(b), none(len(lists))]),
                "place": pa.concat_arrays([pa.array(place), none(len(lists))]),
                "list": pa.concat_arrays([none(len(a)), pa.array(lists)]),
            }
        )

    return blobs.groupBy("bucket").applyInArrow(giving_back_group(join), PAIRS)
