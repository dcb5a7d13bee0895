"""Line dedup: exact set-similarity join of lines, removing later matches.

A line's tokens are its distinct ASCII-lower-cased words, ordered by their rarity in the whole
corpus. A line goes if an earlier line (by doc_id, then line number), kept or not, has a Jaccard
of at least 0.8 with it. Lines of equal sets form one item, placed at its first occurrence.

Items are joined by rare-first prefixes under length, positional and parity filters, and
verified on whole sets. Where the first token that two items share is rare, it is the key under
which they meet. Else all that they share is at least as frequent, so they meet under their
first two, three or four shared tokens, which lie in a prefix longer by as many; the number
depends on that first token's count, so that a key's list stays short as the corpus grows.

An item that has an earlier match needs no further comparison: its likeliest candidate is
verified first, then the others of items that it leaves open. A list gives an item a few
candidates; for an item that none of them settles, the list is searched, in parts if it is long.
The sets of all candidates are written once, from the candidates' lines alone.

Sets are told apart by 128 bits and tokens of a pair compared by 40 bits of their hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    BROADCAST_ROWS,
    batches_of_text,
    checkpoint,
    count_sketch,
    done,
    flag_sketch,
    flagged,
    free_name,
    giving_back,
    giving_back_group,
    mix64,
    shared,
    shuffle_width,
    sketch_bits,
    text_slices,
    token_hashes,
)
from .setjoin import least_overlap, prefix_length

PCT = 80
#: Lines of fewer distinct words take no part: one word is enough.
MIN_WORDS = 1
#: Lists up to this length have all their pairs looked at; longer ones have a star at first.
SHORT_LIST = 4096
#: Candidates that an item gets from a list at once; lists with more are searched for items that these leave open.
MOST_CANDIDATES = 8
#: The expected length of a key's list, by its first token's count, above which keys take one token more.
EXPECTED = 1024
#: Most items of a long list that are searched by one task.
PART = 4096
_LINES = 4096  # lines sorted at once: their number has 12 bits beside a token's 52
_SLICE = 1 << 20  # bytes of text described at once
_HELD_LINES = 400_000  # described lines that a task holds before it sends them
_GROUP_TOKENS = 1 << 22  # tokens whose lines a group of lists holds on average at most
_FLAG_BITS = 23, 27  # least and most
#: Kinds of packed rows; a list of one part is of kind _LIST, part p (from 1) of others of kind _LIST + p.
_ITEMS, _REMOVED, _LIKELIEST, _OTHERS, _LIST = range(5)


def _line_words(texts: list[bytes]):
    """(hashes, line of each, first line of each text): lines are cut at \\n alone."""
    h, _, starts, _, buf = token_hashes(texts)
    raw = np.frombuffer(buf, np.uint8)
    cuts = np.flatnonzero(raw == 10)
    # lines are fewer than words
    line = np.repeat(np.arange(len(cuts) + 1), np.diff(np.searchsorted(starts, cuts), prepend=0, append=len(starts)))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    # the line that each text begins with, plus the number of all lines
    first = np.concatenate(([0], np.searchsorted(cuts, ends[:-1]) + 1, [len(cuts) + 1])) if len(texts) else np.zeros(1, np.int64)
    return h, line, first


def _token_sets(h: np.ndarray, line: np.ndarray, rarity: np.ndarray):
    """Distinct tokens of each line, rare ones first: (line, token) sorted by both."""
    mask = np.uint64(len(rarity) - 1)
    tokens = (rarity[(h & mask).astype(np.int64)].astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20))
    lines, out = [], []
    cut = np.searchsorted(line, np.arange(0, (int(line[-1]) if len(line) else 0) + _LINES + 1, _LINES))
    for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
        if a == b:
            continue
        key = ((line[a:b] - k * _LINES).astype(np.uint64) << np.uint64(52)) | tokens[a:b]
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        lines.append((key >> np.uint64(52)).astype(np.int64) + k * _LINES)
        out.append(key & np.uint64((1 << 52) - 1))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(lines), np.concatenate(out)


def rarity_classes(counts: np.ndarray) -> np.ndarray:
    """Counts as 8 bits, in eighths of powers of two; the order of counts is kept."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)


def key_sizes(lines: int) -> np.ndarray:
    """For each rarity class, how many tokens a key has that begins with a token of the class.

    The least number k (4 at most) for which k independent tokens of that count are expected
    in at most EXPECTED of ``lines`` lines; 0 for words that occur once, which nothing shares.
    """
    c = 2.0 ** ((np.arange(256) + 1) / 8)
    out = np.full(256, 4)
    for k in (3, 2, 1):
        out[c * (c / max(lines, 1)) ** (k - 1) <= EXPECTED] = k
    out[0] = 0
    return out


def _most_tokens(n: np.ndarray) -> np.ndarray:
    """Bound of a key's tokens where the smaller set has n: long lines have too many combinations."""
    return np.where(n <= 24, 4, np.where(n <= 60, 3, np.where(n <= 200, 2, 1)))


def _words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the parity of a set of n tokens: more tokens need more bits to tell sets apart."""
    return 1 << np.searchsorted((96, 208, 432), n)


def _parities(mixed: np.ndarray, start: np.ndarray, n: np.ndarray):
    """(sig, wide): each set's parity in 64 bits, and the words after the first of its full parity.

    A token flips the bit that its hash names. All words of the full parity together give sig.
    """
    k, bit = _words(n), np.uint64(1) << (mixed & np.uint64(63))
    flips = np.concatenate(([np.uint64(0)], np.bitwise_xor.accumulate(bit)))
    sig = flips[start + n] ^ flips[start]
    wide = np.zeros(int((k - 1).sum()), np.uint64)
    begin = np.cumsum(k - 1) - (k - 1)
    for most in np.unique(k[k > 1]).tolist():
        at = np.flatnonzero(k == most)
        own = np.repeat(start[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(int(n[at].sum()))
        word, own_bit, cut = (mixed[own] >> np.uint64(6)) & np.uint64(most - 1), bit[own], np.cumsum(n[at]) - n[at]
        for w in range(1, most):
            wide[begin[at] + w - 1] = np.bitwise_xor.reduceat(np.where(word == w, own_bit, np.uint64(0)), cut)
    return sig, wide


def _full_parities(sig: np.ndarray, wide: np.ndarray, n: np.ndarray) -> dict[int, np.ndarray]:
    """For 2, 4 and 8 words: the parities in as many words of the sets that have them (rows of zeros else)."""
    k = _words(n)
    begin = np.cumsum(k - 1) - (k - 1)
    out = {}
    for words in (2, 4, 8):
        full = np.zeros((len(n) if (k >= words).any() else 0, words), np.uint64)
        for most in (m for m in (2, 4, 8) if m >= words):
            at = np.flatnonzero(k == most)
            if len(at):
                own = np.stack([wide[begin[at] + w - 1] for w in range(1, most)])
                own = np.concatenate([[sig[at] ^ np.bitwise_xor.reduce(own, axis=0)], own])
                full[at] = np.bitwise_xor.reduce(own.reshape(-1, words, len(at)), axis=0).T
        out[words] = full
    return out


def _runs(values: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The values of the rows ``at``, where each row has as many consecutive values as its size."""
    begin, n = (np.cumsum(sizes) - sizes)[at], sizes[at]
    return values[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def posting_keys(tokens: np.ndarray, start: np.ndarray, n: np.ndarray, sizes: np.ndarray, pct: int):
    """(set, key, position of its first token) of every key of sets of sorted tokens.

    ``sizes`` are the key sizes by class. Sets that only equal sets resemble have none.
    """
    least = (pct * n + 99) // 100  # tokens that any similar set shares
    alone = (least == n) & (100 * n // pct == n) & (least_overlap(2 * n, pct) == n)
    # a pair's keys are bounded by its smaller set, of ``least`` to n tokens, and by what it shares
    low, high = np.minimum(_most_tokens(n), (pct * least + 99) // 100), np.minimum(_most_tokens(least), least)
    out = []
    for most in range(1, 5):
        use = np.flatnonzero(~alone & (n > 0) & (low <= most) & (high >= most))
        if not len(use):
            continue
        p = prefix_length(n[use], pct)
        own = np.repeat(use, p)
        pos = np.arange(len(own)) - np.repeat(np.cumsum(p) - p, p)
        head = tokens[start[own] + pos]
        k = np.minimum(sizes[(head >> np.uint64(44)).astype(np.int64)], most)
        for size in range(1, most + 1):
            at = np.flatnonzero(k == size)
            row, first, key = own[at], pos[at], mix64(head[at] + np.uint64(size))
            last = first
            for _ in range(size - 1):
                # every later token of the prefix that is longer by the tokens added
                more = np.maximum(np.minimum(prefix_length(n[row], pct) + size - 1, n[row]) - last - 1, 0)
                grown = np.repeat(np.arange(len(row)), more)
                step = np.arange(len(grown)) - np.repeat(np.cumsum(more) - more, more)
                row, first, last = row[grown], first[grown], last[grown] + 1 + step
                with np.errstate(over="ignore"):
                    key = mix64(key[grown] * np.uint64(3) + tokens[start[row] + last])
            out.append((row, key, first))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    row, key, first = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort((row.astype(np.uint64) << np.uint64(40)) | (key >> np.uint64(24)))
    row, key, first = row[order], key[order], first[order]
    fresh = np.concatenate(([True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])))
    return row[fresh], key[fresh], first[fresh]


def _texts(batch) -> list[bytes]:
    """A batch's texts in UTF-8 as they are; null ones are empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _grouped(batch, rarity: np.ndarray, least: int):
    """For each slice of a batch: (tokens, start, n, doc, line) of its lines of at least ``least`` words."""
    raw, ids = _texts(batch), batch.column("doc_id").to_numpy()
    for part in batches_of_text(raw, _SLICE):
        h, line, first = _line_words(raw[part])
        tokens, start, n, own = _sets(h, line, rarity, least)
        of = np.searchsorted(first, own, side="right") - 1
        yield tokens, start, n, ids[part][of], own - first[of]


def _sets(h: np.ndarray, line: np.ndarray, rarity: np.ndarray, least: int):
    """(tokens, start, n, line) of the lines of at least ``least`` words."""
    lines, tokens = _token_sets(h, line, rarity)
    start = np.flatnonzero(np.diff(lines, prepend=-1))
    n = np.diff(start, append=len(lines))
    enough = n >= least
    return tokens, start[enough], n[enough], lines[start[enough]]


def _wanted_lines(texts: list[bytes], ids: np.ndarray, flags: np.ndarray):
    """(line, doc, number) of the lines whose place the flags have."""
    buf = b"\n".join(texts)
    ends = np.append(np.flatnonzero(np.frombuffer(buf, np.uint8) == 10), len(buf))
    begins = np.concatenate(([0], ends[:-1] + 1))
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    first = np.searchsorted(begins, np.cumsum(lengths) - lengths)
    of = np.repeat(np.arange(len(texts)), np.diff(first, append=len(ends)))
    doc, number = ids[of], np.arange(len(ends)) - first[of]
    at = np.flatnonzero(flagged(flags, _place(doc, number)))
    return [buf[a:b] for a, b in zip(begins[at].tolist(), ends[at].tolist(), strict=True)], doc[at], number[at]


def _narrow(x: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as hold them all; hashes and negative ones stay as they are."""
    return x if x.dtype == np.uint64 or x.min(initial=0) < 0 else x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _widened(blobs, counted: list[int], kind) -> np.ndarray:
    """Joined columns of packed rows of so many values each, as uint64 or int64."""
    parts = [np.frombuffer(b.as_buffer(), kind if kind == np.uint64 else np.int64 if b.as_buffer().size == 8 * m else f"u{b.as_buffer().size // m}") for b, m in zip(blobs, counted, strict=True) if m]
    return np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)


def _blobs(bucket: np.ndarray, kind: int, columns: dict[str, np.ndarray], runs: dict[str, tuple] | None = None):
    """A packed row for each bucket; ``runs`` are (values, how many of them each row has)."""
    order = np.lexsort((columns["doc"], bucket)) if kind == _ITEMS else np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(np.concatenate(([-1], bucket[order], [-1]))))
    pairs = list(zip(cuts[:-1], cuts[1:], strict=True))
    out = {"bucket": pa.array(bucket[order][cuts[:-1]].astype(np.int64)), "kind": pa.array([kind] * len(pairs), pa.int64())}
    for c, x in columns.items():
        x = x[order]
        if kind == _ITEMS and c == "doc":
            # ids by their steps, which are small
            x = np.diff(x, prepend=0)
            x[cuts[:-1]] = columns["doc"][order][cuts[:-1]]
        out[c] = pa.array([(x[a:b] if kind == _REMOVED else _narrow(x[a:b])).tobytes() for a, b in pairs], pa.binary())
    for c, (x, sizes) in (runs or {}).items():
        ends, x = np.concatenate(([0], np.cumsum(sizes[order]))), _runs(x, sizes, order)
        out[c] = pa.array([_narrow(x[ends[a] : ends[b]]).tobytes() for a, b in pairs], pa.binary())
    return out, len(pairs)


_KINDS = {
    "key": np.uint64, "key2": np.uint64, "doc": np.int64, "line": np.int64, "n": np.int64, "sig": np.uint64, "wide": np.uint64,
    "posts": np.int64, "post": np.int64, "post_high": np.int64, "pos": np.int64, "rest": np.int64, "item": np.uint64, "to": np.uint64, "to_doc": np.int64, "to_line": np.int64, "differ": np.int64,
}
_PER_POST = ("post", "post_high", "pos")
_LINES_ROW = ("key", "key2", "doc", "line", "n", "sig", "wide", "posts", *_PER_POST)
_LISTS_ROW = ("rest", "doc", "line", "n", "pos", "sig", "wide")
_FOUND_ROW = ("item", "to", "doc", "to_doc", "line", "to_line", "differ", "n", "sig")
#: Bits of a key that travel; in a bucket the rest of these, modulo 2**32, tells keys apart. Two
#: keys taken for one only add candidates.
_KEY_BITS = 48


def _schema(names) -> str:
    return "bucket long, kind long, " + ", ".join(f"{c} binary" for c in names)


def _rows(made, names) -> pa.RecordBatch:
    out, m = made
    return pa.RecordBatch.from_arrays([out["bucket"], out["kind"], *[out.get(c, pa.nulls(m, pa.binary())) for c in names]], names=["bucket", "kind", *names])


def _opened(rows, kind: int, names) -> dict[str, np.ndarray]:
    rows = rows.filter(pa.compute.equal(rows["kind"], kind))
    counted = [b.as_buffer().size // 8 for b in rows["sig"]]
    ragged = {"wide": lambda x: _words(x["n"]) - 1} | {c: (lambda x: x["posts"]) for c in _PER_POST if "posts" in names}
    out = {c: _widened(rows[c], counted, _KINDS[c]) for c in names if c not in ragged}
    if len(counted):
        out["doc"] = np.concatenate([np.cumsum(steps) for steps in np.split(out["doc"], np.cumsum(counted)[:-1])])
    cuts = np.cumsum(counted)[:-1]
    for c, sizes in ragged.items():
        if c in names and len(counted):
            out[c] = _widened(rows[c], [int(part.sum()) for part in np.split(sizes(out), cuts)], _KINDS[c])
    return out | {c: np.empty(0, _KINDS[c]) for c in names if c not in out}


def _removed(doc: np.ndarray, line: np.ndarray, names, bucket: int) -> pa.RecordBatch:
    return _rows(_blobs(np.full(len(doc), bucket), _REMOVED, {"doc": doc, "line": line}), names)


def _passed_on(rows: pa.Table, names) -> pa.Table:
    gone = rows.filter(pa.compute.equal(rows["kind"], _REMOVED))
    return pa.table({c: gone[c] if c in gone.column_names else pa.nulls(len(gone), pa.binary()) for c in ("bucket", "kind", *names)})


def _first_of_each(x: dict[str, np.ndarray]):
    """(rows of each key's first place, rows at later places)."""
    order = np.lexsort((x["line"], x["doc"], x["key2"], x["key"]))
    k1, k2, doc, line = (x[c][order] for c in ("key", "key2", "doc", "line"))
    new = np.concatenate(([True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))) if len(order) else np.zeros(0, bool)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else np.zeros(0, np.int64)
    later = (doc != doc[head]) | (line != line[head])
    return order[new], order[later]


def _describe(docs: DataFrame, rarity, sizes, buckets: int, pct: int, least: int) -> DataFrame:
    """Packed lines by bucket of their sets: each task sends a set's first line, and the places of later ones."""

    def run(batches):
        held: list[dict] = []
        n_held = 0
        spread = TaskContext.get().partitionId() % buckets

        def settle():
            x = {c: np.concatenate([h[c] for h in held]) for c in _LINES_ROW}
            held.clear()
            first, later = _first_of_each(x)
            if len(later):
                yield _removed(x["doc"][later], x["line"][later], _LINES_ROW, spread)
            runs = {"wide": (_runs(x["wide"], _words(x["n"]) - 1, first), _words(x["n"][first]) - 1)}
            runs |= {c: (_runs(x[c], x["posts"], first), x["posts"][first]) for c in _PER_POST}
            x = {c: x[c][first] for c in _LINES_ROW if c not in runs}
            bucket = (mix64(x["key"]) % np.uint64(buckets)).astype(np.int64)
            yield _rows(_blobs(bucket, _ITEMS, x, runs), _LINES_ROW)

        for batch in (part for whole in batches for part in text_slices(whole)):
            for tokens, start, n, doc, line in _grouped(batch, rarity.value, least):
                if not len(n):
                    continue
                # sums and parities over each line's tokens
                mixed, ends = mix64(tokens), start + n
                with np.errstate(over="ignore"):
                    run1 = np.concatenate(([np.uint64(0)], np.cumsum(mixed)))
                    run2 = np.concatenate(([np.uint64(0)], np.cumsum(mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)))))
                    key, key2 = run1[ends] - run1[start], run2[ends] - run2[start]
                sig, wide = _parities(mixed, start, n)
                row, post, pos = posting_keys(tokens, start, n, sizes, pct)
                post = (post >> np.uint64(64 - _KEY_BITS)).view(np.int64)
                held.append(
                    {
                        "key": key, "key2": key2, "doc": doc, "line": line, "n": n, "sig": sig, "wide": wide,
                        "posts": np.bincount(row, minlength=len(n)), "post": post & 0xFFFFFFFF, "post_high": post >> 32, "pos": pos,
                    }
                )
                n_held += len(n)
                if n_held > _HELD_LINES:
                    yield from settle()
                    n_held = 0
        if held:
            yield from settle()

    return docs.mapInArrow(giving_back(run), _schema(_LINES_ROW))


def _postings(buckets: int):
    """For a bucket of lines: the keys of each distinct set's first line, by bucket of the key."""

    def run(rows: pa.Table) -> pa.Table:
        x = _opened(rows, _ITEMS, _LINES_ROW)
        first, later = _first_of_each(x)
        out = [_passed_on(rows, _LISTS_ROW)]
        if len(later):
            out.append(pa.Table.from_batches([_removed(x["doc"][later], x["line"][later], _LISTS_ROW, rows["bucket"][0].as_py())]))
        low, high, pos = (_runs(x[c], x["posts"], first) for c in _PER_POST)
        if len(low):
            own = np.repeat(first, x["posts"][first])
            rest, bucket = np.divmod((high << 32) | low, buckets)
            columns = {"rest": rest & 0xFFFFFFFF, "pos": pos, **{c: x[c][own] for c in ("doc", "line", "n", "sig")}}
            wide = _runs(x["wide"], _words(x["n"]) - 1, own), _words(x["n"][own]) - 1
            out.append(pa.Table.from_batches([_rows(_blobs(bucket, _ITEMS, columns, {"wide": wide}), _LISTS_ROW)]))
        return pa.concat_tables(out)

    return run


def _candidates(pct: int):
    """For a bucket of keys: packed candidate pairs and the members of long lists."""

    def run(rows: pa.Table) -> pa.Table:
        x = _opened(rows, _ITEMS, _LISTS_ROW)
        out, number = [_passed_on(rows, _FOUND_ROW)], rows["bucket"][0].as_py()
        # by key, then length
        order = np.argsort((x["rest"] << 30) | np.minimum(x["n"], (1 << 30) - 1))
        key = x["rest"][order]
        met = np.zeros(len(key), bool)
        met[1:] = key[1:] == key[:-1]
        met[:-1] |= met[1:]
        order = order[met]  # a key of one set finds nothing
        wide = _runs(x["wide"], _words(x["n"]) - 1, order)
        x = {c: v[order] for c, v in x.items() if c != "wide"}
        full = _full_parities(x["sig"], wide, x["n"])
        key, n, pos, sig = x["rest"], x["n"].astype(np.int32), x["pos"].astype(np.int32), x["sig"]
        after = n - pos - 1
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate((start, [len(key)])))
        size_of, list_of = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
        item = _item(x["doc"], x["line"], x["sig"])
        found: list[tuple[np.ndarray, ...]] = []
        have = np.zeros(len(key), np.int64)

        # by the sum of two sizes, the tokens that may be in one of the sets alone
        sums = np.arange(2 * min(int(n.max(initial=0)), 1 << 16) + 1, dtype=np.int32)
        rooms, most = sums - 2 * least_overlap(sums, pct), 2 * int(n.max(initial=0))

        def take(i: np.ndarray, j: np.ndarray) -> None:
            """Keep what passes the filters; i and j are positions in the same list."""
            total = n[i] + n[j]
            room = rooms[total] if most < len(rooms) else total - 2 * least_overlap(total, pct)
            # the parity leaves the fewest
            differ = np.bitwise_count(sig[i] ^ sig[j])
            ok = np.flatnonzero(differ <= room)
            i, j, total, room, differ = i[ok], j[ok], total[ok], room[ok], differ[ok]
            ok = total - room <= 2 * (np.minimum(pos[i], pos[j]) + 1 + np.minimum(after[i], after[j]))
            ok &= 100 * np.minimum(n[i], n[j]) >= pct * np.maximum(n[i], n[j])
            ok &= (x["doc"][i] != x["doc"][j]) | (x["line"][i] != x["line"][j])
            i, j, differ, room = i[ok], j[ok], differ[ok].astype(np.int64), room[ok]
            both = np.minimum(n[i], n[j])
            for words, bits in full.items() if both.max(initial=0) > 96 else ():
                at = np.flatnonzero(_words(both) >= words)
                if len(at):
                    differ[at] = np.bitwise_count(bits[i[at]] ^ bits[j[at]]).sum(axis=1, dtype=np.int64)
            ok = differ <= room
            i, j, differ = i[ok], j[ok], differ[ok]
            if not len(i):
                return
            swap = (x["doc"][i] < x["doc"][j]) | ((x["doc"][i] == x["doc"][j]) & (x["line"][i] < x["line"][j]))
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            ok = have[a] < MOST_CANDIDATES
            a, b, differ = a[ok], b[ok], differ[ok]
            np.add.at(have, a, 1)
            found.append((item[a], item[b], x["doc"][a], x["doc"][b], x["line"][a], x["line"][b], differ))

        # how many of those after it in its list each may resemble by length
        by_length = (key << 30) | np.minimum(x["n"], (1 << 30) - 1)
        reach = np.searchsorted(by_length, (key << 30) | np.minimum(100 * x["n"] // pct, (1 << 30) - 1), side="right") - np.arange(len(key)) - 1
        i, d = np.flatnonzero((size_of <= SHORT_LIST) & (reach > 0)), 1
        while len(i):
            open_pairs = i[(have[i] < MOST_CANDIDATES) | (have[i + d] < MOST_CANDIDATES)]
            take(open_pairs, open_pairs + d)
            d += 1
            i = i[reach[i] >= d]
        at = np.flatnonzero(size_of > SHORT_LIST)
        if len(at):
            # a star against the first place of each length in eighths of powers of two
            grade = np.floor(8 * np.log2(n[at])).astype(np.int64)
            new = np.concatenate(([True], (key[at][1:] != key[at][:-1]) | (grade[1:] != grade[:-1])))
            of = np.cumsum(new) - 1
            order = np.lexsort((x["line"][at], x["doc"][at], of))
            take(at, at[order[np.flatnonzero(new)]][of])
        # members that more of the list may resemble than the candidates they have
        may = (have >= MOST_CANDIDATES) | (size_of > SHORT_LIST)
        dense = np.bincount(list_of[may], minlength=len(size)) > 0
        at = np.flatnonzero(dense[list_of])
        part = (at - start[list_of[at]]) // PART + (size_of[at] > PART)
        for p in range(int(part.max(initial=-1)) + 1):
            some = at[part == p]
            columns = {"item": item[some], "differ": may[some] * np.where(size_of[some] > SHORT_LIST, 2, 1), **{c: x[c][some] for c in ("doc", "line", "n", "sig")}}
            out.append(pa.Table.from_batches([_rows(_blobs(number * (1 << 32) + key[some], _LIST + p, columns), _FOUND_ROW)]))
        if found:
            pairs = dict(zip(_FOUND_ROW[:-2], (np.concatenate(f) for f in zip(*found, strict=True)), strict=True))
            order = np.lexsort((pairs["to"], pairs["differ"], pairs["item"]))
            pairs = {c: v[order] for c, v in pairs.items()}
            own, to = pairs["item"], pairs["to"]
            new = np.concatenate(([True], own[1:] != own[:-1]))
            again = np.concatenate(([False], (own[1:] == own[:-1]) & (to[1:] == to[:-1])))
            for kind, some in ((_LIKELIEST, new), (_OTHERS, ~new & ~again)):
                if some.any():
                    columns = {c: v[some] for c, v in pairs.items()}
                    out.append(pa.Table.from_batches([_rows(_blobs(np.zeros(int(some.sum()), np.int64), kind, columns), _FOUND_ROW)]))
        return pa.concat_tables(out)

    return run


def _found_row(batch, row: int, prefix: str = "") -> dict[str, np.ndarray]:
    blobs = {c: batch.column(prefix + c)[row] for c in _FOUND_ROW}
    m = blobs["item" if blobs["item"].is_valid else "doc"].as_buffer().size // 8
    return {c: _widened([blob], [m], _KINDS[c]) for c, blob in blobs.items() if blob.is_valid}


def _unpacked(found: DataFrame, wanted: str, names, open_items=None) -> DataFrame:
    """The columns ``names`` of the packed rows for which ``wanted`` holds.

    With ``open_items``, a broadcast flag sketch, only of the items that it has.
    """
    sized = names[0]  # of 8 bytes each: the item, or the document of places that are removed

    def run(batches):
        for batch in (part for whole in batches for part in text_slices(whole, 32)):
            counted = [b.as_buffer().size // 8 for b in batch.column(sized)]
            x = {c: _widened(batch.column(c), counted, _KINDS[c]) for c in names}
            if open_items is not None:
                keep = flagged(open_items.value, x["item"])
                x = {c: v[keep] for c, v in x.items()}
            yield pa.RecordBatch.from_arrays([pa.array(x[c].view(np.int64)) for c in names], names=list(names))

    return found.where(wanted).select(*names).mapInArrow(giving_back(run), ", ".join(f"{c} long" for c in names)).withColumns({c: F.col(c).cast("int") for c in names if c == "line"})


def _open_in_lists(lists: DataFrame, still) -> DataFrame:
    """(item): the items that more of a list may resemble, each about once a task.

    In a list whose pairs were all looked at such an item has candidates, so it is open only if
    the flags ``still`` have it; in a longer one it need not have any.
    """

    def run(batches):
        held, n = [], 0
        for batch in (part for whole in batches for part in text_slices(whole, 32)):
            counted = [b.as_buffer().size // 8 for b in batch.column("item")]
            item, may = (_widened(batch.column(c), counted, _KINDS[c]) for c in ("item", "differ"))
            item, may = item[may > 0], may[may > 0]
            held.append(np.unique(item[(may > 1) | flagged(still.value, item)]))
            n += len(held[-1])
            if n > _HELD_LINES:
                held = [np.unique(np.concatenate(held))]
                n = 0
                if len(held[0]) > _HELD_LINES:
                    yield send(held.pop())
        if held:
            yield send(np.unique(np.concatenate(held)))

    def send(items):
        return pa.RecordBatch.from_arrays([pa.array(items.view(np.int64))], names=["item"])

    return lists.select("item", "differ").mapInArrow(giving_back(run), "item long")


def _with_places(x: dict[str, np.ndarray], names) -> dict[str, np.ndarray]:
    return x | {c: _place(x[of + "doc"], x[of + "line"]) for c, of in (("place", ""), ("to_place", "to_")) if c in names}


def _place(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(doc.astype(np.int64).view(np.uint64) + np.uint64(1)) + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _item(doc: np.ndarray, line: np.ndarray, sig: np.ndarray) -> np.ndarray:
    """A number for a set at a place."""
    return mix64(_place(doc, line) ^ mix64(sig))


def _flags(rows: DataFrame, bits: int):
    """Broadcast flags of the items in the columns item and to, of their places and of their documents, or of the numbers x."""
    names = [c for c in ("x", "item", "to", "place", "to_place", "doc", "to_doc") if c in rows.columns]
    return shared(rows.sparkSession, flag_sketch(rows, names, bits))


def _candidate_numbers(found: DataFrame) -> DataFrame:
    """(x): the items and places that packed candidate pairs name, and their documents, each about once a task."""
    names = ("item", "to", "place", "to_place", "doc", "to_doc")

    def run(batches):
        held, n = [], 0
        for batch in (part for whole in batches for part in text_slices(whole, 16)):
            for row in range(batch.num_rows):
                x = _with_places(_found_row(batch, row), names)
                held += [x[c].view(np.int64) for c in names]
                n += len(x["doc"])
                if n > _HELD_LINES:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    def send(held):
        return pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(held)))], names=["x"])

    return found.where(f"kind in ({_LIKELIEST}, {_OTHERS})").mapInArrow(giving_back(run), "x long")


def _packed_sets(tokens: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """Of each set its tokens by 40 bits of their hashes."""
    at = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    low = tokens[at].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
    ends = 5 * np.concatenate(([0], np.cumsum(n)))
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(low.tobytes())])


def _set_tokens(packed) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of all sets, the set of each)."""
    low = np.frombuffer(b"".join(packed.to_pylist()), np.uint8).reshape(-1, 5)
    tokens = np.zeros((len(low), 8), np.uint8)
    tokens[:, :5] = low
    sizes = pa.compute.binary_length(packed).to_numpy(zero_copy_only=False) // 5
    return tokens.view("<u8").ravel(), np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)


def _sets_of(docs: DataFrame, wanted, rarity, least: int) -> DataFrame:
    """(item, set): the packed tokens of the lines whose place and item pass the flag sketch; other lines are not tokenised."""

    def run(batches):
        for batch in (part for whole in batches for part in text_slices(whole, 2048)):
            ids = batch.column("doc_id").to_numpy()
            batch = batch.take(pa.array(np.flatnonzero(flagged(wanted.value, ids))))
            for part in text_slices(batch):
                raw, ids = _texts(part), part.column("doc_id").to_numpy()
                for some in batches_of_text(raw, _SLICE):
                    found, doc, line = _wanted_lines(raw[some], ids[some], wanted.value)
                    h, own, _ = _line_words(found)
                    tokens, start, n, own = _sets(h, own, rarity.value, least)
                    item = _item(doc[own], line[own], _parities(mix64(tokens), start, n)[0])
                    keep = np.flatnonzero(flagged(wanted.value, item))
                    keep = keep[np.unique(item[keep], return_index=True)[1]]
                    yield pa.RecordBatch.from_arrays([pa.array(item[keep].view(np.int64)), _packed_sets(tokens, start[keep], n[keep])], names=["item", "set"])

    # rows that repeat a document repeat its sets
    return docs.mapInArrow(giving_back(run), "item long, set binary").groupBy("item").agg(F.first("set").alias("set"))


def _similar(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """(item, doc, line) of the pairs (item, to, doc, line) that pass the exact test."""

    def test(batches):
        for batch in (part for whole in batches for part in text_slices(whole)):
            (x, of), (y, to_of) = _set_tokens(batch.column("set")), _set_tokens(batch.column("to_set"))
            both = np.concatenate([x | (of << np.uint64(40)), y | (to_of << np.uint64(40))])
            both.sort()
            common = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(40)).astype(np.int64), minlength=batch.num_rows)
            total = np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=batch.num_rows)
            out = batch.filter(pa.array(100 * common >= pct * (total - common)))
            yield pa.RecordBatch.from_arrays([out.column(c) for c in ("item", "doc", "line")], names=["item", "doc", "line"])

    to = sets.select(F.col("item").alias("to"), F.col("set").alias("to_set"))
    both = pairs.join(to, "to").select("item", "doc", "line", "to_set").join(sets, "item")
    return both.mapInArrow(giving_back(test), "item long, doc long, line int")


def _pairs_in_lists(lists: DataFrame, open_items, pct: int, groups: int = 0) -> DataFrame:
    """(item, to, doc, to_doc, line, place, to_place): of packed lists, the open items with all earlier members that pass the filters.

    Lists of one part are looked at where they are; the open items of others visit all parts. A
    pair meets in several lists, so pairs travel packed and each is given once.
    """
    buckets = max(2 * shuffle_width(lists.sparkSession), groups)

    def search(x, y):
        """The open items of x against the members y."""
        for i in np.flatnonzero(flagged(open_items.value, x["item"]) & (x["differ"] > 0)).tolist():
            n, m = int(x["n"][i]), y["n"]
            room = n + m - 2 * least_overlap(n + m, pct)
            ok = (np.bitwise_count(y["sig"] ^ x["sig"][i]) <= room) & (100 * np.minimum(n, m) >= pct * np.maximum(n, m))
            doc, line = x["doc"][i], x["line"][i]
            at = np.flatnonzero(ok & ((y["doc"] < doc) | ((y["doc"] == doc) & (y["line"] < line))))
            if len(at):
                one = lambda v: np.full(len(at), v, np.int64)
                yield np.full(len(at), x["item"][i]), y["item"][at], one(doc), y["doc"][at], one(line), y["line"][at]

    def packed(found):
        held, n = [], 0
        for part in found:
            held.append(part)
            n += len(part[0])
            if n > _HELD_LINES:
                yield send(held)
                held, n = [], 0
        if held:
            yield send(held)

    def send(held):
        columns = distinct(dict(zip(names, (np.concatenate(c) for c in zip(*held, strict=True)), strict=True)))
        bucket = mix64(columns["item"] ^ mix64(columns["to"])) % np.uint64(buckets)
        return _rows(_blobs(bucket.astype(np.int64), _OTHERS, columns), _FOUND_ROW)

    def distinct(columns):
        order = np.lexsort((columns["to"], columns["item"]))
        item, to = columns["item"][order], columns["to"][order]
        order = order[np.concatenate(([True], (item[1:] != item[:-1]) | (to[1:] != to[:-1])))]
        return {c: v[order] for c, v in columns.items()}

    def opened(rows: pa.Table) -> pa.Table:
        parts = [_found_row(batch, row) for batch in rows.to_batches() for row in range(batch.num_rows)]
        columns = _with_places(distinct({c: np.concatenate([x[c] for x in parts]) for c in names}), places)
        return pa.table({c: columns[c].view(np.int64) for c in (*names[:5], *places)})

    def pairs_within(batches):
        for batch in (part for whole in batches for part in text_slices(whole, 16)):
            for row in range(batch.num_rows):
                x = _found_row(batch, row)
                yield from search(x, x)

    def pairs_across(batches):
        for batch in (part for whole in batches for part in text_slices(whole, 16)):
            for row in range(batch.num_rows):
                yield from search(_found_row(batch, row, "of_"), _found_row(batch, row))

    def within(batches):
        yield from packed(pairs_within(batches))

    def across(batches):
        yield from packed(pairs_across(batches))

    def having(batches):
        """The rows with open items."""
        for batch in (part for whole in batches for part in text_slices(whole, 16)):
            rows = (_found_row(batch, row) for row in range(batch.num_rows))
            yield batch.filter(pa.array([bool((flagged(open_items.value, x["item"]) & (x["differ"] > 0)).any()) for x in rows], pa.bool_()))

    names, places = _FOUND_ROW[:6], ("place", "to_place")
    schema = "item long, to long, doc long, to_doc long, line long, place long, to_place long"
    dealt = lists.where(F.col("kind") > _LIST).select("bucket", "kind", *_FOUND_ROW)
    visits = dealt.mapInArrow(giving_back(having), dealt.schema).select("bucket", F.col("kind").alias("of_kind"), *[F.col(c).alias(f"of_{c}") for c in _FOUND_ROW])
    visits = visits.join(dealt, "bucket").where("kind != of_kind")
    both = lists.mapInArrow(giving_back(within), _schema(_FOUND_ROW)).unionByName(visits.mapInArrow(giving_back(across), _schema(_FOUND_ROW)))
    return both.groupBy("bucket").applyInArrow(giving_back_group(opened), schema).withColumn("line", F.col("line").cast("int"))


def _by_document(gone: DataFrame) -> DataFrame:
    """Of (doc, line): each document's distinct lines in order, and a byte for each line up to the last, 1 if it goes."""

    def run(batches):
        doc, line = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            # the last document of a batch may go on in the next
            doc, line = np.concatenate([doc, batch.column("doc").to_numpy()]), np.concatenate([line, batch.column("line").to_numpy()])
            end = int(np.searchsorted(doc, doc[-1])) if len(doc) else 0
            if end:
                yield lists(doc[:end], line[:end])
            doc, line = doc[end:], line[end:]
        if len(doc):
            yield lists(doc, line)

    def lists(doc, line):
        new = np.concatenate(([True], doc[1:] != doc[:-1]))
        fresh = new | np.concatenate(([True], line[1:] != line[:-1]))
        doc, line, start = doc[fresh], line[fresh], np.flatnonzero(new[fresh])
        ends = np.append(start[1:], len(doc))
        masks = np.cumsum(line[ends - 1] + 1)  # where each document's mask ends
        mask = np.zeros(int(masks[-1]), np.uint8)
        mask[np.repeat(masks - line[ends - 1] - 1, ends - start) + line] = 1
        removed = pa.ListArray.from_arrays(pa.array(np.append(start, len(doc)), pa.int32()), pa.array(line))
        mask = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(np.concatenate(([0], masks)).astype(np.int32).tobytes()), pa.py_buffer(mask.tobytes())])
        return pa.RecordBatch.from_arrays([pa.array(doc[start]), removed, mask], names=["doc_id", "removed", "mask"])

    rows = gone.select("doc", F.col("line").cast("long").alias("line"))
    return rows.repartition("doc").sortWithinPartitions("doc", "line").mapInArrow(giving_back(run), "doc_id long, removed array<bigint>, mask binary")


def repeated_lines(docs: DataFrame, pct: int = PCT, least: int = MIN_WORDS) -> DataFrame:
    """(doc_id, removed): the numbers (from 0) of each document's lines that go, if any."""
    return _repeated(docs, pct, least).select("doc_id", "removed")


def _repeated(docs: DataFrame, pct: int, least: int) -> DataFrame:
    """repeated_lines, with the mask of _by_document."""
    spark = docs.sparkSession
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def hashes(batch):
        for part in text_slices(batch):
            yield token_hashes(_texts(part))[0]

    rows = docs.count()
    bits = sketch_bits(8 * rows, *_FLAG_BITS)
    counts = count_sketch(docs.select("text"), hashes, sketch_bits(rows))
    # key sizes need the lines' number roughly: a token in 32 begins one
    rarity, sizes = shared(spark, rarity_classes(counts)), key_sizes(int(counts.sum()) // 32)
    # a line's keys are fewer than its tokens, so their number bounds what a group holds
    buckets = max(2 * shuffle_width(spark), int(counts.sum()) // _GROUP_TOKENS)
    # no name holds the frames before the checkpoint, so that Spark can clear their shuffles away
    found = checkpoint(
        _describe(docs, rarity, sizes, buckets, pct, least)
        .groupBy("bucket").applyInArrow(giving_back_group(_postings(buckets)), _schema(_LISTS_ROW))
        .groupBy("bucket").applyInArrow(giving_back_group(_candidates(pct)), _schema(_FOUND_ROW))
    )

    # The sets of all candidates, written once.
    wanted = _flags(_candidate_numbers(found), bits)
    sets = checkpoint(_sets_of(docs, wanted, rarity, least))
    done(wanted)

    # Of each item its likeliest candidate first.
    likely = _unpacked(found, f"kind = {_LIKELIEST}", ("item", "to", "doc", "line", "differ"))
    tried = checkpoint(likely.groupBy("item", "doc", "line").agg(F.min_by("to", "differ").alias("to")))
    matched = checkpoint(_similar(tried, sets, pct))

    # Then the others of the items that it leaves open.
    still = _flags(tried.join(matched, "item", "left_anti").select("item"), bits)
    rest = checkpoint(_unpacked(found, f"kind in ({_LIKELIEST}, {_OTHERS})", ("item", "to", "doc", "line"), still).distinct())
    if not rest.isEmpty():
        matched = matched.unionByName(checkpoint(_similar(rest, sets, pct)))

    # And all others of the lists that hold more for an item than these.
    lists = found.where(f"kind >= {_LIST}")
    left = checkpoint(_open_in_lists(lists, still).distinct().join(matched, "item", "left_anti"))
    done(still)
    if not left.isEmpty():
        still = _flags(left, bits)
        more = checkpoint(_pairs_in_lists(lists, still, pct, buckets).join(left, "item", "left_semi"))
        done(still)
        wanted = _flags(more, bits)
        if more.count() <= BROADCAST_ROWS:
            own = more.select(F.col("doc").alias("doc_id")).union(more.select("to_doc")).distinct()
            docs = docs.join(F.broadcast(own), "doc_id", "left_semi")
        matched = matched.unionByName(checkpoint(_similar(more.select("item", "to", "doc", "line"), _sets_of(docs, wanted, rarity, least), pct)))
        done(wanted)
    done(rarity)
    gone = _unpacked(found, f"kind = {_REMOVED}", ("doc", "line")).unionByName(matched.select("doc", "line"))
    return _by_document(gone)


def dedup_lines(docs: DataFrame, pct: int = PCT, least: int = MIN_WORDS) -> DataFrame:
    """The input rows, all columns, with text without the lines that go, plus ``removed_lines``.

    Lines of fewer than ``least`` distinct words, empty texts, null texts and rows of null id
    stay as they are. Rows that share an id count as one document: their equal lines at equal
    places are one occurrence. Lines are cut at \\n; a text's other lines keep their order.
    ``removed_lines`` is an array of line numbers from 0, empty if none goes; it takes the place of
    a column of that name, so the operator can be applied to its own result.
    """
    gone = _repeated(docs.select("doc_id", "text"), pct, least)
    doc, cut, mask = (free_name(docs, c) for c in ("__doc", "__removed", "__mask"))
    joined = docs.join(gone.toDF(doc, cut, mask).hint("shuffle_hash"), F.col("doc_id") == F.col(doc), "left")
    removed = F.coalesce(cut, F.array().cast("array<bigint>"))
    # the mask has a byte for each line, so that a look at one takes no search
    kept = F.filter(F.split("text", "\n", -1), lambda _, i: F.substring(F.col(mask), i + 1, F.lit(1)) != F.lit(b"\1"))
    text = F.when(F.col(cut).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    others = [F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns if c.lower() != "removed_lines"]
    return joined.select(*others, removed.alias("removed_lines"))
