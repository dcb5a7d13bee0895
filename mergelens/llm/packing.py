"""Packing of documents into training sequences: first-fit decreasing with a tournament tree.

Documents are tokenised once, cut at multiples of the sequence length, and packed in randomised
groups of documents that are independent of each other. The tree holds the largest room left in
any bin below each node, so the first bin with enough room is found in log2(bins) steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of_text, encoded, map_arrow, mix64, text_slices, word_hashes

SEQUENCE = 4096
END_ID = 2
#: Documents a group has on average. More fill sequences better, fewer need less memory.
GROUP_DOCS = 2048
#: Entries after which a worker's word or piece cache starts anew.
CACHE_WORDS = 200_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class TournamentBins:
    """Bins of equal capacity; ``add`` puts a size into the first bin that has room."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.leaves = capacity, 1
        while self.leaves < max(most, 1):
            self.leaves *= 2
        self.room = [capacity] * (2 * self.leaves)

    def add(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        offset = self.capacity - room[at]
        where = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            top = max(room[2 * at], room[2 * at + 1])
            if room[at] == top:
                break
            room[at] = top
        return where, offset


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each size; larger sizes first, ties in the order given."""
    bins = TournamentBins(capacity, len(sizes))
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.add(sizes[i])
    return out


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``flat`` that begin at ``start``, one after the other."""
    return flat[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class _Runs:
    """Numbered runs of ids in one array that grows."""

    def __init__(self):
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat.astype(np.uint32)])


class WordTokenizer:
    """Token ids of whole texts, for the word-end BPE files.

    White space separates words for this tokeniser and its pattern's pieces are coded one by
    one, so the distinct words of some texts, told apart by 64-bit hashes, are looked up in numpy
    and only pieces not seen before reach the tokeniser. Both caches are bounded. Words that
    hold an added token's string, or a character that normalising may change, are passed to the
    tokeniser as they are.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        self.piece = Tokenizer.from_file(path)
        self.piece.normalizer = normalizers.Sequence([])
        self.piece.pre_tokenizer = pre_tokenizers.ByteLevel(
            add_prefix_space=False, trim_offsets=True, use_regex=False
        )
        self.split = regex.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall
        # letters of Latin-1 and Latin Extended-A: composed already, lower-cased one to one
        self.plain = regex.compile(r"[!-;=-~¡-¬®-įı-ž]+").fullmatch
        self.plain_all = regex.compile(r"[\n!-;=-~¡-¬®-įı-ž]+").fullmatch
        self._clear_words()
        self._clear_pieces()

    def _clear_words(self) -> None:
        self.known = np.empty(0, np.uint64)  # sorted hashes
        self.number = np.empty(0, np.int64)  # of each hash's run
        self.words = _Runs()

    def _clear_pieces(self) -> None:
        self.at: dict[str, int] = {"\n": -1}
        self.pieces = _Runs()

    def _code_pieces(self, pieces: list[str]) -> np.ndarray:
        """Their run numbers, -1 for the newlines that end words; new ones are coded."""
        if len(self.at) > CACHE_WORDS:
            self._clear_pieces()
        at = self.at
        fresh = list({p for p in pieces if p not in at})
        for a in range(0, len(fresh), 4096):
            some = fresh[a : a + 4096]
            got = self.piece.encode(some, is_pretokenized=True, add_special_tokens=False)
            of = np.array(got.word_ids, np.int64)
            at.update(zip(some, range(len(at) - 1, len(at) - 1 + len(some)), strict=True))
            self.pieces.add(np.array(got.ids, np.uint32), np.bincount(of, minlength=len(some)))
        return np.fromiter(map(at.__getitem__, pieces), np.int64, len(pieces))

    def _code_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, how many each has)."""
        joined = b"\n".join(words).decode("utf-8", "surrogatepass")
        odd = np.zeros(len(words), bool)
        if not self.plain_all(joined):
            odd = np.array([not self.plain(w) for w in joined.split("\n")])
            joined = "\n".join(w for w, o in zip(joined.split("\n"), odd, strict=True) if not o)
        size = np.zeros(len(words), np.int64)
        ids = np.empty(0, np.uint32)
        if not odd.all():
            found = self.split(joined.lower() + "\n")
            run = self._code_pieces(found)
            inside = run >= 0
            of, run = np.cumsum(~inside)[inside], run[inside]
            own = self.pieces.size[run]
            ids = _gather(self.pieces.flat, self.pieces.start[run], own)
            size[~odd] = np.bincount(of, own, minlength=int((~odd).sum())).astype(np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            got = self.full.encode_batch([words[i].decode() for i in which.tolist()], add_special_tokens=False)
            size[which] = [len(e.ids) for e in got]
            out = np.empty(int(size.sum()), np.uint32)
            special = np.repeat(odd, size)
            out[~special], out[special] = ids, [i for e in got for i in e.ids]
            ids = out
        return ids, size

    def ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts as uint32, the first of each text's and an end mark)."""
        h, first, starts, ends, buf = word_hashes(texts, lower=False)
        distinct, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) + len(distinct) > CACHE_WORDS:
            self._clear_words()
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != distinct[inside]
        if new.any():
            some = where[new]
            flat, size = self._code_words([buf[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)])
            numbers = np.arange(len(self.words.size), len(self.words.size) + len(size))
            self.words.add(flat, size)
            self.known, self.number = np.insert(self.known, at[new], distinct[new]), np.insert(self.number, at[new], numbers)
            at = np.searchsorted(self.known, distinct)
        run = self.number[at][inverse] if len(h) else np.empty(0, np.int64)
        size = self.words.size[run]
        cuts = np.concatenate(([0], np.cumsum(size)))[first]
        return _gather(self.words.flat, self.words.start[run], size), cuts


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of at most ``length`` ids of (doc_id, text) rows.

    Null text counts as empty and yields the end id alone. Repeated rows are separate documents.
    Rows with a null id are tokenised like others.
    """
    end = np.array([end_id], "<u4").tobytes()
    # a document's draw is its row's place, so copies and repeated ids are drawn apart
    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"))

    def run(whole):
        for batch in text_slices(whole):
            yield from cut(batch)

    def cut(batch):
        coder = tokenizer(tokenizer_path)
        texts, ids = encoded(batch.column("text").to_pylist()), batch.column("doc_id").to_pylist()
        draws = mix64(batch.column("row").to_numpy().view(np.uint64)).view(np.int64).tolist()
        for part in batches_of_text(texts, 4 << 20):
            flat, cuts = coder.ids(texts[part])
            flat, rows = memoryview(flat.astype("<u4").tobytes()), []
            for doc, draw, a, b in zip(ids[part], draws[part], cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                n = b - a + 1
                for at in range(0, n, length):
                    to = min(at + length, n)
                    crc = zlib.crc32(flat[4 * (a + at) : 4 * (a + min(to, n - 1))])
                    rows.append((doc, at, to - at, zlib.crc32(end, crc) if to == n else crc, n, draw))
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "draw"), zip(*rows, strict=True), strict=True))

    return map_arrow(placed, run, PIECES + ", draw long")


def pack(pieces: DataFrame, groups: int, length: int = SEQUENCE, seed: int = 17) -> DataFrame:
    """Pack pieces by first-fit decreasing, in ``groups`` random groups of whole documents (by ``draw``).

    ``sequence_id`` is the group times 2**32 plus the bin. Ties are packed by (doc_id, start,
    ids_crc32, draw), so the result does not depend on the order of arrival.
    """

    def fill(rows: pa.Table) -> pa.Table:
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending"), ("draw", "ascending")]
        rows = rows.sort_by(order)
        placed = first_fit_decreasing(rows["length"].to_pylist(), length)
        group = rows["group"][0].as_py()
        rows = rows.drop_columns(["group", "draw"])
        rows = rows.append_column("sequence_id", pa.array([(group << 32) + b for b, _ in placed], pa.int64()))
        return rows.append_column("offset", pa.array([o for _, o in placed], pa.int64()))

    drawn = F.pmod(F.xxhash64("draw", F.lit(seed)), F.lit(groups))
    return pieces.withColumn("group", drawn).groupBy("group").applyInArrow(fill, PACKED)


def pack_documents(
    docs: DataFrame, tokenizer_path: str, length: int = SEQUENCE, end_id: int = END_ID, group_docs: int = GROUP_DOCS
) -> DataFrame:
    """Tokenise and pack all documents; an empty table gives no rows."""
    pieces = token_pieces(docs, tokenizer_path, length, end_id)
    return pack(pieces, max(1, -(-docs.count() // group_docs)), length)
