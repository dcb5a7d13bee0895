"""Personal data: fixed patterns, and identifiers found through the contexts of those.

Spans of the fixed patterns are seed entities of their kind. The words around seeds are lexical
patterns; pattern and value form a graph over the whole corpus, on which confidence is passed to
and fro: a pattern is as good as the share of its occurrences that known entities take, a value
that no fixed pattern admits is as good as the patterns it stands in together. Values that reach
the threshold are reported wherever they occur, as spans of kind ``ctx_<kind>``.

Texts are scanned as UTF-8 bytes by linear-time expressions; what follows runs on Spark joins and
groupings over (pattern, value) pairs.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import batches_of_text, checkpoint, done, flag_sketch, flagged, map_arrow, mix64, shared, text_slices, word_hashes

KINDS = ("email", "ip", "card", "phone")

# The contract's patterns, in forms whose time is linear in the text: every quantifier is
# possessive where what follows cannot begin within it, and a run is entered at its first character alone.
_EMAIL = rb"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_HERE = re.compile(_EMAIL)
_EMAIL_NEXT = re.compile(rb"(?<![A-Za-z0-9._%+-])" + _EMAIL)
_IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGITS = bytes(i for i in range(256) if not 48 <= i < 58)

#: A candidate of digits: 7 to 19 of them, with up to two separators between.
_NUMBER = re.compile(rb"[0-9](?:[\x20().\-/]{0,2}+[0-9])++")
NUMBER_DIGITS = (7, 19)
#: A candidate token has an @, or letters and this many digits, and a length in these bounds.
TOKEN_DIGITS, TOKEN_LENGTH = 4, (6, 64)

#: Distinct known values a pattern needs, the share of its occurrences that must be known, the confidence that a value needs, and the rounds.
LEAST_SUPPORT, LEAST_PRECISION, LEAST_CONFIDENCE, ROUNDS = 3, 0.6, 0.7, 3

#: Between tokens: white space and marks that no identifier holds. Patterns are made of tokens alone.
_BREAKS = b"\x09\x0a\x0b\x0c\x0d:=<>\"'()[]{},;|"
_TO_SPACE = bytes(0x20 if i in _BREAKS else i for i in range(256))
_WORDLIKE = np.zeros(256, bool)
_WORDLIKE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Seeds of the hashes of a pattern's sides.
_LEFT, _AROUND, _RIGHT = (np.uint64(x) for x in (0x243F6A8885A308D3, 0x13198A2E03707345, 0xA4093822299F31D1))


def _emails(buf: bytes):
    if b"@" not in buf:
        return
    at = 0
    while m := _EMAIL_HERE.match(buf, at) or _EMAIL_NEXT.search(buf, at):
        yield m.start(), m.end()
        at = m.end()


def _luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = c - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) <= 3 and int(part or b"0") <= 255


def base_spans(buf: bytes) -> list[tuple[int, int, int]]:
    """(kind number, start, end) in bytes, by kind and then start; no span holds a line feed."""
    out = [(0, a, b) for a, b in _emails(buf)]
    out += [(1, m.start(), m.end()) for m in _IP.finditer(buf) if all(_small(p) for p in m[0].split(b"."))]
    for m in _CARD.finditer(buf):
        if m.end() - m.start() >= 16:
            digits = m[0].translate(None, _NOT_DIGITS)
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, m.start(), m.end()))
    if b"+" in buf:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(buf) if 8 <= len(m[0].translate(None, _NOT_DIGITS)) <= 15]
    return out


def _tokens(buf: bytes):
    """Hashes, starts and ends of the tokens of a buffer of joined texts, ASCII-lower-cased."""
    h, _, starts, ends, _ = word_hashes([buf.translate(_TO_SPACE)])
    return h, starts, ends


def _pair(a: np.ndarray, b: np.ndarray, seed: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b ^ seed)).view(np.int64)


def _contexts(h: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The three patterns of slots from token i to before j: two words before, one on each side, two after.

    ``h`` has two marks of an edge before and after each text, so i - 2 and j + 1 exist.
    """
    return np.stack([_pair(h[i - 2], h[i - 1], _LEFT), _pair(h[i - 1], h[j], _AROUND), _pair(h[j], h[j + 1], _RIGHT)], axis=1)


def _with_edges(h: np.ndarray, starts: np.ndarray, cuts: np.ndarray):
    """Token hashes with two edge marks before and after each text, and each token's place there."""
    place = np.arange(len(h)) + 2 * (np.searchsorted(cuts, starts, "right") + 1)
    out = np.zeros(len(h) + 2 * (len(cuts) + 1), np.uint64)
    out[place] = h
    return out, place


def _candidates(buf: bytes, starts: np.ndarray, ends: np.ndarray, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) of identifier-like strings that meet no taken span, by start, apart from each other."""
    found = []
    for m in _NUMBER.finditer(buf):
        if m.end() - m.start() >= NUMBER_DIGITS[0] and NUMBER_DIGITS[0] <= len(m[0].translate(None, _NOT_DIGITS)) <= NUMBER_DIGITS[1]:
            found.append((m.start(), m.end()))
    raw = np.frombuffer(buf, np.uint8)
    digits = np.concatenate(([0], np.cumsum(_DIGIT[raw], dtype=np.int32)))
    marks = np.concatenate(([0], np.cumsum(raw == 64, dtype=np.int32)))
    n, length = digits[ends] - digits[starts], ends - starts
    like = ((n >= TOKEN_DIGITS) & (n < length)) | (marks[ends] > marks[starts])
    like &= (length >= TOKEN_LENGTH[0]) & (length <= TOKEN_LENGTH[1])
    for k in np.flatnonzero(like):
        a, b = int(starts[k]), int(ends[k])
        while b > a and not _WORDLIKE[raw[b - 1]]:  # closing marks of the sentence
            b -= 1
        while a < b and not (_WORDLIKE[raw[a]] or raw[a] in b"@+"):
            a += 1
        if b - a >= TOKEN_LENGTH[0] and re.search(rb"[A-Za-z@\x80-\xff]", buf[a:b]):
            found.append((a, b))
    out, last, rest = [], -1, iter(sorted(taken))
    busy = next(rest, None)
    for a, b in sorted(found, key=lambda s: (s[0], -s[1])):
        while busy and busy[1] <= a:
            busy = next(rest, None)
        if a >= last and not (busy and busy[0] < b):
            out.append((a, b))
            last = b
    return out


SCANNED = (
    "doc_id long, kind array<int>, start array<long>, end array<long>, value array<string>, "
    "p0 array<long>, p1 array<long>, p2 array<long>, usable array<boolean>"
)


def _scan(ids, texts: list[bytes]) -> dict:
    """A row a text: its base spans (kind number) and candidates (kind -1), with patterns."""
    buf = b"\n".join(texts)
    cuts = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))  # where the next text starts
    h, starts, ends = _tokens(buf)
    base = base_spans(buf)
    spans = base + [(-1, a, b) for a, b in _candidates(buf, starts, ends, [s[1:] for s in base])]
    n = len(spans)
    kind = np.fromiter((s[0] for s in spans), np.int64, n)
    a, b = (np.fromiter((s[i] for s in spans), np.int64, n) for i in (1, 2))
    text_of = np.searchsorted(cuts, a, "right")
    order = np.lexsort((a, np.where(kind < 0, len(KINDS), kind), text_of))
    kind, a, b, text_of = kind[order], a[order], b[order], text_of[order]
    patterns, usable = np.zeros((n, 3), np.int64), np.zeros(n, bool)
    if n:
        raw = np.frombuffer(buf, np.uint8)
        plain = np.concatenate(([0], np.cumsum(_WORDLIKE[raw], dtype=np.int64)))
        i = np.searchsorted(ends, a, "right")  # the first token that ends after the span's start
        j = np.searchsorted(starts, b, "left")  # the first token that starts at its end or later
        within = i < j
        first, last = np.where(within, starts[np.minimum(i, len(starts) - 1)], a), np.where(within, ends[j - 1], b)
        # a span counts as a slot if its tokens hold no letter or digit beside it
        usable = within & (plain[a] == plain[np.minimum(first, a)]) & (plain[np.maximum(last, b)] == plain[b])
        edged, place = _with_edges(h, starts, cuts)
        ends_at = np.where(within, place[np.maximum(j - 1, 0)] + 1, 2)
        begins_at = np.where(within, place[np.minimum(i, len(place) - 1)], 2)
        patterns = _contexts(edged, begins_at, ends_at)
    # byte positions to code points within the text
    begin = np.concatenate(([0], cuts[:-1]))[text_of] if n else a
    if n:
        tails = np.concatenate(([0], np.cumsum((raw & 0xC0) == 0x80, dtype=np.int64)))
        start, end = a - begin - (tails[a] - tails[begin]), b - begin - (tails[b] - tails[begin])
    else:
        start, end = a, b
    offsets = pa.array(np.searchsorted(text_of, np.arange(len(texts) + 1)).astype(np.int32))
    values = pa.array([buf[x:y].lower().decode("utf-8", "replace") for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string())

    def lists(x):
        return pa.ListArray.from_arrays(offsets, x if isinstance(x, pa.Array) else pa.array(x))

    return {
        "doc_id": ids,
        "kind": lists(kind.astype(np.int32)),
        "start": lists(start),
        "end": lists(end),
        "value": lists(values),
        **{f"p{k}": lists(np.ascontiguousarray(patterns[:, k])) for k in range(3)},
        "usable": lists(usable),
    }


def scan_documents(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: base spans and candidates of its whole text (null: empty)."""

    def run(batch):
        for part in text_slices(batch):
            ids = part.column("doc_id")
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            for s in batches_of_text(texts):
                yield _scan(ids.slice(s.start, s.stop - s.start), texts[s])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCANNED)


def pattern_edges(scanned: DataFrame) -> DataFrame:
    """(pattern, value, kind, n): how often each value stands in each pattern; kind -1 for candidates."""
    each = scanned.select(F.explode(F.arrays_zip("kind", "value", "p0", "p1", "p2", "usable")).alias("s")).where("s.usable")
    each = each.select(F.col("s.value").alias("value"), F.col("s.kind").alias("kind"), F.explode(F.array("s.p0", "s.p1", "s.p2")).alias("pattern"))
    return each.groupBy("pattern", "value", "kind").agg(F.count("*").alias("n"))


def _counted(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """``patterns`` with ``total``: how often each one's words stand around any single token of ``docs``.

    A bitmap, sized from the number of patterns, only spares the exchange what cannot be one of them.
    """
    bits = max(16, min(27, (16 * max(patterns.count(), 1)).bit_length()))
    flags = shared(docs.sparkSession, flag_sketch(patterns, ["pattern"], bits))

    def count(batch):
        held = []
        for part in text_slices(batch):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column("text").to_pylist()]
            for s in batches_of_text(texts):
                buf = b"\n".join(texts[s])
                cuts = np.cumsum(np.fromiter((len(t) + 1 for t in texts[s]), np.int64, s.stop - s.start))
                h, starts, _ = _tokens(buf)
                if not len(h):
                    continue
                edged, place = _with_edges(h, starts, cuts)
                p = _contexts(edged, place, place + 1).ravel()
                held.append(p[flagged(flags.value, p)])
        if held:
            p, c = np.unique(np.concatenate(held), return_counts=True)
            yield {"pattern": p, "total": c}

    counted = map_arrow(docs.select("text"), count, "pattern long, total long").groupBy("pattern").agg(F.sum("total").alias("total"))
    out = checkpoint(patterns.join(counted, "pattern", "left").withColumn("total", F.coalesce("total", F.lit(0))))
    done(flags)
    return out


#: The first count is over one text in so many.
FIRST_SHARE = 32


def pattern_totals(docs: DataFrame, patterns: DataFrame, share: int = FIRST_SHARE) -> DataFrame:
    """(pattern, taken, total) of the patterns (pattern, taken) that can reach LEAST_PRECISION.

    ``taken`` is how often values stand in a pattern, so its precision is taken / total at most.
    A count over some of the texts never exceeds the one over all: a pattern whose part alone is
    too large is left out before all texts are counted, which changes no result.
    """
    able = F.col("taken") >= LEAST_PRECISION * F.col("total")
    some = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)
    left = _counted(some, patterns).where(able).drop("total")
    return _counted(docs, left).where(able)


def score_graph(edges: DataFrame, totals: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(value, kind, confidence) of the candidates that reach LEAST_CONFIDENCE.

    ``edges``: (pattern, value, kind, n); ``totals``: (pattern, total) of the patterns that enough
    distinct values share, without those that cannot reach LEAST_PRECISION if one likes. In each round a pattern's precision for a kind is the share of its
    occurrences that values take, each weighted by its confidence, and a candidate's confidence is
    1 - product(1 - precision) over the patterns it stands in, of those with LEAST_SUPPORT and
    LEAST_PRECISION. Seeds keep the confidence 1 for their kind. A candidate goes to its best
    kind, of equal ones to the first of KINDS.
    """
    inner = edges.join(totals.select("pattern"), "pattern", "left_semi")
    inner = checkpoint(inner)
    taken = inner.groupBy("pattern").agg(F.sum("n").alias("taken"))
    size = checkpoint(totals.join(taken, "pattern").select("pattern", F.greatest("total", "taken").alias("size")))
    seeds = inner.where("kind >= 0").select("pattern", "kind", "n", F.lit(1.0).alias("s"))
    loose = inner.where("kind < 0").select("pattern", "value", "n")
    known = None  # (value, kind, s) of candidates
    for _ in range(rounds):
        votes = seeds
        if known is not None:
            votes = votes.unionByName(loose.join(known, "value").select("pattern", "kind", "n", "s"))
        of = votes.groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("s")).alias("mass"), F.sum("s").alias("support"))
        of = of.where(F.col("support") >= LEAST_SUPPORT).join(size, "pattern")
        good = of.select("pattern", "kind", (F.col("mass") / F.col("size")).alias("r")).where(F.col("r") >= LEAST_PRECISION)
        miss = F.exp(F.sum(F.log(1.0 - F.least(F.col("r"), F.lit(0.999)))))
        known = checkpoint(loose.join(good, "pattern").groupBy("value", "kind").agg((1.0 - miss).alias("s")))
    best = W.partitionBy("value").orderBy(F.desc("s"), "kind")
    out = known.where(F.col("s") >= LEAST_CONFIDENCE).withColumn("nth", F.row_number().over(best)).where("nth = 1")
    return out.select("value", "kind", F.col("s").alias("confidence"))


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, kind, start, end): arrays of all spans of each row's text, a row for each row of ``docs``.

    Base kinds come first, in the order of KINDS, each by start; then the discovered spans, of kind
    ``ctx_<kind>`` in the same order. Positions are code points, ends exclusive. Null and empty
    texts give empty arrays; repeated rows give a row each and count as often as they occur, but a
    value counts once for a pattern's support; null ids stay null; other columns are not read.
    Candidates never meet a base span, nor each other.
    """
    docs = docs.select("doc_id", "text")
    scanned = checkpoint(scan_documents(docs)).withColumn("__row", F.monotonically_increasing_id())
    edges = checkpoint(pattern_edges(scanned))
    # a pattern without a candidate has nothing to pass on
    shared_by = edges.groupBy("pattern").agg(F.count("*").alias("values"), F.min("kind").alias("least"), F.sum("n").alias("taken"))
    patterns = checkpoint(shared_by.where((F.col("values") >= LEAST_SUPPORT) & (F.col("least") < 0)).select("pattern", "taken"))
    words = F.transform(F.filter(F.arrays_zip("kind", "start", "end"), lambda s: s["kind"] >= 0), lambda s: F.struct(s["kind"].alias("order"), s["start"].alias("start"), s["end"].alias("end")))
    base = scanned.select("__row", "doc_id", words.alias("base"))
    if not patterns.isEmpty():
        found = score_graph(edges, pattern_totals(docs, patterns).select("pattern", "total"), rounds)
        loose = scanned.select("__row", F.explode(F.arrays_zip("kind", "value", "start", "end")).alias("s")).where("s.kind < 0")
        loose = loose.select("__row", F.col("s.value").alias("value"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
        more = loose.join(found, "value").groupBy("__row").agg(
            F.array_sort(F.collect_list(F.struct((F.col("kind") + len(KINDS)).alias("order"), "start", "end"))).alias("more")
        )
        base = base.join(more, "__row", "left").withColumn("base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more")))
    names = F.array(*[F.lit(k) for k in KINDS], *[F.lit(f"ctx_{k}") for k in KINDS])
    return base.select(
        "doc_id",
        F.transform("base", lambda s: F.get(names, s["order"])).alias("kind"),
        F.transform("base", lambda s: s["start"]).alias("start"),
        F.transform("base", lambda s: s["end"]).alias("end"),
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    told = F.transform(F.arrays_zip("kind", "start", "end"), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    base = F.array_join(F.filter(F.col("told"), lambda t: ~t.startswith("ctx_")), ",")
    out = found.withColumn("told", told)

    def count(kind: str):
        return F.size(F.filter("kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    extra = F.size(F.filter("kind", lambda k: k.startswith("ctx_"))).cast("long").alias("n_discovered")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join("told", ",").alias("spans"), extra)
