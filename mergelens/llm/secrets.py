"""Secret scan: fixed patterns plus guess-cost analysis of values in credential contexts.

A value next to a word such as ``password`` or ``pin`` is segmented into words of a fixed list
and of the corpus itself, dates, repeats, keyboard walks and brute-force spans so that the product of the segments'
guess counts (times the orderings of the segments) is least. A value that takes many guesses is
no placeholder, so it is reported as a span of kind ``guess``.
"""

from __future__ import annotations

import hashlib
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, map_arrow, shared, text_slices

KINDS = ("assign", "access", "hex", "guess")

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A wider set of words that announce a credential, with values of any printable characters.
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api_?key|credential|login|pin)["']?\x20*(?::|=|\x20is\x20)\x20*["']?([^\s"'<>]{6,})""",
    re.IGNORECASE | re.ASCII,
)
_HINTS = ("pass", "pwd", "secret", "token", "apikey", "api_key", "credential", "login", "pin")

# Words often found in passwords and placeholders, most frequent first.
COMMON_WORDS = (
    "password", "secret", "token", "example", "changeme", "admin", "root", "user", "test", "demo",
    "welcome", "letmein", "login", "hello", "dragon", "monkey", "master", "shadow", "sunshine",
    "princess", "football", "baseball", "superman", "batman", "iloveyou", "love", "qwerty", "abc",
    "pass", "default", "public", "private", "temp", "guest", "server", "database", "key", "value",
    "placeholder", "sample", "your", "my", "the", "here", "none", "null", "true", "false", "summer",
    "winter", "spring", "autumn", "monday", "friday", "january", "december", "computer", "internet",
    "company", "office", "network", "system", "access", "redacted", "xxxx", "insert",
)
# Rows of a US keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")

_RANK = {w: i + 1 for i, w in enumerate(COMMON_WORDS)}
_LONGEST = max(map(len, COMMON_WORDS))
_NEXT = {(r[i], r[i + d]) for r in KEY_ROWS for i in range(len(r)) for d in (-1, 1) if 0 <= i + d < len(r)}
_DATE = re.compile(
    r"(?:19|20)\d\d[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:0[1-9]|[12]\d|3[01])"
    r"|(?:0[1-9]|[12]\d|3[01])[-/.]?(?:0[1-9]|1[0-2])[-/.]?(?:19|20)\d\d|(?:19|20)\d\d"
)
_DATE_LENGTHS = (4, 8, 9, 10)
#: log10 of guesses from which a value counts as a secret.
STRONG = 10.0


#: Words of the corpus that count as guessable: the most frequent ones, of these lengths, that occur so often.
DICTIONARY, WORD_LENGTH, LEAST_COUNT = 30_000, (3, 24), 3


def _brute(ch: str) -> float:
    size = 10 if ch.isdigit() else 26 if ch.islower() or ch.isupper() else 33
    return math.log10(size)


def _repeats(value: str, size: int) -> list[int]:
    """How often the block of ``size`` characters that starts at each place follows itself, itself included."""
    n = len(value)
    run = [0] * (n + 1)  # characters from here on that equal those a block later
    for i in range(n - size - 1, -1, -1):
        run[i] = run[i + 1] + 1 if value[i] == value[i + size] else 0
    return [1 + r // size for r in run]


def _walks(low: str) -> list[int]:
    """The end of the keyboard walk that each place lies in."""
    ends = [len(low)] * len(low)
    for i in range(len(low) - 2, -1, -1):
        ends[i] = ends[i + 1] if (low[i], low[i + 1]) in _NEXT else i + 1
    return ends


def _least_times(size: int) -> int:
    return 3 if size < 3 else 2


class _Growing:
    """Segments that may end at any of many places and cost log10 of their length more.

    Of two starts the later, if it is dearer once, stays dearer; so the open starts are a stack in
    which prices rise, cut behind the cheapest.
    """

    def __init__(self) -> None:
        self.starts: list[int] = []

    def step(self, j: int, new: int | None, row: list[float], end_of, unit: int) -> float:
        """The cheapest start's price at j, with ``new`` as one more start; inf if none reaches j."""
        starts = self.starts
        if starts and end_of(starts[-1]) < j:
            starts.clear()
        if new is not None and row[new] < math.inf:
            while starts and row[starts[-1]] >= row[new]:
                starts.pop()
            starts.append(new)
        if not starts:
            return math.inf
        costs = [row[i] + math.log10((j - i) // unit) for i in starts]
        cheapest = min(costs)
        del starts[costs.index(cheapest) + 1 :]
        return cheapest


def guess_cost(value: str, enough: float = math.inf, ranks: dict[str, int] = _RANK) -> float:
    """log10 of the guesses of the cheapest segmentation of ``value``; 0 for an empty value.

    ``ranks`` gives dictionary words (lower case) and how many words are guessed before and with
    each; longer ones than WORD_LENGTH are not found. A row of the table holds the least sum for the first i characters in k segments; k
    segments can be tried in k! orders. Rows end when k! alone exceeds the best cost, or
    ``enough``: then the result may be above the least cost, but neither is below ``enough``. All
    words, dates, walks and repeats of every admissible length take part; the whole value is
    looked at, in memory linear in its length.
    """
    n, low = len(value), value.lower()
    if not n:
        return 0.0
    if len(low) != n:  # lower-casing can lengthen rare letters
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    longest = max(_LONGEST, WORD_LENGTH[1])
    found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]  # by end: (start, cost) of words and dates
    for i in range(n):
        for j in range(i + 2, min(n, i + longest) + 1):
            rank = ranks.get(low[i:j])
            if rank:
                variants = 1 if value[i:j] == low[i:j] else 2 if value[i:j].istitle() or value[i:j].isupper() else 2 ** min(j - i, 20)
                found[j].append((i, math.log10(rank * variants + 1)))
        if value[i].isdigit():
            for length in _DATE_LENGTHS:
                if i + length <= n and _DATE.fullmatch(value, i, i + length):
                    found[i + length].append((i, math.log10(365 * 200) if length > 4 else math.log10(200)))
    single = [_brute(c) for c in value]
    upto = [0.0]
    for c in single:
        upto.append(upto[-1] + c)
    walk, step = _walks(low), math.log10(len(_NEXT))
    repeats = {size: _repeats(value, size) for size in (1, 2, 3, 4) if any(t >= _least_times(size) for t in _repeats(value, size)[:n])}
    best, orders = math.inf, 0.0
    row = [0.0] + [math.inf] * n
    for k in range(1, n + 1):
        orders += math.log10(k)
        if orders >= min(best, enough):
            return min(best, orders)
        nxt, run = [math.inf] * (n + 1), math.inf  # run: least row[i] - upto[i] so far
        walking = _Growing()
        repeating = {(size, phase): _Growing() for size in repeats for phase in range(size)}
        for j in range(1, n + 1):
            run = min(run, row[j - 1] - upto[j - 1])
            least = run + upto[j]
            for i, cost in found[j]:
                least = min(least, row[i] + cost)
            new = j - 3 if j >= 3 and walk[j - 3] >= j else None
            least = min(least, step + walking.step(j, new, row, lambda i: walk[i], 1))
            for size, times in repeats.items():
                i = j - size * _least_times(size)
                new = i if i >= 0 and times[i] >= _least_times(size) else None
                of = repeating[size, j % size].step(j, new, row, lambda i, s=size, t=times: i + s * t[i], size)
                if of < math.inf:  # the last block is the repeated one
                    least = min(least, of + upto[j] - upto[j - size])
            nxt[j] = least
        best = min(best, nxt[n] + orders)
        row = nxt
    return best


def frequent_words(docs: DataFrame, most: int = DICTIONARY) -> dict[str, int]:
    """The corpus's most frequent words with their ranks, over all texts; ties by the word.

    Values in credential contexts are taken out first, so a secret does not make itself a word.
    Words are taken by classes of counts (an eighth of a doubling wide) from the highest on, as
    many classes as have ``most`` words at most: that is what the driver gets, whatever the number of tasks.
    """
    context = F.regexp_replace("text", f"(?i){CONTEXT.pattern}", " ")
    words = docs.select(F.explode(F.regexp_extract_all(F.lower(context), F.lit(r"(\p{L}+)"), 1)).alias("word"))
    counts = words.where(F.length("word").between(*WORD_LENGTH)).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)
    counts = checkpoint(counts.withColumn("class", F.floor(F.log2("n") * 8)))
    least, held = None, 0
    for r in counts.groupBy("class").agg(F.count("*").alias("words")).orderBy(F.desc("class")).collect():
        held += r["words"]
        if held > most:
            break
        least = r["class"]
    if least is None:
        return {}
    kept = counts.where(F.col("class") >= least).select("word", "n").collect()
    return {r["word"]: i + 1 for i, r in enumerate(sorted(kept, key=lambda r: (-r["n"], r["word"])))}


def scan_text(text: str, ranks: dict[str, int] = _RANK) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by start and then kind."""
    spans: list[tuple[str, int, int]] = []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= 12:
                spans.append(("assign", m.start(), m.end()))
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if hinted:
        for m in CONTEXT.finditer(text):
            if guess_cost(m[1], STRONG, ranks) >= STRONG:
                spans.append(("guess", m.start(1), m.end(1)))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


SCANNED = "doc_id long, kind array<string>, start array<long>, end array<long>"


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start, end) with arrays of all spans of each whole text.

    Words that are guessable are those of COMMON_WORDS and the frequent ones of ``docs``, each by
    its better rank. Null and empty texts give empty arrays; repeated rows give a row each.
    Positions are code points, ends exclusive.
    """
    ranks = dict(_RANK)
    for word, rank in frequent_words(docs).items():
        ranks[word] = min(rank, ranks.get(word, rank))
    sent = shared(docs.sparkSession, ranks)

    def scan(batch):
        found = [scan_text(t or "", sent.value) for t in batch.column("text").to_pylist()]
        yield {
            "doc_id": batch.column("doc_id"),
            "kind": [[s[0] for s in f] for f in found],
            "start": [[s[1] for s in f] for f in found],
            "end": [[s[2] for s in f] for f in found],
        }

    def run(batch):
        for part in text_slices(batch):
            yield from scan(part)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCANNED)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, a hash of the base spans, and all spans as text."""
    at = F.transform(
        F.arrays_zip("kind", "start", "end"),
        lambda s: F.struct(s["kind"].alias("k"), F.concat_ws(":", s["kind"], s["start"], s["end"]).alias("t")),
    )
    base = F.filter("at", lambda s: s["k"] != "guess")

    def count(kind: str):
        return F.size(F.filter("kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}")

    return found.withColumn("at", at).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(F.array_join(F.transform(base, lambda s: s["t"]), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("at", lambda s: s["t"]), ",").alias("spans"),
        count("guess"),
    )


def base_digest(text: str) -> str:
    """The base spans' hash of one text, for checks."""
    spans = [s for s in scan_text(text) if s[0] != "guess"]
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
