"""The two set joins against brute force."""

import itertools
import random
from collections import defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergelens.llm import decontam, lines, njoin, setjoin


def brute_components(rows):
    sets = defaultdict(list)
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i].append({tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = find(a), find(b)
            root[max(ra, rb)] = min(ra, rb)
    return sorted((i, len(s), find(i)) for i, ss in sets.items() for s in ss)


def brute_lines(rows, least=1):
    found = sorted((i, k, frozenset(line.encode().lower().split())) for i, t in rows if i is not None for k, line in enumerate((t or "").split("\n")))
    seen, out = [], defaultdict(list)
    for i, k, s in found:
        if len(s) < least:
            continue
        if any(100 * len(s & c) >= 80 * len(s | c) for c in seen):
            out[i].append(k)
        seen.append(s)
    return dict(out)


def test_components(docs_of, near_copies):
    got = sorted(map(tuple, njoin.jaccard_components(docs_of(near_copies)).collect()))
    assert got == brute_components(near_copies)


def test_components_with_repeated_and_null_ids(docs_of):
    a, b = " ".join("abcdefghij"), " ".join("klmnopqrst")
    rows = [(1, a), (5, a), (5, b), (7, b), (7, b), (9, "z")]
    got = sorted(map(tuple, njoin.jaccard_components(docs_of([*rows, (None, a)])).where("doc_id is not null").collect()))
    assert got == brute_components(rows)


def test_near_links_of_a_repeated_id(docs_of):
    """A document of several texts has the links of each, near ones too, in whatever order the rows come."""
    rnd = __import__("random").Random(5)
    a, b = ([f"{c}{i}" for i in range(60)] for c in "xy")
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, near(a)), (5, " ".join(a)), (5, " ".join(b)), (7, near(b)), (5, None), (8, "z")]
    for _ in range(3):
        rnd.shuffle(rows)
        got = sorted(map(tuple, njoin.jaccard_components(docs_of(rows)).collect()))
        assert got == brute_components(rows)
        assert {r[2] for r in got if r[0] != 8} == {1}


def test_second_round_and_parts(docs_of, near_copies, monkeypatch):
    """Lists count as hot from 10 postings on, so that they are dealt into parts."""
    monkeypatch.setattr(setjoin, "HOT", 10)
    test_components(docs_of, near_copies)


def test_long_lists_of_lines(docs_of, near_copies, monkeypatch):
    """Keys of several tokens, stars, and lists searched in parts."""
    monkeypatch.setattr(lines, "EXPECTED", 1)
    monkeypatch.setattr(lines, "SHORT_LIST", 6)
    monkeypatch.setattr(lines, "MOST_CANDIDATES", 2)
    monkeypatch.setattr(lines, "PART", 5)
    test_lines(docs_of, near_copies)
    words = "a b c d e f g h i j k l".split()
    chain = [" ".join(words[i:] + [f"x{j}" for j in range(i)]) for i in range(11)]
    rows = [(i, line) for i, line in enumerate(chain * 2 + [" ".join(words[:k]) for k in range(12)])]
    test_lines(docs_of, rows)


@given(st.sets(st.integers(0, 80), min_size=1), st.sets(st.integers(0, 80), max_size=5), st.sets(st.integers(0, 90), max_size=5), st.integers(0, 60), st.sampled_from([50, 80, 95]))
def test_similar_lines_share_a_key(x, drop, add, frequent, pct):
    """Whatever tokens count as frequent, in the order of rarity."""
    y = (x - drop) | add
    if x == y or 100 * len(x & y) < pct * len(x | y):
        return
    sizes = np.ones(256, np.int64)
    sizes[np.arange(256) > frequent] = 2
    sizes[np.arange(256) > frequent + 4] = 3
    sizes[np.arange(256) > frequent + 6] = 4
    sets = [np.array(sorted((t << 44) | t for t in s), np.uint64) for s in (x, y)]
    keys = [set(lines.posting_keys(s, np.zeros(1, np.int64), np.array([len(s)]), sizes, pct)[1].tolist()) for s in sets]
    assert keys[0] & keys[1]


def test_keep_one(docs_of, near_copies):
    df = docs_of(near_copies)
    kept = njoin.keep_one(df)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in brute_components(near_copies)}


def test_lines(docs_of, near_copies):
    got = {r["doc_id"]: r["removed"] for r in lines.repeated_lines(docs_of(near_copies)).collect()}
    assert got == brute_lines(near_copies)


def test_dedup_lines(docs_of):
    same = "one two three four five"
    rows = [(2, f"{same}\nshort\nrest of it\n"), (1, f"{same}\nshort\n"), (3, None), (4, ""), (None, same), (5, f"{same} six\nshort")]
    out = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(rows)).collect()}
    assert out[1]["text"] == f"{same}\nshort\n" and out[2]["text"] == "rest of it\n" and out[2]["removed_lines"] == [0, 1]
    assert out[3]["text"] is None and out[4]["text"] == "" and out[None]["text"] == same
    assert out[5]["text"] == "" and out[5]["removed_lines"] == [0, 1] and out[5]["removed"] == "x"
    longer = {r["doc_id"]: r for r in lines.dedup_lines(docs_of(rows), least=5).collect()}
    assert longer[2]["text"] == "short\nrest of it\n" and longer[5]["text"] == "short"


def test_repeated_rows_keep_their_lines(spark):
    """One occurrence within a partition and over two; similar lines at one place are not earlier ones either."""
    same = "one two three four five six"
    rows = [(1, same), (1, same), (1, f"{same} seven"), (2, f"new words for a line\n{same}")]
    make = lambda some: spark.createDataFrame(some, "doc_id long, text string").coalesce(1)
    for docs in (make(rows), make(rows[:1]).union(make(rows[1:])), make(rows[:2]).union(make(rows[2:]))):
        got = sorted((r["doc_id"], r["text"]) for r in lines.dedup_lines(docs).collect())
        assert got == [(1, same), (1, same), (1, f"{same} seven"), (2, "new words for a line")]


def test_sets_of_candidates_are_written_once(docs_of, monkeypatch):
    """Items that their likeliest candidate leaves open are compared with others, but no text is read again."""
    rnd = random.Random(3)
    rows = []
    for g in range(12):
        words = [f"w{g}x{i}" for i in range(60)]
        for c in range(8):
            own = list(words)
            for at in rnd.sample(range(60), rnd.choice([3, 4, 5])):
                own[at] = f"o{g}_{c}_{at}"
            rows.append((len(rows), " ".join(own)))
    calls = []
    for name in ("_sets_of", "_similar"):
        real = getattr(lines, name)
        monkeypatch.setattr(lines, name, lambda *args, _name=name, _real=real: calls.append(_name) or _real(*args))
    test_lines(docs_of, rows)
    assert calls.count("_similar") == 2 and calls.count("_sets_of") == 1


def test_members_of_lists_are_looked_at_once(docs_of, monkeypatch):
    """Large groups of near copies have many lists; of these a task gives each open item alone, and once."""
    monkeypatch.setattr(lines, "MOST_CANDIDATES", 2)
    rnd = random.Random(4)
    rows = []
    for g in range(3):
        words = [f"w{g}x{i}" for i in range(40)]
        for c in range(30):
            own = list(words)
            for at in rnd.sample(range(40), 2 + c % 3):
                own[at] = f"o{g}_{c}_{at}"
            rows.append((len(rows), " ".join(own)))
    seen = []
    real = lines._open_in_lists

    def open_in_lists(lists, still):
        out = real(lists, still)
        members = sum(len(r["item"]) // 8 for r in lists.select("item").collect())
        seen.append((members, out.count(), out.distinct().count(), lists.rdd.getNumPartitions()))
        return out

    monkeypatch.setattr(lines, "_open_in_lists", open_in_lists)
    test_lines(docs_of, rows)
    ((members, given_rows, items, tasks),) = seen
    assert given_rows <= items * tasks and items <= len(rows) and given_rows < members / 10


def test_lines_that_go_are_gathered_over_batches(spark):
    gone = [(d, k) for d in (-5, 3, 4, 9) for k in (0, 2, 7, d % 3)] * 2
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        got = {r["doc_id"]: r for r in lines._by_document(spark.createDataFrame(gone, "doc long, line int")).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert {d: r["removed"] for d, r in got.items()} == {d: sorted({0, 2, 7, d % 3}) for d in (-5, 3, 4, 9)}
    assert all([k for k, b in enumerate(r["mask"]) if b] == r["removed"] and len(r["mask"]) == 8 for r in got.values())


@given(st.lists(st.text("ab \n", max_size=12), min_size=1, max_size=6))
def test_only_lines_of_flagged_places_are_tokenised(texts):
    ids = np.arange(len(texts)) * 7
    places = [(i, k, line) for i, t in zip(ids.tolist(), texts, strict=True) for k, line in enumerate(t.split("\n"))]
    numbers = lines._place(np.array([p[0] for p in places]), np.array([p[1] for p in places]))
    flags = np.zeros(1 << 20, np.uint8)
    bits = 23
    wanted = [k for k in range(len(places)) if k % 3 == 0]
    for x in (int(numbers[k]) for k in wanted):
        at = (x ^ (x >> bits) ^ (x >> 2 * bits)) & ((1 << bits) - 1)
        flags[at >> 3] |= 1 << (at & 7)
    line, doc, number = lines._wanted_lines([t.encode() for t in texts], ids, flags)
    assert list(zip(doc.tolist(), number.tolist(), (b.decode() for b in line), strict=True)) == [places[k] for k in wanted]


@given(st.lists(st.sets(st.integers(0, (1 << 52) - 1), min_size=1), min_size=1, max_size=5))
def test_packed_sets(sets):
    """Sets come back by the low 40 bits of their tokens, each with its number."""
    n = np.array([len(s) for s in sets])
    tokens = np.array([t for s in sets for t in s], np.uint64)
    got, of = lines._set_tokens(lines._packed_sets(tokens, np.cumsum(n) - n, n))
    assert got.tolist() == [t & ((1 << 40) - 1) for s in sets for t in s] and of.tolist() == np.repeat(np.arange(len(n)), n).tolist()


def test_empty(docs_of):
    assert njoin.jaccard_components(docs_of([])).count() == 0
    assert lines.dedup_lines(docs_of([])).count() == 0


@given(st.sets(st.integers(0, 60), min_size=1), st.sets(st.integers(0, 60), min_size=1))
def test_filters_lose_no_pair(x, y):
    """Prefixes meet, and the parity bound holds, for every similar pair."""
    if 100 * len(x & y) < 80 * len(x | y):
        return
    px, py = (set(sorted(s)[: setjoin.prefix_length(len(s), 80)]) for s in (x, y))
    assert px & py
    assert len(x & y) >= setjoin.least_overlap(len(x) + len(y), 80)
    bits = [njoin._set_parity(np.array(sorted(s), np.uint64)) for s in (x, y)]
    assert njoin.within_parity_filter(len(x), bits[0], len(y), bits[1])


@given(st.sets(st.integers(0, 200)), st.sets(st.integers(0, 200)))
def test_suffix_bound_is_never_above_the_difference(x, y):
    a, b = (np.array(sorted(s), np.uint64) for s in (x, y))
    for depth in range(6):
        assert abs(len(x) - len(y)) <= njoin.suffix_difference(a, b, depth) <= len(x ^ y)


def test_no_pair_is_verified_twice(docs_of, monkeypatch):
    """Many pairs a little below the limit fail in the first round and stay apart."""
    rnd = random.Random(1)
    base = [[f"w{g}x{i}" for i in range(60)] for g in range(20)]
    rows = []
    for g, words in enumerate(base):
        for c in range(8):
            own = list(words)
            for at in rnd.sample(range(60), rnd.choice([1, 2, 3])):
                own[at] = f"o{g}_{c}_{at}"
            rows.append((len(rows), " ".join(own)))
    seen = []
    real = njoin._verify

    def verify(pairs, *rest):
        seen.append({(r["a"], r["b"]) for r in pairs.select("a", "b").collect()})
        return real(pairs, *rest)

    monkeypatch.setattr(njoin, "_verify", verify)
    assert sorted(map(tuple, njoin.jaccard_components(docs_of(rows)).collect())) == brute_components(rows)
    assert len(seen) == 2 and seen[0] and not seen[0] & seen[1]
    assert not {(b, a) for a, b in seen[0]} & seen[1]


def test_groups_grow_in_number_not_in_size(docs_of, monkeypatch):
    """At a fixed setting of shuffle partitions five times the rows make more groups."""
    rnd = random.Random(2)
    monkeypatch.setattr(setjoin, "GROUP", 50)
    sizes = {}
    real = setjoin._postings
    monkeypatch.setattr(setjoin, "_postings", lambda columns, counts, live, buckets: sizes.setdefault(n, buckets) and real(columns, counts, live, buckets))
    for n in (200, 1000):
        rows = [(i, " ".join(rnd.choices([f"v{j}" for j in range(5000)], k=40))) for i in range(n)]
        njoin.jaccard_components(docs_of(rows)).count()
    assert 16 < sizes[200] < 40 and 4 <= sizes[1000] / sizes[200] <= 6


def test_clashing_names_and_a_second_run(spark):
    rows = [(1, "a b c d\nx y z w"), (2, "a b c d\nq r s t"), (3, "a b c d e f g h"), (4, "a b c d e f g h")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("__doc", "__mask", "__removed", "__gone", "___gone", "removed_lines"):
        df = df.withColumn(name, F.lit(name))
    once = lines.dedup_lines(df)
    assert sorted(once.columns) == sorted(df.columns)
    got = {r["doc_id"]: r for r in once.collect()}
    assert got[2]["text"] == "q r s t" and got[2]["removed_lines"] == [0] and got[2]["__doc"] == "__doc" and got[1]["removed_lines"] == []
    again = {r["doc_id"]: r for r in lines.dedup_lines(once).collect()}
    assert {i: r["text"] for i, r in again.items()} == {i: r["text"] for i, r in got.items()} and again[2]["removed_lines"] == []
    kept = njoin.keep_one(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3]
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    left = decontam.drop_contaminated(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [1, 2]
