import random

from hypothesis import given
from hypothesis import strategies as st

from mergelens.llm import licenses

NOISE = "quiet rivers ran below seven green hills while nobody came along"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


@given(st.lists(st.sampled_from("abcdefgh"), max_size=20), st.lists(st.sampled_from("abcdefgh"), max_size=20))
def test_alignment_is_a_common_subsequence(a, b):
    pairs = licenses.patience(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x < y and z < w for (x, z), (y, w) in zip(pairs, pairs[1:], strict=False))
    assert len(pairs) <= lcs(a, b)
    if a == b:
        assert len(pairs) == len(a)


@given(st.lists(st.integers(0, 30), unique=True))
def test_longest_increasing(xs):
    best = [1] * len(xs)
    for i in range(len(xs)):
        best[i] = 1 + max((best[j] for j in range(i) if xs[j] < xs[i]), default=0)
    assert len(licenses._increasing(list(enumerate(xs)))) == max(best, default=0)


def test_finds_each_template_edited(docs_of):
    rnd = random.Random(3)
    rows = []
    for i, (_, t) in enumerate(licenses.TEMPLATES.items()):
        words = t.split()
        for j in rnd.sample(range(len(words)), len(words) // 12):
            words[j] = "Edited"
        rows.append((i, f"{NOISE} {' '.join(words)}\n{NOISE}"))
    rows += [(100, NOISE * 3000), (101, None), (102, ""), (103, "Released under\nthe  MIT license"), (103, "Released under\nthe  MIT license"), (104, "license mit the under released")]
    got = licenses.find_licenses(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, name in enumerate(licenses.TEMPLATES):
        assert name in by[i]["template"], name
        at = by[i]["template"].index(name)
        assert by[i]["coverage"][at] >= licenses.COVERAGE
        assert len(NOISE) - 1 <= by[i]["start"][at] and by[i]["end"][at] <= len(rows[i][1]) - len(NOISE)
    assert by[103]["template"] == ["MIT-line"]
    assert all(by[i]["template"] == [] for i in (100, 101, 102, 104))
    assert licenses.find_licenses(docs_of([])).count() == 0


def test_repeated_notices():
    line = licenses.TEMPLATES["MIT-line"]
    found = licenses.Scanner().scan(f"{line} {NOISE} {line}")
    assert [f[0] for f in found] == ["MIT-line"] * 2 and found[0][2] < found[1][1]


def plain_alignment(text, template):
    """Patience alignment by its definition: equal ends, then unique words of both, then the gaps between them."""
    if not text or not template:
        return 0
    if text[0] == template[0]:
        return 1 + plain_alignment(text[1:], template[1:])
    if text[-1] == template[-1]:
        return 1 + plain_alignment(text[:-1], template[:-1])
    both = [(i, template.index(w)) for i, w in enumerate(text) if text.count(w) == 1 == template.count(w)]
    chain = licenses._increasing(both)
    total, i0, j0 = len(chain), 0, 0
    for i, j in [*chain, (len(text), len(template))] if chain else []:
        total += plain_alignment(text[i0:i], template[j0:j])
        i0, j0 = i + 1, j + 1
    return total


def test_query_finds_what_a_plain_search_finds(docs_of):
    """Without the gates on words present and on counts within reach: an alignment at every word of the template."""
    rnd = random.Random(9)
    templates = {"one": "a b c d e f g", "two": "a c a b h d", "three": "k a k b", "four": "z"}
    rows = [(i, " ".join(rnd.choices("abcdefghkz.", k=rnd.randint(0, 60)))) for i in range(150)]
    rows += [(200 + i, " ".join(w for _ in range(4) for w in [*rnd.choices("xyq", k=3), *t.split()] if rnd.random() < 0.9)) for i, t in enumerate(templates.values())]
    got = {r["doc_id"]: sorted(zip(r["template"], r["start"], r["end"], r["coverage"], strict=True)) for r in licenses.find_licenses(docs_of(rows), templates).collect()}
    for doc, text in rows:
        words, want = licenses.words_of(text), []
        for name, template in templates.items():
            template = template.split()
            reach, at = int(licenses.STRETCH * len(template) + 1), 0
            while at < len(words):
                if words[at][0] in template:
                    stretch = [i for i in range(at, min(at + reach, len(words))) if words[i][0] in template]
                    cut = [w for w, *_ in words[at : stretch[-1] + 1]]
                    aligned = plain_alignment(cut, template)
                    if aligned >= licenses.COVERAGE * len(template):
                        pairs = licenses.patience(cut, template)
                        assert len(pairs) == aligned
                        want.append((name, words[at + pairs[0][0]][1], words[at + pairs[-1][0]][2], aligned / len(template)))
                        at += pairs[-1][0]
                at += 1
        assert got[doc] == sorted(want), text


def test_the_closest_of_overlapping_templates_is_chosen():
    scanner = licenses.Scanner()
    for name in ("GPL-3.0", "LGPL-3.0", "Apache-2.0", "MIT", "ISC", "BSD-disclaimer"):
        found = scanner.scan(f"{NOISE} {licenses.TEMPLATES[name]} {NOISE} {licenses.TEMPLATES['MIT-line']}")
        assert [f[0] for f, c in zip(found, scanner.chosen(found), strict=True) if c] == [name, "MIT-line"]
    both = scanner.scan(licenses.TEMPLATES["LGPL-3.0"])
    assert {f[0] for f in both} == {"GPL-3.0", "LGPL-3.0"}
    assert scanner.chosen([]) == []
