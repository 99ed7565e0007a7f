import itertools
import random

import pytest

from calyxa.llm.components import connected_components
from calyxa.llm.near_dedup import CONTRACT, NearDedup, near_duplicates
from calyxa.llm.scratch import Scratch

SCHEMA = "doc_id long, text string"


def shingles(text, k):
    w = text.encode().lower().split() if text else []
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def brute(rows, p):
    """(doc_id, text) -> set of (doc_id, n, component) by comparing all pairs."""
    sets = [shingles(t, p.words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and rows[i][0] is not None and rows[j][0] is not None and len(a & b) * p.den >= len(a | b) * p.num:
            root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), None if d is None else min(ids)))
    return sorted(out, key=str)


def found(spark, rows, p):
    df = near_duplicates(spark.createDataFrame(rows, SCHEMA), p, Scratch(spark, "t"))
    got = df.collect()
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str)


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(4)}"
    return " ".join(words)


@pytest.mark.parametrize("p", [CONTRACT, NearDedup()])
def test_chains_and_families_equal_brute_force(spark, p):
    rng = random.Random(3)
    rows = []
    for family in range(4):
        base = [f"f{family}x{i}" for i in range(120)]
        rows += [(len(rows) + k, edited(rng, base, rng.randrange(8))) for k in range(25)]
        # a chain, each link a copy of the one before with few changes; the ends are far apart
        text = base
        for _ in range(12):
            text = edited(rng, text, 3).split()
            rows.append((len(rows), " ".join(text)))
    rows += [(1000 + i, f"alone {i} text") for i in range(5)] + [(2000, "alone 0 text"), (2001, "ALONE 0\ttext")]
    assert found(spark, rows, p) == brute(rows, p)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "one two"), (7, "one two three"), (7, "one two three"), (None, "one"), (None, None), (8, "x " * 50_000)]
    assert found(spark, rows, CONTRACT) == brute(rows, CONTRACT)


def test_empty(spark):
    assert found(spark, [], CONTRACT) == []


def test_extra_columns_do_not_matter(spark):
    df = spark.createDataFrame([(1, "a b c", 5, "x"), (2, "a b c", 6, "y")], "doc_id long, text string, n long, node string")
    assert sorted(r.component_id for r in near_duplicates(df, CONTRACT, Scratch(spark, "t")).collect()) == [1, 1]


def test_large_group_of_copies(spark):
    rows = [(i, "the same text every time it is said here") for i in range(3000)] + [(i, f"other {i} words and so on") for i in range(3000, 3050)]
    got = found(spark, rows, CONTRACT)
    assert sum(c == 0 for _, _, c in got) == 3000


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)] + [(100, i) for i in range(101, 120)] + [(49, 100)]])
def test_components(spark, edges):
    rng = random.Random(1)
    names = {x: rng.randrange(10**6) for e in edges for x in e}
    links = [(names[a], names[b]) for a, b in edges]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "c"), "cc").collect()}
    want = {}
    for a, b in links:
        if a != b:
            group = {a, b} | {k for k, v in want.items() if v in (want.get(a), want.get(b)) and v is not None}
            for k in group:
                want[k] = min(group)
    assert got == {k: min(x for x, v in want.items() if v == want[k]) for k in want}
