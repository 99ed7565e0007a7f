import random

import numpy as np
import pytest

from calyxa.llm import embedding_dedup as E
from calyxa.llm.scratch import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, t):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links = {}
    for a, (i, x) in enumerate(good):
        for b, (j, y) in enumerate(good):
            if a != b and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= t:
                links.setdefault(i, []).append(j)
    component = {i: i for i, _ in good}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            m = min(component[i], *(component[j] for j in js))
            if m < component[i]:
                component[i] = m
                changed = True
    return sorted(((i, len(links.get(i, [])), component.get(i, i)) for i, _, _ in rows), key=str)


def found(spark, rows, t=0.95):
    got = E.embedding_links(spark.createDataFrame(rows, SCHEMA), t, Scratch(spark, "e")).collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def test_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for group, (size, noise) in enumerate([(1, 0), (2, 0.02), (40, 0.02), (150, 0.015), (30, 0.05)] + [(1, 0)] * 100 + [(2, 0.03)] * 20):
        base = rng.standard_normal(32)
        base /= np.linalg.norm(base)
        for _ in range(size):
            rows.append((len(rows), (base + noise * rng.standard_normal(32)).tolist(), group))
    rows += [(5000, rows[3][1], 0), (5001, rows[3][1], 1), (5002, (np.array(rows[3][1]) * 7).tolist(), 1)]
    random.Random(1).shuffle(rows)
    got, want = found(spark, rows), brute(rows, 0.95)
    # the passes may miss a link at the threshold, never add one
    same = sum(a == b for a, b in zip(got, want, strict=True))
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True)) and same >= 0.99 * len(rows)


def test_large_components_are_completed_exactly(spark, monkeypatch):
    monkeypatch.setattr(E, "CELL", 16)
    rng = np.random.default_rng(5)
    base = rng.standard_normal(16)
    rows = [(i, (base + 0.08 * rng.standard_normal(16)).tolist(), 0) for i in range(90)]
    rows += [(100 + i, rng.standard_normal(16).tolist(), 0) for i in range(40)]
    assert found(spark, rows) == brute(rows, 0.95)


def test_single_links_within_a_crowd(spark):
    rng = np.random.default_rng(8)

    def unit(*shape):
        x = rng.standard_normal(shape)
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    n, planted, c = 6000, 400, unit(64)
    crowd = np.sqrt(0.86) * c + np.sqrt(0.14) * unit(n // 3, 64)
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    away = unit(planted, 64)
    away -= (away * crowd[:planted]).sum(1, keepdims=True) * crowd[:planted]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([crowd, 0.951 * crowd[:planted] + np.sqrt(1 - 0.951**2) * away, unit(n - n // 3 - planted, 64)])
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in E.embedding_links(df, 0.95, Scratch(spark, "e")).collect()}
    want, have = int(near.sum()), sum(got.values())
    assert all(got[i] <= near[i].sum() for i in range(n)) and want >= 2 * planted
    assert have >= (1 - 2 * E.MISS) * want, f"{have} of {want}"


def test_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, None), (2, v, 0), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [float("nan"), 1.0, 1.0], 0), (7, [float("inf"), 1.0, 1.0], 0), (8, [], 0), (9, [1.0, 2.0], 0), (None, v, 0), (10, [1e30, 2e30, 3e30], 0), (11, [1e-30, 2e-30, 3e-30], 0)]
    got = {r[0]: r for r in found(spark, rows)}
    assert got[1] == (1, 4, 1) and got[10] == (10, 4, 1) and got[11] == (11, 4, 1) and got[None] == (None, 0, None)
    assert all(got[i] == (i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9))
    assert found(spark, []) == [] and found(spark, [(1, v, 0)]) == [(1, 0, 1)]


def _unit(rng, *shape):
    x = rng.standard_normal(shape)
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def planted(n, pairs, offset, dims=64, seed=11):
    """n vectors around a common mean `offset` times as long as their spread, the last ones at cosine 0.951 to the first."""
    rng = np.random.default_rng(seed)
    x = offset * _unit(rng, dims) + _unit(rng, n - pairs, dims)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = _unit(rng, pairs, dims)
    away -= (away * x[:pairs]).sum(1, keepdims=True) * x[:pairs]
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    return np.concatenate([x, 0.951 * x[:pairs] + np.sqrt(1 - 0.951**2) * away])


@pytest.mark.parametrize("offset", [0.0, 2.0])
def test_recall_of_links_at_the_threshold(spark, offset):
    x = planted(8000, 300, offset)
    links = sum(int((x[i : i + 1000] @ x.T >= 0.95).sum()) for i in range(0, len(x), 1000)) - len(x)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    found = sum(r.n_links for r in E.embedding_links(df, 0.95, Scratch(spark, "e")).collect())
    assert links >= 600 and 0.99 * links <= found <= links, (found, links)


def test_plans():
    """Passes grow slowly with the number of vectors; few are all compared; vectors that point one way are centred."""
    plain, offset = planted(1000, 2, 0.0), planted(1000, 2, 2.0)
    sizes = [E.plan_for(n, 0.95, plain) for n in (10**4, 10**6, 10**9)]
    assert 4 < sizes[0].passes < sizes[1].passes < sizes[2].passes < 200 and sizes[0].depth < sizes[1].depth and not sizes[1].centre
    assert E.plan_for(100, 0.95, plain[:100]).passes == 1 and E.passes_for(0.9, 0) == 1
    assert list(E.plan_for(10**6, 0.95, offset).centre) == [64]
    same = E.plan_for(5000, 0.95, np.repeat(plain[:1], 1000, axis=0) + 1e-3 * plain[:1000])
    assert same.passes == 1 and same.depth == 0


@pytest.mark.parametrize("n", [3])
def test_extra_columns(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)], "x", 1) for i in range(n)], "vec_id long, embedding array<double>, v string, node int")
    assert E.embedding_links(df, 0.95, Scratch(spark, "e")).count() == n
