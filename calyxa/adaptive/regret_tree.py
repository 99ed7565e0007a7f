"""Decision trees that choose the strategy of least regret from features.

Data are rows of features and, for each strategy, a cost.  The regret of a strategy on a row is its
cost above the row's cheapest.  A split is kept only if its two sides prefer different strategies.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_single(costs: np.ndarray) -> tuple[int, float]:
    """The strategy of least total regret (the first of equals) and that regret."""
    regret = (costs - costs.min(axis=1, keepdims=True)).sum(axis=0)
    best = int(regret.argmin())
    return best, float(regret[best])


def total_regrets(df: DataFrame, costs: Sequence[Column]) -> DataFrame:
    """regret0, regret1 ...: the total regret of always choosing one strategy."""
    least = F.least(*costs)
    return df.agg(*[F.sum(c - least).alias(f"regret{i}") for i, c in enumerate(costs)])


@dataclass(frozen=True)
class Leaf:
    policy: int


@dataclass(frozen=True)
class Split:
    """Rows whose feature is below the threshold go left."""

    feature: int
    threshold: float
    left: Leaf | Split
    right: Leaf | Split


Tree = Leaf | Split


def fit(features: np.ndarray, costs: np.ndarray, depth: int, midpoint: bool = True) -> Tree:
    """The tree of at most `depth` splits in a row, chosen greedily.

    Thresholds lie midway between neighbouring values (midpoint), or at the larger one.
    """
    features, costs = np.atleast_2d(np.asarray(features, float)), np.atleast_2d(np.asarray(costs, float))
    own, regret = best_single(costs)
    if depth <= 0 or len(costs) < 2 or regret <= 0:
        return Leaf(own)
    over = costs - costs.min(axis=1, keepdims=True)
    best: tuple[float, int, float, np.ndarray] | None = None
    for j in range(features.shape[1]):
        order = np.argsort(features[:, j], kind="stable")
        x = features[order, j]
        left = np.cumsum(over[order], axis=0)
        cuts = np.flatnonzero(x[1:] > x[:-1])
        if not len(cuts):
            continue
        low, high = left[cuts], left[-1] - left[cuts]
        useful = low.argmin(axis=1) != high.argmin(axis=1)
        if not useful.any():
            continue
        total = np.where(useful, low.min(axis=1) + high.min(axis=1), np.inf)
        k = int(total.argmin())
        if best is None or total[k] < best[0]:
            a, b = x[cuts[k]], x[cuts[k] + 1]
            t = (a + b) / 2 if midpoint else b
            best = (float(total[k]), j, float(t), features[:, j] < t)
    if best is None:
        return Leaf(own)
    _, j, t, goes = best
    return Split(j, t, fit(features[goes], costs[goes], depth - 1, midpoint), fit(features[~goes], costs[~goes], depth - 1, midpoint))


def predict(tree: Tree, row) -> int:
    while isinstance(tree, Split):
        tree = tree.left if row[tree.feature] < tree.threshold else tree.right
    return tree.policy


def regret(tree: Tree, features: np.ndarray, costs: np.ndarray) -> float:
    """Total cost above the cheapest strategies when the tree chooses."""
    costs = np.asarray(costs, float)
    chosen = [predict(tree, row) for row in np.atleast_2d(features)]
    return float((costs[np.arange(len(costs)), chosen] - costs.min(axis=1)).sum())


def depth(tree: Tree) -> int:
    return 1 + max(depth(tree.left), depth(tree.right)) if isinstance(tree, Split) else 0


def is_stub(tree: Tree) -> bool:
    return isinstance(tree, Leaf)


def to_column(tree: Tree, features: list[Column]) -> Column:
    """The choice as an expression, for features that are columns."""
    if isinstance(tree, Leaf):
        return F.lit(tree.policy)
    low, high = to_column(tree.left, features), to_column(tree.right, features)
    return F.when(features[tree.feature] < tree.threshold, low).otherwise(high)


def to_json(tree: Tree, note: str = "") -> str:
    def plain(t: Tree):
        if isinstance(t, Leaf):
            return {"policy": t.policy}
        return {"feature": t.feature, "threshold": t.threshold, "left": plain(t.left), "right": plain(t.right)}

    return json.dumps({"note": note, "tree": plain(tree)})


def from_json(text: str) -> tuple[Tree, str]:
    def tree(d: dict) -> Tree:
        if "policy" in d:
            return Leaf(d["policy"])
        return Split(d["feature"], d["threshold"], tree(d["left"]), tree(d["right"]))

    spec = json.loads(text)
    return tree(spec["tree"]), spec["note"]
