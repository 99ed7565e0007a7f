"""Ways to intersect two selections, and a tree that chooses among them from measured times."""

from __future__ import annotations

import platform
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.adaptive import regret_tree
from calyxa.adaptive.manager import timed
from calyxa.adaptive.strategies import intersection_features

IDX = "idx"


def _semi(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.join(b, IDX, "left_semi")


def _set(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def _counted(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).groupBy(IDX).agg(F.count(F.lit(1)).alias("n")).where("n = 2").select(IDX)


#: All give the positions that both selections (of distinct positions) hold.
STRATEGIES: tuple[Callable[[DataFrame, DataFrame], DataFrame], ...] = (_semi, _set, _counted)


def cpu_brand() -> str:
    return platform.processor() or platform.machine()


class Intersector:
    """Chooses by a tree; without one always the semi join."""

    def __init__(self, tree: regret_tree.Tree | None = None):
        self.tree = tree or regret_tree.Leaf(0)

    def intersect(self, a: DataFrame, b: DataFrame) -> DataFrame:
        chosen = 0
        if not regret_tree.is_stub(self.tree):
            f = intersection_features(a, b).first()
            chosen = regret_tree.predict(self.tree, (f["len_ratio"] or 0.0, f["overlap"] or 0.0))
        elif isinstance(self.tree, regret_tree.Leaf):
            chosen = self.tree.policy
        return STRATEGIES[chosen](a, b)


def train(
    spark: SparkSession,
    sizes: Sequence[int] = (10, 1_000, 100_000),
    whole: int = 100_000,
    repeats: int = 3,
    max_depth: int = 7,
    measure: Callable[[DataFrame], float] = timed,
    seed: int = 0,
) -> str:
    """A tree as JSON, with the CPU it was measured on: of depths up to max_depth that of least held-out regret."""
    rng, x, y = np.random.default_rng(seed), [], []
    all_rows = spark.range(whole).toDF(IDX)
    for _ in range(repeats):
        for size in sizes:
            span = int(rng.integers(1, whole + 1))
            some = spark.createDataFrame([(int(i),) for i in np.unique(rng.integers(0, span, size))], f"{IDX} long")
            f = intersection_features(all_rows, some).first()
            x.append((f["len_ratio"] or 0.0, f["overlap"] or 0.0))
            y.append([measure(s(all_rows, some)) for s in STRATEGIES])
    features, costs = np.array(x), np.array(y)
    order = rng.permutation(len(x))
    cut = max(1, len(x) * 3 // 4)
    fitted, held = order[:cut], order[cut:] if cut < len(x) else order
    trees = [regret_tree.fit(features[fitted], costs[fitted], d) for d in range(1, max_depth + 1)]
    best = min(trees, key=lambda t: regret_tree.regret(t, features[held], costs[held]))
    return regret_tree.to_json(best, cpu_brand())


def load_or_train(spark: SparkSession, text: str | None, **kwargs) -> tuple[Intersector, str]:
    """The intersector of a stored tree; trained anew if there is none or it is of another CPU."""
    if text is not None:
        tree, brand = regret_tree.from_json(text)
        if brand == cpu_brand():
            return Intersector(tree), text
    text = train(spark, **kwargs)
    return Intersector(regret_tree.from_json(text)[0]), text
