"""Runs a decision: features, choice, run, and now and then all strategies to learn from."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from calyxa.adaptive.policies import Heuristic, Policy

#: Heuristics when nothing is known: filters in the plan, where they are pushed down; numbers before needles; one global sort.
DEFAULT_RULES: dict[str, Callable[[Sequence[float]], int]] = {
    "filter": lambda f: 0,
    "plan": lambda f: 1,
    "sort": lambda f: 0,
}


def timed(df: DataFrame) -> float:
    """Seconds to compute a DataFrame in full, its rows thrown away."""
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def cpu_timed(df: DataFrame) -> float:
    """Seconds of executor CPU to compute a DataFrame in full, its rows thrown away."""
    sc, group = df.sparkSession.sparkContext, f"calyxa-{uuid.uuid4().hex}"
    sc.setJobGroup(group, "measured")
    try:
        df.write.format("noop").mode("overwrite").save()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    scala = sc._jsc.sc()
    scala.listenerBus().waitUntilEmpty(30_000)
    tracker, store = sc.statusTracker(), scala.statusStore()
    stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    return sum(store.lastStageAttempt(s).executorCpuTime() for s in stages) / 1e9


#: What a strategy costs, by the name of the metric.
METRICS: dict[str, Callable[[DataFrame], float]] = {"time": timed, "cpu": cpu_timed}


@dataclass
class Decision:
    operation: str
    features: tuple[float, ...]
    strategies: Sequence[Callable[[], DataFrame]]


@dataclass
class StrategyManager:
    """Policies by operation.  Nothing is measured unless `learning`, so results stay lazy."""

    policies: dict[str, Policy] = field(default_factory=dict)
    learning: bool = False
    measure: Callable[[DataFrame], float] = timed
    log: list[tuple[str, int]] = field(default_factory=list)
    #: Shares of rows that features are taken from: of filters, of texts, of sorts.
    samples: dict[str, float] = field(default_factory=lambda: {"filter": 0.01, "plan": 0.2, "sort": 0.01})

    def __post_init__(self) -> None:
        self._lock = threading.Lock()

    def run(self, d: Decision) -> DataFrame:
        with self._lock:
            policy = self.policies.get(d.operation) or Heuristic(DEFAULT_RULES[d.operation])
            chosen = policy.choose(d.features)
            if chosen is None:
                chosen = DEFAULT_RULES[d.operation](d.features)
            self.log.append((d.operation, chosen))
            df = d.strategies[chosen]()
            if self.learning and policy.learn(d.features, chosen, self.measure(df)):
                policy.learn_all(d.features, [self.measure(s()) for s in d.strategies])
            return df

    def end_of_epoch(self) -> None:
        for p in self.policies.values():
            p.end_of_epoch()
