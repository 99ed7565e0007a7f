"""Settings of a run, from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

import yaml

from calyxa.adaptive import manager, policies

#: Names of policies in configuration files (fixed values).
POLICIES = ("heuristic", "single_policy", "oracle_machine", "non_contextual_ucb", "cake", "cake_bs")
OPERATIONS = ("filter", "query_plan", "sort")
_SHORT = {"filter": "filter", "query_plan": "plan", "sort": "sort"}
#: Features of each operation's decisions.
_FEATURES = {"filter": 1, "query_plan": 2, "sort": 2}
_DEFAULT_SINGLE = {"filter": 0, "query_plan": 1, "sort": 0}


@dataclass(frozen=True)
class OperationConfig:
    num_features: int = 1
    num_policies: int = 2
    metric_type: str = "time"
    ucb_alpha: float = 1.0
    alpha: float = 0.5
    max_depth: int = 3
    bandwidth: float = 0.1
    n_min: float = 3
    freeze_after: int | None = None


@dataclass(frozen=True)
class Config:
    job_path: str = "."
    runtime_dir: str = "calyxa_runtime"
    cache_bytes: int = 0
    policy: str = "heuristic"
    single: dict[str, int] = field(default_factory=lambda: dict(_DEFAULT_SINGLE))
    replay_path: str | None = None
    chunk_sizes: dict[str, int] = field(default_factory=lambda: {"query_plan": 2048, "filter": 4096, "sort": 1024})
    string_sample: float = 0.2
    sort_sample: float = 0.01
    operations: dict[str, OperationConfig] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.policy not in POLICIES:
            raise ValueError(f"unknown policy {self.policy!r}; known are {', '.join(POLICIES)}")
        if self.policy == "oracle_machine" and not self.replay_path:
            raise ValueError("oracle_machine needs oracle_policies_path")
        for name, op in self.operations.items():
            if op.metric_type not in manager.METRICS:
                raise ValueError(f"{name}: {op.metric_type} can't be measured here, only {', '.join(manager.METRICS)}")
            if op.num_features != _FEATURES[name]:
                raise ValueError(f"{name} has {_FEATURES[name]} features, not {op.num_features}")

    def manager(self, learning: bool = False) -> manager.StrategyManager:
        made: dict[str, policies.Policy] = {}
        for name in OPERATIONS:
            op, short = self.operations.get(name, OperationConfig()), _SHORT[name]
            if self.policy == "single_policy":
                made[short] = policies.Single(self.single[name], op.num_policies)
            elif self.policy == "oracle_machine":
                made[short] = policies.Replay.parse(Path(self.replay_path).read_text(), short)
            elif self.policy == "non_contextual_ucb":
                made[short] = policies.LowerBound(op.num_policies, op.ucb_alpha)
            elif self.policy in ("cake", "cake_bs"):
                kind = policies.KernelPolicy if self.policy == "cake" else policies.BootstrapPolicy
                made[short] = kind(op.num_policies, op.alpha, op.bandwidth, op.n_min, op.max_depth, op.freeze_after)
        metrics = {self.operations[n].metric_type for n in self.operations} or {"time"}
        measure = manager.METRICS["cpu" if metrics == {"cpu"} else "time"]
        return manager.StrategyManager(made, learning, measure, samples={"filter": 0.01, "plan": self.string_sample, "sort": self.sort_sample})


def load(path: str | Path) -> Config:
    return parse(yaml.safe_load(Path(path).read_text()) or {})


def parse(raw: dict) -> Config:
    ops = {}
    for name in OPERATIONS:
        if name in raw:
            o = raw[name]
            cake = o.get("cake", {})
            ops[name] = OperationConfig(
                o.get("num_features", _FEATURES[name]),
                o.get("num_policies", 2),
                o.get("metric_type", "time"),
                o.get("ucb", {}).get("alpha", 1.0),
                cake.get("alpha", 0.5),
                cake.get("max_depth", 3),
                cake.get("bandwidth", 0.1),
                cake.get("n_min", 3),
                cake.get("regret_tree_after_decisions"),
            )
    single = raw.get("single_policy_config", {})
    gib = raw.get("parquet_cache_memory_budget_gb") or 0
    return Config(
        job_path=raw.get("job_path", "."),
        runtime_dir=raw.get("runtime_dir", "calyxa_runtime"),
        cache_bytes=int(max(0, gib) * 2**30),
        policy=raw.get("policy", "heuristic"),
        single={name: single.get(f"{name}_policy", _DEFAULT_SINGLE[name]) for name in OPERATIONS},
        replay_path=raw.get("oracle_policies_path"),
        chunk_sizes={"query_plan": 2048, "filter": 4096, "sort": 1024} | raw.get("chunk_sizes", {}),
        string_sample=raw.get("string_contains_feature_sample_ratio", 0.2),
        sort_sample=raw.get("sort_feature_sample_ratio", 0.01),
        operations=ops,
    )
