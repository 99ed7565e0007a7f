"""Inner equi-joins with the naming of the engine, join chains, and membership filters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calyxa.functions.scalar import HASHED, mix_hash
from calyxa.plans.predicates import Ref, resolve
from calyxa.sources.scratch import free_name


def prefixed(df: DataFrame, table: str) -> DataFrame:
    """Columns renamed to table_column."""
    return df.toDF(*[f"{table}_{c}" for c in df.columns])


def hash_join(
    build: DataFrame,
    probe: DataFrame,
    build_keys: Sequence[Ref],
    probe_keys: Sequence[Ref] | None = None,
    build_name: str | None = None,
    probe_name: str | None = None,
) -> DataFrame:
    """Inner equi-join; build columns come first, both sides renamed to table_column if named.

    Without probe_keys the first columns of the probe side are its keys.  Null keys match
    nothing.  Which side is broadcast, and whether any is, is left to the size that Spark sees.
    """
    probe_keys = list(range(len(build_keys))) if probe_keys is None else list(probe_keys)
    if len(build_keys) != len(probe_keys) or not build_keys:
        raise ValueError("both sides need the same number of keys, one at least")
    left = [resolve(build, k) for k in build_keys]
    right = [resolve(probe, k) for k in probe_keys]
    b = prefixed(build, build_name) if build_name else build
    p = prefixed(probe, probe_name) if probe_name else probe
    left = [f"{build_name}_{k}" if build_name else k for k in left]
    right = [f"{probe_name}_{k}" if probe_name else k for k in right]
    twice = set(b.columns) & set(p.columns)
    if twice:
        raise ValueError(f"both sides have {', '.join(sorted(twice))}; name the tables")
    on = [F.col(f"`{x}`") == F.col(f"`{y}`") for x, y in zip(left, right, strict=True)]
    return b.join(p, on, "inner").select(*[f"`{c}`" for c in [*b.columns, *p.columns]])


@dataclass(frozen=True)
class JoinStep:
    """Join the result so far (its left_keys) with another table (its right_keys)."""

    right: str
    left_keys: tuple[Ref, ...]
    right_keys: tuple[Ref, ...]


def multi_join(tables: dict[str, DataFrame], first: str, steps: Sequence[JoinStep]) -> DataFrame:
    """A left-deep chain; columns are table_column, those of later tables first, as built.

    A step's left keys name columns of the result so far, or places in it.
    """
    done = prefixed(tables[first], first)
    for s in steps:
        if s.right not in tables:
            return done.limit(0)
        right = prefixed(tables[s.right], s.right)
        keys = [resolve(tables[s.right], k) for k in s.right_keys]
        on = [F.col(f"`{s.right}_{r}`") == F.col(f"`{resolve(done, k)}`") for r, k in zip(keys, s.left_keys, strict=True)]
        columns = [*right.columns, *done.columns]
        done = right.join(done, on, "inner").select(*[f"`{c}`" for c in columns])
    return done


def member_of(df: DataFrame, column: Ref, keys: DataFrame, key: Ref = 0) -> DataFrame:
    """Rows whose value occurs among the keys: exact, each row once; nulls are in nothing."""
    name = resolve(df, column)
    member = free_name("__member", df)
    wanted = keys.select(F.col(f"`{resolve(keys, key)}`").alias(member))
    return df.join(wanted, F.col(f"`{name}`") == F.col(member), "left_semi")


def chain_lengths(df: DataFrame, key: Ref, buckets: int) -> DataFrame:
    """bucket, chain_len: rows of each bucket of the key's hash modulo the number of buckets; any type has a hash."""
    name = resolve(df, key)
    value, kind = F.col(f"`{name}`"), dict(df.dtypes)[name]
    hashed = mix_hash(value, kind) if kind in HASHED else F.xxhash64(value)
    return df.groupBy(F.pmod(hashed, F.lit(buckets)).cast("long").alias("bucket")).agg(F.count(F.lit(1)).alias("chain_len"))
