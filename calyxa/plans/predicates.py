"""Predicates as trees that compile to boolean columns.

A predicate stands for the set of rows it selects.  Null comparisons select nothing, `Not` is the
complement of a set (rows whose comparison is null are in it), `Between` leaves both
ends out, and an empty needle or list selects nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, fields, is_dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ref = str | int


def resolve(df: DataFrame, ref: Ref) -> str:
    """A column's name from its name or place."""
    if isinstance(ref, int):
        if not 0 <= ref < len(df.columns):
            raise KeyError(f"no column at {ref}; there are {len(df.columns)}")
        return df.columns[ref]
    if ref not in df.columns:
        raise KeyError(f"no column named {ref!r}; there are {', '.join(df.columns)}")
    return ref


class Predicate:
    """Base of all predicates; combine with &, | and ~."""

    def __and__(self, other: Predicate) -> Predicate:
        return And(self, other)

    def __or__(self, other: Predicate) -> Predicate:
        return Or(self, other)

    def __invert__(self) -> Predicate:
        return Not(self)

    def _column(self, col: Callable[[Ref], Column]) -> Column:
        raise NotImplementedError

    def column(self, df: DataFrame) -> Column:
        """A boolean column; null counts as false in `where`."""
        return self._column(lambda ref: F.col(f"`{resolve(df, ref)}`"))

    def children(self) -> list[Predicate]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Predicate)] if is_dataclass(self) else []

    def max_depth(self) -> int:
        """Edges on the longest way to a leaf; hints do not count."""
        below = [c.max_depth() for c in self.children()]
        if not below:
            return 0
        return max(below) + (0 if isinstance(self, Hint) else 1)


def _compare(symbol: str):
    ops: dict[str, Callable] = {
        "<": lambda c, v: c < v,
        "<=": lambda c, v: c <= v,
        ">": lambda c, v: c > v,
        ">=": lambda c, v: c >= v,
        "==": lambda c, v: c == v,
        "!=": lambda c, v: c != v,
    }
    return ops[symbol]


@dataclass(frozen=True)
class Compare(Predicate):
    """column <symbol> constant; Spark widens either side, so no literal is cut to the column's type."""

    symbol: str
    col: Ref
    value: object

    def _column(self, col):
        return _compare(self.symbol)(col(self.col), F.lit(self.value))


def LessThan(col: Ref, value) -> Compare:  # noqa: N802
    return Compare("<", col, value)


def LessOrEqual(col: Ref, value) -> Compare:  # noqa: N802
    return Compare("<=", col, value)


def GreaterThan(col: Ref, value) -> Compare:  # noqa: N802
    return Compare(">", col, value)


def GreaterOrEqual(col: Ref, value) -> Compare:  # noqa: N802
    return Compare(">=", col, value)


def Equals(col: Ref, value) -> Compare:  # noqa: N802
    return Compare("==", col, value)


def NotEquals(col: Ref, value) -> Compare:  # noqa: N802
    return Compare("!=", col, value)


@dataclass(frozen=True)
class ColumnsEqual(Predicate):
    left: Ref
    right: Ref

    def _column(self, col):
        return col(self.left) == col(self.right)


@dataclass(frozen=True)
class Between(Predicate):
    """Strictly between; both ends are left out."""

    col: Ref
    low: object
    high: object

    def _column(self, col):
        return (col(self.col) > F.lit(self.low)) & (col(self.col) < F.lit(self.high))


@dataclass(frozen=True)
class In(Predicate):
    col: Ref
    values: tuple

    def _column(self, col):
        return col(self.col).isin(list(self.values)) if self.values else F.lit(False)


@dataclass(frozen=True)
class IsNull(Predicate):
    col: Ref

    def _column(self, col):
        return col(self.col).isNull()


@dataclass(frozen=True)
class NotNull(Predicate):
    col: Ref

    def _column(self, col):
        return col(self.col).isNotNull()


@dataclass(frozen=True)
class Contains(Predicate):
    """Substring, byte for byte; an empty needle selects nothing."""

    col: Ref
    needle: str

    def _column(self, col):
        return col(self.col).contains(self.needle) if self.needle else F.lit(False)


@dataclass(frozen=True)
class Like(Predicate):
    col: Ref
    pattern: str

    def _column(self, col):
        return col(self.col).like(self.pattern)


@dataclass(frozen=True)
class All(Predicate):
    """Every row that the DataFrame still has."""

    def _column(self, col):
        return F.lit(True)


@dataclass(frozen=True)
class And(Predicate):
    left: Predicate
    right: Predicate

    def _column(self, col):
        return self.left._column(col) & self.right._column(col)


@dataclass(frozen=True)
class Or(Predicate):
    left: Predicate
    right: Predicate

    def _column(self, col):
        return self.left._column(col) | self.right._column(col)


@dataclass(frozen=True)
class Not(Predicate):
    """The complement of a set of rows.  Only here nulls are made false, so pushdown stays elsewhere."""

    inner: Predicate

    def _column(self, col):
        return ~F.coalesce(self.inner._column(col), F.lit(False))


@dataclass(frozen=True)
class Then(Predicate):
    """`second` on the rows that `first` selects; written in this order, so it is tested in this order."""

    first: Predicate
    second: Predicate

    def _column(self, col):
        return self.first._column(col) & self.second._column(col)


@dataclass(frozen=True)
class Hint(Predicate):
    """A wish how a row set be represented (`vector` or `bitmap`); Spark needs none."""

    kind: str
    inner: Predicate

    def _column(self, col):
        return self.inner._column(col)


def multi_and(predicates: Sequence[Predicate]) -> Predicate:
    """All of them, as a tree of least depth; there must be one at least."""
    if not predicates:
        raise ValueError("no predicates")
    if len(predicates) == 1:
        return predicates[0]
    half = len(predicates) // 2
    return And(multi_and(predicates[:half]), multi_and(predicates[half:]))


def conjuncts(p: Predicate) -> list[Predicate]:
    """The parts of a conjunction; a Then is one part, as its order is its meaning."""
    if isinstance(p, And):
        a, b = p.children()
        return conjuncts(a) + conjuncts(b)
    return conjuncts(p.inner) if isinstance(p, Hint) else [p]


def normal_form(p: Predicate, negated: bool = False) -> Predicate:
    """Negations pushed down to the leaves."""
    if isinstance(p, Hint):
        return Hint(p.kind, normal_form(p.inner, negated))
    if isinstance(p, Not):
        return normal_form(p.inner, not negated)
    if isinstance(p, And | Or | Then):
        a, b = (normal_form(c, negated) for c in p.children())
        if isinstance(p, Or):
            return And(a, b) if negated else Or(a, b)
        return Or(a, b) if negated else type(p)(a, b)
    if negated and isinstance(p, IsNull):
        return NotNull(p.col)
    if negated and isinstance(p, NotNull):
        return IsNull(p.col)
    return Not(p) if negated else p


def tightest_bounds(p: Predicate) -> Predicate:
    """Of upper (and of lower) bounds on one column in a conjunction, only the tightest stays; bounds come first."""
    parts = conjuncts(p)
    best: dict[tuple, Compare] = {}
    rest: list[Predicate] = []

    def key(c: Compare) -> tuple:
        # strict bounds are tighter at the same constant
        return (c.value, c.symbol == "<=") if c.symbol in ("<", "<=") else (-c.value, c.symbol == ">=")

    for c in parts:
        if isinstance(c, Compare) and c.symbol in ("<", "<=", ">", ">=") and isinstance(c.value, int | float) and not isinstance(c.value, bool):
            at = (c.col, c.symbol[0])
            if at not in best or key(c) < key(best[at]):
                best[at] = c
        else:
            rest.append(c)
    return multi_and([*best.values(), *rest])
