"""Pipeline queries: their operations, their JSON-lines form, and their compilation to a DataFrame."""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import ClassVar, TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.adaptive import strategies
from calyxa.plans import predicates as P
from calyxa.sources.parquet import POS, load, load_with_position
from calyxa.sources.scratch import free_name


class Op:
    """One step; `type` names it in JSON."""

    registry: ClassVar[dict[str, type[Op]]] = {}

    def __init_subclass__(cls) -> None:
        Op.registry[cls.__name__] = cls

    def predicate(self) -> P.Predicate | None:
        return None


@dataclass(frozen=True)
class LoadParquet(Op):
    file: str


@dataclass(frozen=True)
class _ColVal(Op):
    col: str
    val: int
    symbol: ClassVar[str] = ""

    def predicate(self):
        return P.Compare(self.symbol, self.col, self.val)


class LessThan(_ColVal):
    symbol = "<"


class LessThanOrEqual(_ColVal):
    symbol = "<="


class GreaterThan(_ColVal):
    symbol = ">"


class GreaterThanOrEqual(_ColVal):
    symbol = ">="


class Equals(_ColVal):
    symbol = "=="


class NotEquals(_ColVal):
    symbol = "!="


@dataclass(frozen=True)
class Between(Op):
    col: str
    low: int
    high: int

    def predicate(self):
        return P.Between(self.col, self.low, self.high)


@dataclass(frozen=True)
class NotNull(Op):
    col: str

    def predicate(self):
        return P.NotNull(self.col)


@dataclass(frozen=True)
class IsNull(Op):
    col: str

    def predicate(self):
        return P.IsNull(self.col)


@dataclass(frozen=True)
class In(Op):
    col: str
    vals: tuple[int, ...]

    def predicate(self):
        return P.In(self.col, tuple(self.vals))


@dataclass(frozen=True)
class StringContains(Op):
    col: str
    term: str

    def predicate(self):
        return P.Contains(self.col, self.term)


@dataclass(frozen=True)
class SmartStringOnTop(Op):
    """Numbers below a bound and a needle in a text; which is tested first is a strategy."""

    string_col: str
    search_term: str
    filter_col: str
    filter_val: int

    def predicate(self):
        return P.Then(P.LessThan(self.filter_col, self.filter_val), P.Contains(self.string_col, self.search_term))


@dataclass(frozen=True)
class SelectColumns(Op):
    cols: tuple[str, ...]


@dataclass(frozen=True)
class SortBy(Op):
    col: str
    direction: str = "Ascending"

    def __post_init__(self) -> None:
        if self.direction not in ("Ascending", "Descending"):
            raise ValueError(f"direction must be Ascending or Descending, not {self.direction!r}")


@dataclass(frozen=True)
class FilterTop(Op):
    n: int


@dataclass(frozen=True)
class And(Op):
    """Filters already conjoin."""


@dataclass(frozen=True)
class Or(Op):
    """The filter before it or the filter behind it."""


@dataclass(frozen=True)
class SetSelection(Op):
    """Rows at these positions; for use in code, it has no JSON form."""

    rows: tuple[int, ...] | DataFrame


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[Op, ...] = field(default_factory=tuple)


def op_to_json(op: Op) -> dict:
    if isinstance(op, SetSelection):
        raise ValueError("SetSelection has no JSON form")
    return {"type": type(op).__name__} | {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(op).items()}


def op_from_json(spec: dict) -> Op:
    kind = spec.get("type")
    if kind not in Op.registry or kind.startswith("_") or kind == "SetSelection":
        raise ValueError(f"unknown operation {kind!r}")
    args = {k: tuple(v) if isinstance(v, list) else v for k, v in spec.items() if k != "type"}
    try:
        return Op.registry[kind](**args)
    except TypeError as e:
        raise ValueError(f"{kind}: {e}") from None


def query_to_json(query: Query) -> str:
    return json.dumps({"name": query.name, "ops": [op_to_json(op) for op in query.ops]}, ensure_ascii=False)


def query_from_json(line: str) -> Query:
    spec = json.loads(line)
    return Query(spec["name"], tuple(op_from_json(x) for x in spec["ops"]))


def read_queries(lines: Iterable[str] | str | Path) -> Iterator[Query]:
    """Queries of a JSON-lines file or of lines; blank lines and those that begin with # are skipped."""
    if isinstance(lines, str | Path):
        lines = Path(lines).read_text(encoding="utf-8").splitlines()
    for number, line in enumerate(lines, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        try:
            yield query_from_json(line)
        except (ValueError, KeyError) as e:
            raise ValueError(f"line {number}: {e}") from e


def write_query(out: TextIO, query: Query) -> None:
    out.write(query_to_json(query) + "\n")


#: What may be sorted by in a pipeline query; other types are refused.
_SORTABLE = ("int", "bigint", "smallint", "tinyint", "decimal", "float", "double")


def _folded(ops: tuple[Op, ...]) -> list[Op | P.Predicate]:
    """Ops with filters as predicates, `And` left out and `Or` folded into its two neighbours."""
    out: list[Op | P.Predicate] = []
    waiting = False
    for op in ops:
        if isinstance(op, And):
            continue
        if isinstance(op, Or):
            if not out or not isinstance(out[-1], P.Predicate) or waiting:
                raise NotImplementedError("Or needs a filter on either side")
            waiting = True
            continue
        p = op.predicate()
        if waiting:
            if p is None:
                raise NotImplementedError("Or needs a filter on either side")
            out[-1] = P.Or(out[-1], p)
            waiting = False
        else:
            out.append(op if p is None else p)
    if waiting:
        raise NotImplementedError("Or needs a filter on either side")
    return out


#: What needs the positions of rows.
_BY_POSITION = (SortBy, FilterTop, SetSelection)


def _use_of_positions(ops: Sequence[Op | P.Predicate]) -> tuple[bool, int | None]:
    """For the ops behind a load: whether they need positions, and the number of first rows if these are all they see."""
    mine = list(itertools.takewhile(lambda op: not isinstance(op, LoadParquet), ops))
    ahead = list(itertools.dropwhile(lambda op: isinstance(op, SelectColumns), mine))
    return any(isinstance(op, _BY_POSITION) for op in mine), ahead[0].n if ahead and isinstance(ahead[0], FilterTop) else None


def _loaded(spark: SparkSession, path: str, positions: bool, first: int | None) -> DataFrame:
    return load_with_position(spark, path, first) if positions else load(spark, path)


def _decided(df: DataFrame, p: P.Predicate, visible: DataFrame, manager, sample: float | None) -> DataFrame:
    """The filter by the strategy that the manager chooses, from features of a sample of rows."""
    needle = isinstance(p, P.Then) and isinstance(p.second, P.Contains)
    some = df.sample(fraction=sample or manager.samples["plan" if needle else "filter"], seed=1)
    if isinstance(p, P.Then) and isinstance(p.second, P.Contains):
        number, needle = p.first.column(visible), p.second.column(visible)
        text = F.col(f"`{P.resolve(visible, p.second.col)}`")
        hit, length = some.agg(F.avg(F.when(number, 1.0).otherwise(0.0)), F.avg(F.octet_length(text))).first()
        share = 1 / (1 + len(p.second.needle.encode()) / (length or 1.0))
        return manager.run(strategies.needle_strategies(df, number, needle, hit or 0.0, share))
    condition = p.column(visible)
    hit = some.agg(F.avg(F.when(condition, 1.0).otherwise(0.0))).first()[0]
    return manager.run(strategies.filter_strategies(df, condition, hit or 0.0))


def compile_query(
    spark: SparkSession, job_path: str, query: Query, nulls: str = "zero", loader=None, manager=None, sample: float | None = None, partitions: int | None = None
) -> DataFrame:
    """The query as a lazy DataFrame.

    With a manager, each filter asks it for a strategy, from features of a sample of the
    rows; that takes a job for each filter, so it is off by default.

    Sorts are stable by position and, with nulls="zero", order nulls as 0; with
    nulls="first" as Spark does.  FilterTop takes the first rows of the current order: a
    sort directly before it makes one top-k of both.

    Positions are made only if an operation needs them, and then no more than FilterTop asks for.
    loader(path, positions, first) loads a table in another way; with partitions, rows are dealt
    to so many tasks after loading.
    """
    if nulls not in ("zero", "first"):
        raise ValueError(f"nulls must be zero or first, not {nulls!r}")
    loader = loader or (lambda path, positions, first: _loaded(spark, path, positions, first))
    df: DataFrame | None = None
    order: list | None = None
    hidden: dict[str, str] = {}
    shown: list[str] = []
    ops = _folded(query.ops)
    whole = False
    for k, op in enumerate(ops):
        if isinstance(op, LoadParquet):
            positions, first = _use_of_positions(ops[k + 1 :])
            df = loader(f"{job_path.rstrip('/')}/{op.file}", positions, first)
            df = df.repartition(partitions) if partitions else df
            order, hidden, shown, whole = None, {}, [c for c in df.columns if c != POS], True
            continue
        if df is None:
            raise ValueError("the first operation must be LoadParquet")
        visible = df.select(*[f"`{c}`" for c in shown])
        if isinstance(op, P.Predicate):
            p = P.tightest_bounds(P.normal_form(op)) if not isinstance(op, P.Then) else op
            df = df.where(p.column(visible)) if manager is None else _decided(df, p, visible, manager, sample)
            whole = False
        elif isinstance(op, SelectColumns):
            shown = [P.resolve(visible, c) for c in op.cols]
        elif isinstance(op, SortBy):
            name = P.resolve(visible, op.col)
            kind = dict(df.dtypes)[name]
            if not kind.startswith(_SORTABLE):
                raise TypeError(f"cannot sort by {name} of type {kind}")
            key = free_name(f"__key{len(hidden)}", df)
            value = F.col(f"`{name}`")
            df = df.withColumn(key, F.coalesce(value, F.lit(0).cast(kind)) if nulls == "zero" else value)
            hidden[key] = name
            order = [F.col(key).desc() if op.direction == "Descending" else F.col(key).asc(), *(order or [F.col(POS)])]
        elif isinstance(op, FilterTop):
            # of all rows in the order of the file, the first ones are told by their positions
            df = df.where(F.col(POS) < op.n) if whole and not order else df.orderBy(*(order or [F.col(POS)])).limit(op.n)
            whole = False
        elif isinstance(op, SetSelection):
            rows = op.rows
            if not isinstance(rows, DataFrame):
                rows = spark.createDataFrame([(int(i),) for i in rows], f"{POS} long")
            df = df.join(rows.select(F.col(rows.columns[0]).cast("long").alias(POS)).distinct(), POS, "left_semi")
            whole = False
        else:
            raise NotImplementedError(type(op).__name__)
    if df is None:
        raise ValueError("the first operation must be LoadParquet")
    if order and not (query.ops and isinstance(query.ops[-1], FilterTop)):
        df = df.orderBy(*order) if manager is None else strategies.sorted_by(df, order, list(hidden)[-1], POS, manager)
    return df.select(*[F.col(f"`{c}`") for c in shown])
