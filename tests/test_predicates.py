import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from calyxa.plans import predicates as P

ROWS = [(i, (None if i % 5 == 0 else (i * 7) % 10), (None if i % 7 == 0 else (i * 3) % 6)) for i in range(40)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(ROWS, "id long, a int, b int").cache()


def leaf():
    cols, k = st.sampled_from(["a", "b"]), st.integers(-1, 11)
    return st.one_of(
        st.builds(P.Compare, st.sampled_from(["<", "<=", ">", ">=", "==", "!="]), cols, k),
        st.builds(P.Between, cols, k, k),
        st.builds(P.In, cols, st.lists(k, max_size=3).map(tuple)),
        st.builds(P.IsNull, cols),
        st.builds(P.NotNull, cols),
        st.just(P.ColumnsEqual("a", "b")),
    )


def trees():
    return st.recursive(
        leaf(),
        lambda t: st.one_of(st.builds(P.And, t, t), st.builds(P.Or, t, t), st.builds(P.Not, t), st.builds(P.Then, t, t), st.builds(lambda x: P.Hint("bitmap", x), t)),
        max_leaves=6,
    )


def model(p, row):
    """Membership in the row set, in plain Python."""
    v = {"a": row[1], "b": row[2]}
    match p:
        case P.Compare():
            x = v[p.col]
            return x is not None and {"<": x < p.value, "<=": x <= p.value, ">": x > p.value, ">=": x >= p.value, "==": x == p.value, "!=": x != p.value}[p.symbol]
        case P.Between():
            return v[p.col] is not None and p.low < v[p.col] < p.high
        case P.In():
            return v[p.col] is not None and v[p.col] in p.values
        case P.IsNull():
            return v[p.col] is None
        case P.NotNull():
            return v[p.col] is not None
        case P.ColumnsEqual():
            return v["a"] is not None and v["a"] == v["b"]
        case P.Not() | P.Hint():
            return model(p.inner, row) != isinstance(p, P.Not)
        case P.Or():
            return model(p.left, row) or model(p.right, row)
        case _:
            return all(model(c, row) for c in p.children())


@settings(max_examples=40, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(trees())
def test_row_sets(frame, p):
    want = [r[0] for r in ROWS if model(p, r)]
    for q in (p, P.normal_form(p), P.tightest_bounds(p)):
        assert sorted(r.id for r in frame.where(q.column(frame)).collect()) == want


def test_between_leaves_ends_out_and_empty_needles_select_nothing(spark):
    df = spark.createDataFrame([("hello",), ("",), (None,)], "s string")
    assert df.where(P.Contains("s", "").column(df)).count() == 0
    assert df.where(P.Contains("s", "ell").column(df)).count() == 1
    assert df.where(P.Like("s", "h%o").column(df)).count() == 1
    n = spark.range(10)
    assert [r.id for r in n.where(P.Between("id", 3, 6).column(n)).collect()] == [4, 5]


def test_needles_do_not_cross_rows(spark):
    df = spark.createDataFrame([("ab",), ("cd",)], "s string")
    assert df.where(P.Contains("s", "bc").column(df)).count() == 0


def test_columns_by_place_and_wide_literals(spark):
    df = spark.createDataFrame([(1,), (2**31 - 1,)], "i int")
    assert df.where(P.LessThan(0, 5_000_000_000).column(df)).count() == 2
    with pytest.raises(KeyError):
        P.LessThan("nope", 1).column(df)
    with pytest.raises(KeyError):
        P.LessThan(3, 1).column(df)


def test_depth_and_balance():
    leaves = [P.LessThan("a", i) for i in range(8)]
    assert P.multi_and(leaves).max_depth() == 3
    assert P.LessThan("a", 1).max_depth() == 0
    with pytest.raises(ValueError):
        P.multi_and([])
    assert P.conjuncts(P.multi_and(leaves)) == leaves


def test_tightest_bounds():
    p = P.tightest_bounds(P.LessThan("a", 300) & P.LessThan("a", 200) & P.LessOrEqual("a", 200) & P.NotNull("a"))
    assert set(P.conjuncts(p)) == {P.NotNull("a"), P.LessThan("a", 200)}
