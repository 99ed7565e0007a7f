import io

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from calyxa import runner
from calyxa.plans import predicates as P
from calyxa.plans import query as Q
from calyxa.streaming.pipeline import apply_to_stream


@pytest.fixture(scope="module")
def job(tmp_path_factory):
    d = tmp_path_factory.mktemp("job")
    ids = list(range(1, 201))
    table = pa.table(
        {
            "id": pa.array(ids, pa.int64()),
            "name": [f"name{i}" if i % 3 else None for i in ids],
            "k": pa.array([None if i % 10 == 0 else i % 7 - 3 for i in ids], pa.int32()),
        }
    )
    pq.write_table(table, d / "t.parquet", row_group_size=50)
    (d / "many").mkdir()
    for i in range(3):
        pq.write_table(table.slice(i * 70, 70), d / "many" / f"part-{i}.parquet")
    return str(d)


LINE = (
    '{"name": "q", "ops": [{"type": "LoadParquet", "file": "t.parquet"}, {"type": "GreaterThan", "col": "id", "val": 10}, '
    '{"type": "LessThan", "col": "id", "val": 100}, {"type": "SelectColumns", "cols": ["id", "name"]}, '
    '{"type": "SortBy", "col": "id", "direction": "Ascending"}, {"type": "FilterTop", "n": 5}]}'
)


def test_json_round_trip(spark, job):
    [query] = Q.read_queries(["", "# comment", LINE])
    out = io.StringIO()
    Q.write_query(out, query)
    assert list(Q.read_queries(out.getvalue().splitlines())) == [query]
    rows = Q.compile_query(spark, job, query).collect()
    assert [r.id for r in rows] == [11, 12, 13, 14, 15] and rows[0].asDict().keys() == {"id", "name"}


def test_every_operation_round_trips():
    ops = (
        Q.LoadParquet("a"), Q.LessThan("a", 1), Q.LessThanOrEqual("a", 1), Q.GreaterThan("a", 1), Q.GreaterThanOrEqual("a", 1), Q.Equals("a", 1),
        Q.NotEquals("a", 1), Q.Between("a", 1, 2), Q.NotNull("a"), Q.IsNull("a"), Q.In("a", (1, 2)), Q.StringContains("a", "x"),
        Q.SmartStringOnTop("a", "x", "b", 3), Q.SelectColumns(("a",)), Q.SortBy("a", "Descending"), Q.FilterTop(3), Q.And(), Q.Or(),
    )
    q = Q.Query("all", ops)
    assert Q.query_from_json(Q.query_to_json(q)) == q
    with pytest.raises(ValueError):
        Q.query_to_json(Q.Query("no", (Q.SetSelection((1,)),)))
    with pytest.raises(ValueError):
        list(Q.read_queries(['{"name": "x", "ops": [{"type": "Nope"}]}']))


def run(spark, job, *ops, **k):
    return Q.compile_query(spark, job, Q.Query("q", (Q.LoadParquet("t.parquet"), *ops)), **k).collect()


def test_sorts_are_stable_and_nulls_count_as_zero(spark, job):
    key = lambda i: 0 if i % 10 == 0 else i % 7 - 3
    for direction, sign in (("Ascending", 1), ("Descending", -1)):
        got = [r.id for r in run(spark, job, Q.SortBy("k", direction))]
        assert got == sorted(range(1, 201), key=lambda i: (sign * key(i), i))
    assert run(spark, job, Q.SortBy("k"), nulls="first")[0].k is None


def test_or_and_top_and_selection(spark, job):
    assert [r.id for r in run(spark, job, Q.LessThan("id", 3), Q.Or(), Q.GreaterThan("id", 198))] == [1, 2, 199, 200]
    assert [r.id for r in run(spark, job, Q.FilterTop(3))] == [1, 2, 3]
    assert [r.id for r in run(spark, job, Q.SetSelection((0, 5, 900)), Q.GreaterThan("id", 1))] == [6]
    with pytest.raises(NotImplementedError):
        run(spark, job, Q.Or(), Q.LessThan("id", 3))
    with pytest.raises(TypeError):
        run(spark, job, Q.SortBy("name"))
    with pytest.raises(ValueError):
        Q.compile_query(spark, job, Q.Query("x", (Q.FilterTop(1),)))
    assert [r.id for r in run(spark, job, Q.SmartStringOnTop("name", "e1", "id", 12))] == [1, 10, 11]


def test_positions_run_over_several_files(spark, job):
    q = Q.Query("q", (Q.LoadParquet("many"), Q.SetSelection((0, 69, 70, 140, 199))))
    assert sorted(r.id for r in Q.compile_query(spark, job, q).collect()) == [1, 70, 71, 141, 200]


def test_plans_push_down(spark, job):
    df = Q.compile_query(spark, job, Q.Query("q", (Q.LoadParquet("t.parquet"), Q.LessThan("id", 5), Q.SelectColumns(("id",)))))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LessThan(id,5)" in plan and "name" not in plan.split("ReadSchema")[-1]


def jobs(spark, f):
    """The result of f, and how many jobs it took."""
    group = f"count-{id(f)}"
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        return f(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_positions_are_made_only_if_needed(spark, job):
    plain = Q.Query("q", (Q.LoadParquet("many"), Q.LessThan("id", 5), Q.SelectColumns(("id",))))
    schema = spark.read.parquet(f"{job}/many").schema
    loader = lambda path, positions, first: spark.read.schema(schema).parquet(path) if not positions else Q.load_with_position(spark, path, first)
    df, n = jobs(spark, lambda: Q.compile_query(spark, job, plain, loader=loader))
    assert n == 0 and "row_index" not in df._jdf.queryExecution().executedPlan().toString()
    top = Q.compile_query(spark, job, Q.Query("q", (Q.LoadParquet("many"), Q.SelectColumns(("id",)), Q.FilterTop(3))))
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort [" not in plan and sorted(r.id for r in top.collect()) == [1, 2, 3]
    both = Q.compile_query(spark, job, Q.Query("q", (Q.LoadParquet("many"), Q.FilterTop(9), Q.GreaterThan("id", 2), Q.FilterTop(2))))
    assert sorted(r.id for r in both.collect()) == [3, 4]


def test_bounds_are_tested_before_needles():
    p = P.tightest_bounds(P.Contains("s", "x") & P.LessThan("a", 9) & P.LessThan("a", 5))
    assert p == P.And(P.LessThan("a", 5), P.Contains("s", "x"))
    then = P.Then(P.Contains("s", "x"), P.LessThan("a", 9))
    assert P.tightest_bounds(then & P.LessThan("a", 3)) == P.And(P.LessThan("a", 3), then)


def test_runner_with_a_cache_and_partitions(spark, job, tmp_path, capsys):
    (tmp_path / "q.jsonl").write_text(LINE + "\n")
    (tmp_path / "c.yml").write_text("parquet_cache_memory_budget_gb: 1\n")
    runner.main(["--queries", str(tmp_path / "q.jsonl"), "--job-path", job, "--config", str(tmp_path / "c.yml"), "--partitions", "3", "--run-all"])
    assert "Total time" in capsys.readouterr().out


def test_runner_reports(spark, job, capsys):
    [query] = Q.read_queries([LINE])
    report = runner.run_all(spark, job, [query, query], n_epochs=2)
    assert [[r["order_id"] for r in e] for e in report["times"]] == [[0, 1], [0, 1]]


def test_stream(spark, job, tmp_path):
    stream = spark.readStream.schema(spark.read.parquet(f"{job}/t.parquet").schema).parquet(f"{job}/many")
    q = Q.Query("q", (Q.LoadParquet("-"), Q.LessThan("id", 75), Q.Or(), Q.Equals("id", 150), Q.SelectColumns(("id",))))
    sink = apply_to_stream(stream, q).writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path)).start()
    sink.processAllAvailable()
    sink.stop()
    assert sorted(r.id for r in spark.table("streamed").collect()) == [*range(1, 75), 150]
    with pytest.raises(NotImplementedError):
        apply_to_stream(stream, Q.Query("q", (Q.SortBy("id"),)))
