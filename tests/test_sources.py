import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from calyxa.sources import parquet as S


@pytest.fixture(scope="module")
def path(tmp_path_factory):
    p = tmp_path_factory.mktemp("f") / "t.parquet"
    n = 10_000
    table = pa.table({"c1": pa.array(range(n), pa.int32()), "c2": [f"s{i}" if i % 2 == 0 else None for i in range(n)]})
    pq.write_table(table, p, row_group_size=1000)
    return str(p)


def test_footer(spark, path):
    f = S.Footer(spark, path)
    assert f.row_counts() == [1000] * 10 and f.null_counts("c2") == [500] * 10 and f.null_counts(0) == [0] * 10
    assert f.mins(0) == [1000 * i for i in range(10)] and f.maxs("c1") == [1000 * i + 999 for i in range(10)]
    assert f.column(1) == "c2"
    rows = S.footer_frame(spark, path, "c1").orderBy("group").collect()
    assert len(rows) == 10 and rows[3].min == "3000" and rows[3].row_count == 1000


def test_footers_of_a_folder(spark, tmp_path):
    spark.range(100).selectExpr("id", "if(id % 4 = 0, null, concat('s', id)) s", "struct(id y) z").repartition(3).write.parquet(str(tmp_path / "t"))
    for at in (str(tmp_path / "t"), f"file://{tmp_path}/t"):
        f = S.Footer(spark, at)
        assert sum(f.row_counts()) == 100 and len(f.row_counts()) == 3 and sum(f.null_counts("s")) == 25
        assert min(f.mins("id")) == 0 and max(f.maxs("id")) == 99 and max(f.maxs("s")) == "s99"


def test_first_rows_read_no_more_files(spark, tmp_path):
    for i in range(4):
        spark.range(i * 10, i * 10 + 10).coalesce(1).write.mode("append").parquet(str(tmp_path / "t" / f"p{i}"))
    paths = str(tmp_path / "t" / "*")
    whole = S.load_with_position(spark, paths)
    assert sorted((r.id, r[S.POS]) for r in whole.collect()) == [(i, i) for i in range(40)]
    some = S.load_with_position(spark, paths, first=15)
    assert len(some.inputFiles()) == 2 and sorted(r.id for r in some.collect()) == list(range(20))


def test_first_rows_of_a_partitioned_folder(spark, tmp_path):
    path = str(tmp_path / "a table")
    spark.range(40).selectExpr("id", "concat('p ', id div 10) part").repartition("part").write.partitionBy("part").parquet(path)
    some = S.load_with_position(spark, path, first=15).where("__pos < 15").orderBy("__pos").collect()
    assert [(r.id, r.part) for r in some] == [(i, f"p {i // 10}") for i in range(15)]


def test_cache_gives_positions(spark, path):
    cache = S.TableCache(spark, 1 << 30)
    a = cache.load(path, positions=True)
    assert cache.load(path, positions=True, first=5) is a and cache.load(path) is not a and S.POS in a.columns
    cache.clear()


def test_positions(spark, path):
    df = S.load_with_position(spark, path)
    assert df.where(df[S.POS] != df.c1).count() == 0


def test_cache_evicts_the_oldest(spark, path):
    size = S.size_estimate(S.load(spark, path))
    cache = S.TableCache(spark, int(size * 2.5))
    a = cache.load(path)
    assert cache.load(path) is a
    others = [path.replace("t.parquet", f"u{i}.parquet") for i in range(2)]
    for o in others:
        pq.write_table(pq.read_table(path), o, row_group_size=1000)
    cache.load(others[0])
    cache.load(path)
    cache.load(others[1])
    assert list(cache.kept) == [(path, False), (others[1], False)] and cache.used <= cache.budget
    cache.clear()
    none = S.TableCache(spark, 0)
    none.load(path)
    assert not none.kept


def test_arrow_and_stream(spark):
    df = S.from_arrow(spark, pa.table({"a": [1, 2, 3]}))
    assert [r.a for r in S.stream_rows(df)] == [1, 2, 3]
    with pytest.raises(ValueError):
        S.from_arrow(spark, pa.Table.from_arrays([pa.array([1]), pa.array([2])], names=["a", "a"]))


def test_nested_columns_and_empty_tables(spark, tmp_path):
    spark.sql("select array(1, 2) as x, named_struct('y', 1) as s").write.parquet(str(tmp_path / "n"))
    assert S.load(spark, str(tmp_path / "n")).selectExpr("x[0]", "s.y").first() == (1, 1)
    spark.range(0).write.parquet(str(tmp_path / "e"))
    assert S.load_with_position(spark, str(tmp_path / "e")).count() == 0
