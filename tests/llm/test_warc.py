import hashlib
import zlib

import pyarrow.fs as pafs
import pytest

from calyxa.llm import warc as W
from calyxa.llm.scratch import Scratch

BIG, OTHER = "<p>" + "x" * 200, "<p>" + "y" * 200
ROWS = [
    (5, "http://a.example/x y\r\nz", BIG), (3, "http://b.example", BIG), (9, None, BIG), (4, "http://c.example/é", OTHER), (7, "u", "short"), (8, "u", "short"),
    (1, "u", None), (2, "u", ""), (-6, "u", OTHER), (None, "u", BIG), (10, "u", "é" * 60), (11, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 9), (12, "u", "z" * 3_000_000), (13, "u", "q"), (13, "u", "q"),
]


def expected():
    out = []
    for page, _, html in ROWS:
        b = (html or "").encode()
        same = [p for p, _, h in ROWS if (h or "") == (html or "") and p is not None]
        revisit = len(b) >= 100 and page is not None and page != min(same)
        out.append((page, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [50_000, -1])
def test_round_trip(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(W, "MAX_BROADCAST_DIGESTS", broadcast)
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], "page_id long, url string, html string, row string")
    df.write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in W.op8_warc_index_first(spark, str(tmp_path)).collect()), key=str)
    assert got == expected()


def test_selected_records_and_index(spark):
    scratch = Scratch(spark, "w")
    folder = scratch.folder("a")
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}" * 50) for i in range(200)], "page_id long, url string, html string")
    index = scratch.table(W.write_archive(W.with_revisits(pages.repartition(3), scratch), folder), "index")
    rows = index.collect()
    assert len({(r.file, r.offset) for r in rows}) == 200
    fs, root = pafs.FileSystem.from_uri(folder)
    for r in rows[:20]:
        with fs.open_input_file(f"{root}/{r.file}") as f:
            record = W.parse_record(zlib.decompress(f.read_at(r.length, r.offset), 31))
        assert W.page_of(record["warc-record-id"]) == r.page_id and hashlib.sha256(record["payload"]).hexdigest() == r.payload_digest
    some = W.read_records(index.where("page_id % 7 = 0"), folder).collect()
    assert sorted(r.page_id for r in some) == list(range(0, 200, 7)) and all(r.url == f"http://x/{r.page_id}" for r in some)


def test_tasks_follow_the_bytes_read(spark, monkeypatch):
    scratch = Scratch(spark, "w")
    folder = scratch.folder("a")
    pages = spark.createDataFrame([(i, None, f"<p>{i}" * 50) for i in range(300)], "page_id long, url string, html string")
    index = scratch.table(W.write_archive(W.with_revisits(pages.repartition(4), scratch), folder), "index")
    total = index.agg({"length": "sum"}).first()[0]
    assert W._tasks(index) == 1 and W._tasks(index.where("false")) == 1
    monkeypatch.setattr(W, "TASK_BYTES", total // 20)
    assert W._tasks(index) >= 20
    assert sorted(r.page_id for r in W.read_records(index, folder).collect()) == list(range(300))
    monkeypatch.setattr(W, "TASK_BYTES", 10 * total)
    monkeypatch.setattr(W, "READ_BYTES", total // 50)
    assert W._tasks(index) == spark.sparkContext.defaultParallelism
    assert sorted(r.page_id for r in W.read_records(index, folder).collect()) == list(range(300))


def test_ranges():
    rows = [("a", 0, 10), ("a", 10, 10), ("a", 200_000, 10), ("b", 0, 10), ("b", 10, W.READ_BYTES)]
    assert [(n, len(g)) for n, g in W._ranges(rows)] == [("a", 2), ("a", 1), ("b", 1), ("b", 1)]


def test_damage_is_found():
    raw = W.pack_record(1, "u", b"abc", hashlib.sha256(b"abc").hexdigest(), None)
    assert W.parse_record(raw)["payload"] == b"abc"
    for bad in (raw[:-1], raw[3:], raw + b"x"):
        with pytest.raises(ValueError):
            W.parse_record(bad)
    assert [W.page_of(W.record_id(i)) for i in (0, 5, -1, 2**63 - 1, -(2**63), None)] == [0, 5, -1, 2**63 - 1, -(2**63), None]


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    assert W.op8_warc_index_first(spark, str(tmp_path)).count() == 0
