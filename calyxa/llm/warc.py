"""WARC archives with an index written first, read back by coalesced byte ranges.

``write_archive`` writes one gzip member per record (so any record can be read alone)
and returns the index: file, offset, length, url and payload digest of every record.
``read_records`` takes any selection of index rows, sorts them by file and offset,
joins neighbouring ranges into one read, and parses the records found there; records are dealt
to tasks by the bytes that are read for them, not by the size of their index rows.

Each task writes a file of its own name and only the index rows of tasks that ended well
are used, so a lost executor leaves at most a file that nothing points to.  Files go
through the file system that the folder's URI names, never to a local folder.

Duplicates: payloads of MIN_DUPLICATE bytes and more with equal digest are stored once,
as the response of the smallest page_id; the others are revisit records that refer to it.
The table of repeated digests is broadcast only while it is small (its rows are counted),
else it is joined by shuffle, where a hot digest can be split.

Edge cases: null html is an empty payload; null urls have no target URI; line breaks and
blanks in urls are percent-encoded; a null page_id has a record of its own kind and is
never another's response; rows that repeat a page_id are records of the same type; an empty table gives an empty archive and result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from calyxa.llm.scratch import Scratch

MIN_DUPLICATE = 100
#: Bytes of one read and the largest gap that is read over.
READ_BYTES, GAP_BYTES = 8 << 20, 64 << 10
#: Bytes of archives that one task reads, about.
TASK_BYTES = 256 << 20
#: Repeated digests that are still broadcast.
MAX_BROADCAST_DIGESTS = 50_000
_DATE = "1970-01-01T00:00:00Z"
_ID, _NO_ID = 0x63616C7978610000, 0x63616C7978610001

INDEX = "page_id long, file string, offset long, length long, url string, payload_digest string"


def record_id(page_id: int | None, nth: int = 0) -> str:
    """The record's URI; it holds the page_id."""
    high, low = (_NO_ID, nth) if page_id is None else (_ID, page_id)
    return f"<urn:uuid:{uuid.UUID(int=(high << 64) | (low & (2**64 - 1)))}>"


def page_of(record: str) -> int | None:
    value = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 == _NO_ID:
        return None
    low = value & (2**64 - 1)
    return low - (1 << 64) if low >> 63 else low


def pack_record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None, nth: int = 0) -> bytes:
    """One WARC record: a response with its HTTP block, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    block = http + html if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, nth)}",
        f"WARC-Date: {_DATE}",
        *([f"WARC-Target-URI: {quote(url, safe=chr(37) + ':/?#[]@!$&' + chr(39) + '()*+,;=~')}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        *(
            []
            if refers_to is None
            else [
                "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                f"WARC-Refers-To: {record_id(refers_to)}",
            ]
        ),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers and HTTP block of a record; raises ValueError if it is not whole."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("record cut off")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    http_fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
    return fields | {"payload": payload, "payload_bytes": int(http_fields["content-length"])}


def _file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """pages(page_id, url, html, payload_digest, refers_to) -> index rows; lazily, one file a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        part, out, at, nth = TaskContext.get().partitionId(), None, 0, 0
        name = f"part-{part:06d}-{uuid.uuid4().hex}.warc.gz"
        try:
            for batch in batches:
                rows = {k: batch.column(batch.schema.get_field_index(k)) for k in ("page_id", "url", "payload_digest", "refers_to")}
                html = batch.column(batch.schema.get_field_index("html")).cast(pa.binary()).to_pylist()
                page, url, digest, refers = (x.to_pylist() for x in rows.values())
                offsets, lengths = [], []
                for i, body in enumerate(html):
                    if out is None:
                        out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
                    raw = pack_record(page[i], url[i], body or b"", digest[i], refers[i], (part << 32) + nth)
                    member = packer.compress(raw) + packer.flush()
                    out.write(member)
                    offsets.append(at), lengths.append(len(member))
                    at, nth = at + len(member), nth + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        rows["page_id"], pa.array([name] * len(page), pa.string()), pa.array(offsets, pa.int64()),
                        pa.array(lengths, pa.int64()), rows["url"], rows["payload_digest"],
                    ],
                    names=["page_id", "file", "offset", "length", "url", "payload_digest"],
                )
        finally:
            if out is not None:
                out.close()

    return pages.select(F.col("page_id").cast("long"), "url", "html", "payload_digest", "refers_to").mapInArrow(run, INDEX)


def _ranges(rows: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Records in order of (file, offset) -> groups that one read covers."""
    name, group = None, []
    for file, offset, length in rows:
        if group and (file != name or offset > group[-1][0] + group[-1][1] + GAP_BYTES or offset + length - group[0][0] > READ_BYTES):
            yield name, group
            group = []
        name = file
        group.append((offset, length))
    if group:
        yield name, group


def _tasks(index: DataFrame) -> int:
    """Tasks that the records are read by: of TASK_BYTES at most on average; as many as run at once, if there is a read for each."""
    total = index.agg(F.sum("length")).first()[0] or 0
    at_once = index.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // TASK_BYTES), min(at_once, -(-total // READ_BYTES)))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Selected index rows -> page_id, payload_bytes, payload_digest, record_type, refers_to, url.

    Payloads that are there are hashed again; a record that does not hold what its digest says is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        source, opened = None, None
        try:
            for batch in batches:
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
                out: list[tuple] = []
                for name, group in _ranges(rows):
                    if name != opened:
                        if source is not None:
                            source.close()
                        source, opened = fs.open_input_file(f"{root}/{name}"), name
                    start = group[0][0]
                    data = memoryview(source.read_at(group[-1][0] + group[-1][1] - start, start))
                    for offset, length in group:
                        r = parse_record(zlib.decompress(data[offset - start : offset - start + length], 31))
                        digest = r["warc-payload-digest"].removeprefix("sha256:")
                        kind = r["warc-type"]
                        if kind == "response" and (hashlib.sha256(r["payload"]).hexdigest() != digest or len(r["payload"]) != r["payload_bytes"]):
                            raise ValueError(f"{name} at {offset}: payload and digest differ")
                        to = r.get("warc-refers-to")
                        out.append((page_of(r["warc-record-id"]), r["payload_bytes"], digest, kind, page_of(to) if to else None, r.get("warc-target-uri")))
                columns = list(zip(*out, strict=True)) if out else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"],
                )
        finally:
            if source is not None:
                source.close()

    reads = index.select("file", "offset", "length").withColumn("chunk", F.floor(F.col("offset") / (4 * READ_BYTES)))
    return (
        reads.repartition(_tasks(reads), "file", "chunk")  # a number that is told is not coalesced
        .sortWithinPartitions("file", "offset")
        .select("file", "offset", "length")
        .mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
    )


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages(page_id, url, html) with payload_digest and refers_to (null for responses)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        html.alias("html"),
        F.sha2(html, 256).alias("payload_digest"),
    )
    large = rows.where((F.octet_length("html") >= MIN_DUPLICATE) & F.col("page_id").isNotNull())
    repeated = scratch.table(
        large.groupBy("payload_digest").agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"),
        "repeated",
    )
    small = repeated.count() <= MAX_BROADCAST_DIGESTS
    joined = rows.join(F.broadcast(repeated) if small else repeated, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(F.col("page_id") != F.col("first_page"), F.col("first_page"))).drop("first_page")


def op8_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    folder = scratch.folder("archive")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = scratch.table(write_archive(with_revisits(pages, scratch), folder), "index")
    return read_records(index, folder).drop("url")


QUERIES = {"op8_warc_index_first": op8_warc_index_first}
ORACLE_SQL = {
    "op8_warc_index_first": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {MIN_DUPLICATE} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {MIN_DUPLICATE} AND page_id <> first THEN first END AS refers_to
FROM f
"""
}
