"""WARC source: round trips, records written by hand, pushed predicates, and SQL."""

import gzip
import hashlib
import os

import pytest
from pyspark.sql import functions as F

from dayloom.llm import warc

PAGES = "page_id long, url string, html string, digest string, first string, n string, payload string"


def plain(*records):
    out = b""
    for fields, block in records:
        out += "\r\n".join(["WARC/1.0", *(f"{k}: {v}" for k, v in fields), f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return out


HTTP = b"HTTP/1.1 200 OK\r\nX: WARC/1.0\r\n\r\n"
RECORDS = [
    ([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "<a>")], b"software: x\r\n\r\nWARC/1.0\r\n"),
    ([("warc-type", "response"), ("WARC-Record-ID", "<b>"), ("WARC-Target-URI", "http://a/é"), ("Content-Type", "application/http; msgtype=response")],
     HTTP + b"body\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n" + b"x" * 600_000),
    ([("WARC-Type", "request"), ("WARC-Record-ID", "<c>"), ("WARC-Target-URI", "http://a/"), ("Content-Type", "application/http;msgtype=request")],
     b"GET / HTTP/1.1\r\n\r\n"),
    ([("WARC-Type", "metadata"), ("WARC-Record-ID", "<d>"), ("X-Long", "one\r\n  two")], b""),
    ([("WARC-Type", "revisit"), ("WARC-Record-ID", "<e>"), ("WARC-Refers-To", "<b>"), ("WARC-Target-URI", "http://b/")], HTTP),
    ([("WARC-Type", "response"), ("WARC-Record-ID", "<f>"), ("WARC-Target-URI", "http://b/2"), ("Content-Type", "application/http")], HTTP + bytes(range(256))),
]


@pytest.fixture(params=["plain", "gzip", "gzip with lengths"])
def folder(request, tmp_path):
    parts = [plain(r) for r in RECORDS]
    write = {"plain": bytes, "gzip": gzip.compress, "gzip with lengths": warc.gzip_member}[request.param]
    name = "x.warc" if request.param == "plain" else "x.warc.gz"
    (tmp_path / name).write_bytes(b"".join(map(write, parts)))
    (tmp_path / "notes.txt").write_text("no archive")
    return str(tmp_path)


def test_records_written_by_hand(spark, folder):
    rows = warc.read_warc(spark, folder).orderBy("offset").collect()
    assert [r.record_id for r in rows] == ["<a>", "<b>", "<c>", "<d>", "<e>", "<f>"]
    want = [RECORDS[0][1], RECORDS[1][1][len(HTTP):], b"", b"", None, bytes(range(256))]
    assert [r.payload if r.payload is None else bytes(r.payload) for r in rows] == want
    assert rows[1].target_uri == "http://a/é" and rows[3].headers["x-long"] == "one two" and rows[4].refers_to == "<b>"
    assert [r.content_length for r in rows] == [len(b) for _, b in RECORDS]
    assert rows[0].target_uri is None and rows[0].offset == 0


@pytest.mark.parametrize("columns", [None, ["record_id", "record_type", "target_uri", "content_length", "refers_to"]])
def test_filters_give_what_spark_would(spark, folder, columns):
    every = warc.read_warc(spark, folder).collect()
    tests = [("record_type = 'response'", lambda r: r.record_type == "response"), ("record_type IN ('revisit', 'request')", lambda r: r.record_type in ("revisit", "request")),
             ("target_uri LIKE 'http://b%'", lambda r: (r.target_uri or "").startswith("http://b")), ("target_uri IS NULL", lambda r: r.target_uri is None),
             ("NOT (target_uri = 'http://a/')", lambda r: r.target_uri not in (None, "http://a/")), ("content_length > 300 AND record_type <> 'x'", lambda r: r.content_length > 300),
             ("record_type = 'response' OR refers_to = '<b>'", lambda r: r.record_type == "response" or r.refers_to == "<b>"),
             ("refers_to IS NOT NULL", lambda r: r.refers_to is not None), ("record_type = 'nothing'", lambda r: False)]
    for sql, holds in tests:
        got = warc.read_warc(spark, folder, columns).where(sql)
        assert sorted(r.record_id for r in got.collect()) == [r.record_id for r in every if holds(r)], sql


def test_filters_reach_the_reader(spark, folder):
    read = warc.read_warc(spark, folder, ["record_type", "record_id"])
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert " Filter " not in plan(read.where("record_type = 'revisit'")) and " Filter " in plan(read.where("length(record_id) = 3"))
    from pyspark.sql.datasource import EqualTo, GreaterThan
    from pyspark.sql.types import StructType
    reader = warc.WarcReader(StructType(), {"path": folder})
    tests = [EqualTo(("record_type",), "revisit"), GreaterThan(("payload",), b""), EqualTo(("headers", "x"), "y")]
    assert list(reader.pushFilters(tests)) == tests[1:] and reader.tests == tests[:1]


class Counted:
    """A source that counts what is read from it."""

    def __init__(self, data):
        import io
        self.io, self.n = io.BytesIO(data), 0

    def read(self, n):
        out = self.io.read(n)
        self.n += len(out)
        return out

    def seek(self, at):
        self.io.seek(at)

    def tell(self):
        return self.io.tell()


def test_unwanted_payloads_are_not_decoded(monkeypatch):
    large = os.urandom(3 << 20)
    records = [plain(([("WARC-Type", "resource" if k % 2 else "metadata")], large if k % 2 else b"small")) for k in range(10)]
    monkeypatch.setattr(warc, "READ_BYTES", 1 << 12)
    for write, compressed in ((bytes, False), (warc.gzip_member, True)):
        data = b"".join(map(write, records))
        source = Counted(data)
        rows = list(warc.read_records(source, compressed, lambda f, a, n: f["warc-type"] == "metadata", True))
        assert [r[3] for r in rows] == [b"small"] * 5 and source.n < len(data) / 50
        source = Counted(data)
        assert len(list(warc.read_records(source, compressed, lambda f, a, n: True, False))) == 10 and source.n < len(data) / 50


@pytest.mark.parametrize("data, said", [(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nab", "shorter"), (b"HTTP/1.1 200\r\n\r\n", "no WARC record"), (b"WARC/1.0\r\n\r\n", "content-length"),
                                        (gzip.compress(plain(RECORDS[1]))[:-40], "broken"), (b"\x1f\x8bxx", "not a gzip")])
def test_broken_archives_are_errors(data, said):
    import io
    with pytest.raises(ValueError, match=said):
        list(warc.read_records(io.BytesIO(data), data[:2] == b"\x1f\x8b", lambda *a: True, True))


def pages():
    long = "<html>" + "é" * 100
    rows = [(5, "http://h/5", long), (3, "http://h/3", long), (9, None, long), (3, "http://h/3", long), (None, "http://h/n", long), (7, "u", "short"), (1, "u", "short"),
            (8, "", None), (2, "a b\r\nWARC-Type: x", ""), (10, "u", "x" * 99), (4, "u", "x" * 99), (11, "u", "x" * 100), (12, "u", "x" * 100),
            (None, "u", "z" * 200), (None, "u", "z" * 200), (-6, "u", "y" * 120), (6, "u", "y" * 120), (13, "u", "\r\n\r\nWARC/1.1\r\n" * 20_000), (14, "u", "lone\x00nul" * 30)]
    return [(*r, "d", "f", "n", "p") for r in rows]


def slow(rows):
    out = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        same = [p for p, _, h, *_ in rows if (h or "").encode() == data and p is not None]
        again = len(data) >= 100 and bool(same) and page != min(same)
        out.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", min(same) if again else None))
    return sorted(map(repr, out))


@pytest.mark.parametrize("options", [{}, {"compression": "none"}, {"archiveBytes": "1"}])
def test_pages_round_trip(spark, tmp_path, options):
    rows = pages()
    df = spark.createDataFrame(rows, PAGES)
    warc.write_warc(warc.page_records(df), f"{tmp_path}/a", **options)
    back = warc.read_pages(spark, f"file://{tmp_path}/a").collect()
    assert sorted(repr(tuple(r)[:5]) for r in back) == slow(rows)
    urls = {r.page_id: r.url for r in back}
    assert urls[9] is None and urls[8] == "" and urls[2] == "a%20b%0D%0AWARC-Type:%20x"
    full = warc.read_warc(spark, f"{tmp_path}/a", ["record_type", "record_id", "payload"]).where("record_type = 'response'")
    payloads = {r.p: bytes(r.payload).decode() for r in full.select(warc.page_of("record_id").alias("p"), "payload").collect()}
    assert payloads[13] == rows[17][2] and payloads[8] == "" and 5 not in payloads
    infos = warc.read_warc(spark, f"{tmp_path}/a", ["record_type"]).where("record_type = 'warcinfo'").count()
    assert infos == len([f for f in os.listdir(f"{tmp_path}/a") if ".warc" in f and not f.startswith(".")])


def test_append_overwrite_and_uncommitted_files(spark, tmp_path):
    first, second = (spark.createDataFrame([(i, "u", f"page {i}")], "page_id long, url string, html string") for i in (1, 2))
    ids = lambda: sorted(r.page_id for r in warc.read_pages(spark, str(tmp_path)).collect())
    warc.write_warc(warc.page_records(first), str(tmp_path))
    (tmp_path / "part-lost.warc.gz").write_bytes(b"half of a record")
    assert ids() == [1]
    warc.write_warc(warc.page_records(second), str(tmp_path))
    assert ids() == [1, 2]
    warc.write_warc(warc.page_records(second), str(tmp_path), mode="overwrite")
    assert ids() == [2] and not (tmp_path / "part-lost.warc.gz").exists()


def test_small_partitions(spark, tmp_path):
    df = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "repeat(uuid(), 20) AS html").repartition(8)
    warc.write_warc(warc.page_records(df), str(tmp_path))
    for size in (1, 1 << 30):
        back = warc.read_warc(spark, str(tmp_path), partitionBytes=size).where(F.col("record_type") == "response")
        assert back.count() == 40 and (back.rdd.getNumPartitions() == 1) == (size > 1)


def test_empty(spark, tmp_path):
    warc.write_warc(warc.page_records(spark.createDataFrame([], PAGES)), f"{tmp_path}/none")
    assert warc.read_pages(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    from compare import compare, oracle
    problem = compare(warc.op12_warc(spark, f"/root/testdata/{sf}"), oracle(f"/root/testdata/{sf}"), warc.OP12_SQL)
    assert not problem, problem
