"""WARC archives as a Spark data source: format ``warc``, read and written through Spark's Python data source API.

Reading plans one partition per archive, small archives packed together.  A task parses a record's
header first and tests the pushed predicates on record type and header fields; a record that
fails, or whose payload no column asks for, is passed over: by seeking in a plain archive, by the
member's length in a compressed one that states it (the ``sl`` field of the format's gzip annex),
and otherwise by inflating without keeping anything.

Writing gives every task archives of its own.  They count only once the job's commit has listed
them in a manifest, so what a lost or repeated task left behind is never read.
"""

import json
import re
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith,
    WriterCommitMessage)
from pyspark.sql.pandas.types import to_arrow_schema

from dayloom.llm.common import table
from dayloom.session import shared_dir

#: Column -> header field.  ``headers`` holds all fields under lower-case names.
FIELDS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date",
          "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type"}
SCHEMA = ("file string, offset long, content_length long, " + ", ".join(f"{c} string" for c in FIELDS)
          + ", headers map<string, string>, payload binary")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of archives in one task, read at once, written to one archive, and handed to Spark at once.
PARTITION_BYTES, READ_BYTES, ARCHIVE_BYTES, BATCH_BYTES = 16 << 20, 1 << 18, 256 << 20, 8 << 20
#: Payloads below this size are never revisits.
LEAST_PAYLOAD = 100


def _filesystem(path: str):
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", path))


# ---- reading ----

class _Plain:
    """Records of an uncompressed archive."""

    def __init__(self, source):
        self.source, self.held, self.at = source, b"", 0

    def more(self) -> bool:
        new = self.source.read(READ_BYTES)
        self.held += new
        return bool(new)

    def start(self) -> bool:
        return bool(self.held) or self.more()

    def take(self, n: int) -> bytes:
        if n > len(self.held):
            self.held += self.source.read(n - len(self.held))
        out, self.held = self.held[:n], self.held[n:]
        self.at += len(out)
        return out

    def skip(self, n: int):
        inside = min(n, len(self.held))
        self.held, self.at = self.held[inside:], self.at + n
        if n > inside:
            self.source.seek(self.at)

    def finish(self):
        pass


class _Gzip:
    """Records of an archive with one gzip member a record."""

    def __init__(self, source):
        self.source, self.raw, self.at = source, b"", 0

    def start(self) -> bool:
        self.raw = self.raw or self.source.read(READ_BYTES)
        self.at = self.source.tell() - len(self.raw)
        if not self.raw:
            return False
        while len(self.raw) < 24 and (new := self.source.read(READ_BYTES)):
            self.raw += new
        self.length = _member_length(self.raw)
        self.inflate, self.held = zlib.decompressobj(31), b""
        return True

    def more(self) -> bool:
        while not self.inflate.eof:
            if not self.raw:
                self.raw = self.source.read(READ_BYTES)
                if not self.raw:
                    raise ValueError("the archive ends inside a record")
            new = self.inflate.decompress(self.raw, READ_BYTES)
            self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            if new:
                self.held += new
                return True
        return False

    def take(self, n: int) -> bytes:
        parts, have = [self.held], len(self.held)
        while have < n:
            self.held = b""
            if not self.more():
                break
            parts.append(self.held)
            have += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]

    def skip(self, n: int):
        pass

    def finish(self):
        """Go to the next member, past whatever of this one was not asked for."""
        if self.length and not self.inflate.eof:
            self.source.seek(self.at + self.length)
            self.raw = b""
        else:
            self.held = b""
            while self.more():
                self.held = b""


def _member_length(raw: bytes):
    """The member's compressed length, where its gzip header has a skip-length field."""
    if raw[:3] != b"\x1f\x8b\x08":
        raise ValueError("not a gzip member")
    if not raw[3] & 4 or len(raw) < 24:
        return None
    size, = struct.unpack_from("<H", raw, 10)
    if size < 12 or raw[12:16] != b"sl\x08\x00":
        return None
    length, = struct.unpack_from("<I", raw, 16)
    return length or None


def _headers(text: bytes) -> dict:
    """Named fields under lower-case names; a line that starts with white space continues the one before."""
    lines = re.sub(r"\r?\n[ \t]+", " ", text.decode("utf-8", "replace")).replace("\r\n", "\n").split("\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    pairs = (line.partition(":") for line in lines[1:] if ":" in line)
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def _payload(fields: dict, block: bytes):
    """What a block carries: the body of an HTTP message, otherwise the block; a revisit carries none."""
    if fields.get("warc-type") == "revisit":
        return None
    if fields.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_records(source, compressed: bool, wanted, with_payload: bool):
    """(offset, fields, content_length, payload) of the records whose fields ``wanted`` accepts."""
    archive = (_Gzip if compressed else _Plain)(source)
    while archive.start():
        at = archive.at
        if not compressed and not archive.held.strip(b"\r\n"):
            archive.take(len(archive.held))  # blank lines at the end
            continue
        try:
            while (end := archive.held.find(b"\r\n\r\n")) < 0:
                if not archive.more():
                    raise ValueError("the header doesn't end")
            fields = _headers(archive.take(end + 4))
            length = int(fields["content-length"])
            payload = None
            if keep := wanted(fields, at, length):
                if with_payload:
                    block = archive.take(length)
                    if len(block) < length:
                        raise ValueError("the record is shorter than its Content-Length")
                    payload = _payload(fields, block)
            if not (keep and with_payload):
                archive.skip(length)
            archive.skip(4)
            archive.finish()
        except (ValueError, KeyError, zlib.error) as wrong:
            raise ValueError(f"broken record at byte {at}: {wrong}") from wrong
        if keep:
            yield at, fields, length, payload


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b,
            LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringContains: lambda a, b: b in a,
            StringStartsWith: lambda a, b: a.startswith(b), StringEndsWith: lambda a, b: a.endswith(b)}


def _supported(test) -> bool:
    if isinstance(test, Not):
        return _supported(test.child)
    return (type(test) in _COMPARE or isinstance(test, (EqualNullSafe, IsNull, IsNotNull))) and len(test.attribute) == 1 and (
        test.attribute[0] in FIELDS or test.attribute[0] in ("offset", "content_length"))


def _holds(test, row):
    """SQL truth of a pushed predicate: True, False or None for unknown."""
    if isinstance(test, Not):
        inner = _holds(test.child, row)
        return None if inner is None else not inner
    have = row(test.attribute[0])
    if isinstance(test, (IsNull, IsNotNull)):
        return (have is None) == isinstance(test, IsNull)
    if isinstance(test, EqualNullSafe):
        return have == test.value
    if have is None or test.value is None:
        return None
    if type(test) is In and have not in test.value and None in test.value:
        return None
    return _COMPARE[type(test)](have, test.value)


@dataclass
class Archives(InputPartition):
    files: list


class WarcReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.path, self.tests = schema, options["path"], []
        self.partition_bytes = int(options.get("partitionBytes", PARTITION_BYTES))

    def pushFilters(self, filters):
        for test in filters:
            if _supported(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self):
        fs, path = _filesystem(self.path)
        out, size = [], 0
        for name, n in sorted(archives(fs, path)):
            if not out or size + n > self.partition_bytes:
                out.append(Archives([]))
                size = 0
            out[-1].files.append(name)
            size += n
        return out or [Archives([])]

    def read(self, partition):
        fs, _ = _filesystem(self.path)
        names = [f.name for f in self.schema.fields]
        schema = to_arrow_schema(self.schema)
        rows, size = [], 0

        def wanted(fields, at, length):
            own = {"offset": at, "content_length": length}
            return all(_holds(t, lambda c: own[c] if c in own else fields.get(FIELDS[c].lower())) for t in self.tests)

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)

        for name in partition.files:
            with fs.open_input_file(name) as source:
                for at, fields, length, payload in read_records(source, name.endswith(".gz"), wanted, "payload" in names):
                    have = {"file": name, "offset": at, "content_length": length, "headers": list(fields.items()), "payload": payload}
                    rows.append([have[c] if c in have else fields.get(FIELDS[c].lower()) for c in names])
                    size += 1000 + len(payload or b"")
                    if size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


def archives(fs, path: str):
    """(name, size) of the archives at ``path``: a file, or a folder's committed ones, or all if it has no manifest."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = {f.base_name: f for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File}
    listed = [json.loads(fs.open_input_file(f.path).read()) for f in inside.values() if _MANIFEST.match(f.base_name)]
    names = {n for one in listed for n in one} if listed else {n for n in inside if n.endswith((".warc", ".warc.gz"))}
    return [(inside[n].path, inside[n].size) for n in names]


_MANIFEST = re.compile(r"_manifest-.*\.json$")


# ---- writing ----

def _clean(value: str) -> str:
    """A header value on one line; blanks and controls are percent-encoded, so no value can end its line."""
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", value)


def record_bytes(row: dict) -> bytes:
    """One record: named fields, then the block; a response carries its payload as an HTTP message."""
    kind, payload = row["record_type"], row.get("payload") or b""
    content = row.get("content_type")
    if kind == "revisit":
        block, content = b"", "application/http;msgtype=response"
    elif kind == "response":
        head = f"HTTP/1.1 200 OK\r\nContent-Type: {content or 'application/octet-stream'}\r\nContent-Length: {len(payload)}\r\n\r\n"
        block, content = head.encode() + payload, "application/http;msgtype=response"
    else:
        block = payload
    lines = ["WARC/1.1"]
    for column, field in FIELDS.items():
        value = content if column == "content_type" else row.get(column)
        if value is not None:
            lines.append(f"{field}: {value if column == 'content_type' else _clean(value)}")
    if kind == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    extra = row.get("headers") or {}
    lines += [f"{name}: {_clean(value)}" for name, value in (extra.items() if isinstance(extra, dict) else extra)]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    """A gzip member that states its own compressed and full length in an ``sl`` field."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    total = 10 + 2 + 12 + len(body) + 8
    large = max(total, len(data)) >= 1 << 32
    extra = struct.pack("<H2sHII", 12, b"sl", 8, 0 if large else total, 0 if large else len(data))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options, overwrite):
        self.path, self.overwrite, self.job = options["path"], overwrite, uuid.uuid4().hex
        self.compressed = options.get("compression", "gzip") != "none"
        self.archive_bytes = int(options.get("archiveBytes", ARCHIVE_BYTES))

    def write(self, iterator):
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, out = [], None

        def put(row):
            data = record_bytes(row)
            out.write(gzip_member(data) if self.compressed else data)

        try:
            for batch in iterator:
                for row in batch.to_pylist():
                    if out is None or out.tell() >= self.archive_bytes:
                        if out is not None:
                            out.close()
                        files.append(f"part-{self.job}-{uuid.uuid4().hex}.warc" + ".gz" * self.compressed)
                        out = fs.open_output_stream(f"{path}/{files[-1]}", compression=None)
                        put({"record_type": "warcinfo", "record_id": f"<urn:uuid:{uuid.uuid4()}>", "date": row.get("date"),
                             "content_type": "application/warc-fields", "payload": b"format: WARC File Format 1.1\r\n"})
                    put(row)
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        before = [f.path for f in fs.get_file_info(pafs.FileSelector(path)) if f.type == pafs.FileType.File] if self.overwrite else []
        names = [n for m in messages if m for n in m.files]
        with fs.open_output_stream(f"{path}/_manifest-{self.job}.json") as out:
            out.write(json.dumps(names).encode())
        new = {f"{path}/{n}" for n in names}
        old = [f for f in before if f not in new and re.search(r"(/_manifest-[^/]*\.json|\.warc|\.warc\.gz)$", f)]
        for name in sorted(old, key=lambda f: not f.endswith(".json")):  # the list first: half removed is never half read
            fs.delete_file(name)

    def abort(self, messages):
        fs, path = _filesystem(self.path)
        for name in [n for m in messages if m for n in m.files]:
            fs.delete_file(f"{path}/{name}")


class WarcDataSource(DataSource):
    """``spark.read.format("warc")``; options ``path``, ``partitionBytes``, and ``compression``, ``archiveBytes`` for writing.

    A schema given by the caller chooses columns of ``SCHEMA``; without ``payload`` no block is decoded.
    """

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(schema, self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


def register(spark):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def read_warc(spark, path: str, columns=None, **options) -> DataFrame:
    """Records of the archives at ``path``; ``columns`` of ``SCHEMA``, all by default.

    ``file``, ``offset`` (where the record starts, in stored bytes), ``content_length``, one column per
    field of ``FIELDS``, all fields under lower-case names in ``headers``, and ``payload``: the body of
    an HTTP record, the block of another, null for a revisit.  A missing field is null.  A broken
    record is an error that names its place.  Filters on type and header columns are tested before
    anything is decoded.  A folder without archives gives an empty table.
    """
    register(spark)
    kinds = dict(part.strip().split(" ", 1) for part in re.split(r",(?![^<]*>)", SCHEMA))
    chosen = ", ".join(f"{c} {kinds[c]}" for c in columns or kinds)
    return spark.read.format("warc").schema(chosen).options(**options).load(path)


def write_warc(records: DataFrame, path: str, mode="append", **options):
    """Write records (columns of ``SCHEMA``; ``record_type`` and ``record_id`` needed) as archives under ``path``.

    Each archive starts with a warcinfo record.  White space and controls in header values are
    percent-encoded, a null field is left out, a null payload is empty.
    """
    register(records.sparkSession)
    records.write.format("warc").mode(mode).options(**options).save(path)


# ---- pages ----

def page_records(pages: DataFrame, date: str = "1970-01-01T00:00:00Z", least: int = LEAST_PAYLOAD) -> DataFrame:
    """A WARC record for each row of ``pages(page_id, url, html)``.

    Of rows with equal payloads of ``least`` bytes or more, that with the smallest page_id is a
    response and the others are revisits that refer to it; smaller ones are responses.  A null html
    is an empty payload, a null url has no target field.  Rows with the smallest id are all
    responses where it is repeated; among rows without an id nothing can be referred to, so they
    stay responses unless another row has one.  Further columns are ignored.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    known = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n"))
    groups = known.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("rows"))
    groups = groups.where("rows > 1 AND first IS NOT NULL").select("digest", "first")
    name = lambda page: F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), "digest", F.lit(">"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return known.join(groups, "digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(again, name(F.col("first"))).alias("refers_to"), F.lit("text/html; charset=utf-8").alias("content_type"),
        F.create_map(F.lit("X-Payload-Bytes"), F.col("n").cast("string")).alias("headers"),
        F.when(~again, F.col("payload")).alias("payload"))


def page_of(record_id):
    """The page_id in a record id that ``page_records`` gave; null where the page had none."""
    return F.regexp_extract(record_id, "^<urn:x-page:(-?[0-9]*):", 1).try_cast("long")


def read_pages(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of archived pages.

    Size and digest of a response are taken from its payload; those of a revisit, whose payload
    isn't stored, from its header.
    """
    full = read_warc(spark, path, ["record_type", "record_id", "target_uri", "payload"]).where(F.col("record_type") == "response")
    full = full.select(page_of("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
                       F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"),
                       F.col("target_uri").alias("url"))
    short = read_warc(spark, path, ["record_type", "record_id", "target_uri", "payload_digest", "refers_to", "headers"]).where(
        F.col("record_type") == "revisit")
    short = short.select(page_of("record_id").alias("page_id"), F.col("headers")["x-payload-bytes"].cast("long").alias("payload_bytes"),
                         F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type",
                         page_of("refers_to").alias("refers_to"), F.col("target_uri").alias("url"))
    return full.unionByName(short)


def op12_warc(spark, sf_dir):
    path = f"{shared_dir(spark)}/dayloom-llm/warc-{uuid.uuid4().hex}"
    write_warc(page_records(table(spark, sf_dir, "pages")), path)
    return read_pages(spark, path)


OP12_SQL = f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d),
r AS (SELECT *, payload_bytes >= {LEAST_PAYLOAD} AND first IS NOT NULL AND page_id IS DISTINCT FROM first AS again FROM f)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to, url
FROM r
"""
