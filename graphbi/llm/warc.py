"""Legacy archive converter: ARC 1 and 2 files to WARC/1.1, and readers for both.

Archives are written by Spark's text writer (gzip), one file a task: the line
separator is the format's own record separator, so a file is exactly its
records.  They are read by the text reader as pieces between empty lines; the
pieces of a file are joined again until a header's declared length is
fulfilled, so it doesn't matter where the separator occurs, and a task holds
one record at a time.  A malformed archive raises an error with the file's name.

Each archive is parsed once: converted records are stored.  Only records whose
payload may occur twice (a Bloom filter of the repeated digests) go through
the join that marks revisits; all others go straight to the writer.

Null urls, bodies and ids, repeated rows, empty tables and pages of any length
have the results that the functions state; further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm import bloom
from graphbi.llm.common import arrow_map, fields, stored, table, to_batch
from graphbi.session import scratch_path

#: Record separators of the two formats and field lists of the ARC versions (fixed by the formats).
ARC_END, WARC_END = b"\n", b"\r\n\r\n"
#: What the readers split files at; it ends the headers of both formats' HTTP blocks, and is rare elsewhere.
READ_AT = b"\r\n\r\n"
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}
#: Pages carry no fetch time; the legacy archives of the query state this one.
ARC_DATE = "20200101000000"
#: Payloads shorter than this are all responses.
MIN_REVISIT_BYTES = 0
_IDS = uuid.uuid5(uuid.NAMESPACE_URL, "urn:graphbi:arc")
_RECORDS_PER_BATCH, _BYTES_PER_BATCH = 1000, 8 << 20


# -- writing ARC -----------------------------------------------------------------------------------------

def arc_header(version: int, url: str, date: str, kind: str, length: int, code: str = "200", checksum: str = "-", file: str = "-") -> bytes:
    """A URL-record line of the version; spaces in the URL are %20, line ends %0A and %0D."""
    url = (url or "unknown:").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D")
    values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": kind, "Archive-length": str(length),
              "Result-code": code, "Checksum": checksum, "Location": "-", "Offset": "0", "Filename": file}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode() + b"\n"


def arc_version_block(version: int, name: str, date: str = ARC_DATE) -> bytes:
    body = f"{version} 0 graphbi\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    return arc_header(version, f"filedesc://{name}", date, "text/plain", len(body), file=name) + body


def _write(records: DataFrame, path: str, end: bytes) -> None:
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", end.decode()).option("compression", "gzip").text(path)


def write_arc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> None:
    """An ARC file per partition, versions 1 and 2 in turn; a record's block is an HTTP response with the page's id in a header.

    A null body is an empty payload; a null id is written without the header.
    """
    from pyspark import TaskContext

    def start():
        part = TaskContext.get().partitionId()
        version, opened = 1 + part % 2, []

        def work(batch: pa.RecordBatch) -> dict:
            out = []
            if not opened:
                opened.append(True)
                out.append(arc_version_block(version, f"part-{part:05d}.arc"))
            for page, url, body in zip(*[batch.column(c) for c in ("page", "url", "body")], strict=True):
                page, payload = page.as_py(), (body.as_py() or "").encode()
                ident = "" if page is None else f"X-Page-Id: {page}\r\n"
                block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{ident}\r\n".encode() + payload
                out.append(arc_header(version, url.as_py(), ARC_DATE, "text/html", len(block), checksum=hashlib.md5(block).hexdigest()) + block)
            return {"record": out}
        return work

    rows = pages.select(F.col(id_col).cast("string").alias("page"), F.col(url_col).alias("url"), F.col(body_col).alias("body"))
    _write(arrow_map(rows, "record binary", start), path, ARC_END)


# -- reading: a byte stream from pieces ------------------------------------------------------------------

class _Stream:
    """The bytes of one file, given as pieces between separators."""

    def __init__(self, end: bytes):
        self.end, self.parts, self.size, self.first = end, [], 0, True

    def add(self, piece: bytes) -> None:
        if not self.first:
            self.parts.append(self.end)
            self.size += len(self.end)
        self.first = False
        self.parts.append(piece)
        self.size += len(piece)

    def data(self) -> bytes:
        if len(self.parts) > 1:
            self.parts = [b"".join(self.parts)]
        return self.parts[0] if self.parts else b""

    def cut(self, n: int) -> bytes:
        data = self.data()
        self.parts, self.size = [data[n:]], len(data) - n
        return data[:n]


def _records(pieces: Iterator[tuple[str, bytes]], head_size, length_of) -> Iterator[tuple[str, bytes, bytes]]:
    """(file, header, block) in file order; head_size(data) is the header's length or -1, length_of(header, file) the declared one."""
    stream, file, header, need = _Stream(READ_AT), None, None, 0

    def drain(last: bool):
        nonlocal header, need
        while True:
            if header is None:
                if not last and not stream.size:
                    return
                data = stream.data()
                blank = len(data) - len(data.lstrip(b"\r\n"))
                if blank:
                    stream.cut(blank)
                    data = stream.data()
                n = head_size(data)
                if n < 0:
                    if last and data.strip():
                        raise ValueError(f"{file}: a record's header is cut off")
                    return
                header = stream.cut(n)
                need = length_of(header, file)
            if stream.size < need:
                if last:
                    raise ValueError(f"{file}: declared {need} bytes, found {stream.size}")
                return
            yield file, header, stream.cut(need)
            header = None

    for at, piece in pieces:
        if at != file:
            yield from drain(True)
            stream, file, header = _Stream(READ_AT), at, None
        stream.add(piece)
        yield from drain(False)
    yield from drain(True)


def _read(spark: SparkSession, path: str, ddl: str, parse) -> DataFrame:
    """Rows parse(records) of the archives below ``path``; parse takes (file, piece) pairs and yields dicts."""
    lines = (spark.read.option("lineSep", READ_AT.decode()).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")))
    schema = fields(ddl)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        pieces = ((f.as_py(), p.as_py()) for b in batches for f, p in zip(b.column("file"), b.column("piece"), strict=True))
        rows, size = [], 0
        for row in parse(pieces):
            rows.append(row)
            size += sum(len(x) for x in row.values() if isinstance(x, bytes))
            if len(rows) >= _RECORDS_PER_BATCH or size >= _BYTES_PER_BATCH:
                yield to_batch(arrow, {f: [r[f] for r in rows] for f in arrow.names})
                rows, size = [], 0
        if rows:
            yield to_batch(arrow, {f: [r[f] for r in rows] for f in arrow.names})

    return lines.mapInArrow(run, schema)


def is_version_block(url: str, block: bytes) -> bool:
    """The first record of a file (or of a file appended to it); a page fetched from a filedesc: url is an HTTP response."""
    return url.startswith("filedesc:") and not is_http(block)


def _parse_arc(pieces):
    names: dict[str, tuple[str, ...]] = {}

    def length_of(line: bytes, file: str) -> int:
        return int(line.rsplit(b" ", 1)[1])

    for file, line, block in _records(pieces, lambda d: d.find(b"\n") + 1 or -1, length_of):
        values = line.decode("utf-8", "replace").rstrip("\r\n").split(" ")
        if is_version_block(values[0], block):
            version, listed = block.split(b"\n")[:2]
            names[file] = tuple(listed.decode().split(" "))
            if names[file] != ARC_FIELDS.get(int(version.split(b" ")[0])):
                raise ValueError(f"{file}: unknown ARC field list {listed!r}")
        if file not in names:
            raise ValueError(f"{file}: no version block")
        if len(values) > len(names[file]):  # a type such as "text/html; charset=x" holds spaces
            extra = len(values) - len(names[file])
            values[3:4 + extra] = [" ".join(values[3:4 + extra])]
        head = dict(zip(names[file], values, strict=True))
        yield {"file": file, "version": len(names[file]) // 5, "url": head["URL"], "ip": head["IP-address"], "date": head["Archive-date"],
               "content_type": head["Content-type"], "block": block}


ARC_ROW = "file string, version int, url string, ip string, date string, content_type string, block binary"


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record, the version blocks included."""
    return _read(spark, path, ARC_ROW, _parse_arc)


# -- ARC to WARC -----------------------------------------------------------------------------------------

def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def is_http(block: bytes) -> bool:
    return block.startswith(b"HTTP/")


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """(status line and headers with the empty line, payload); without HTTP all is payload."""
    n = block.find(b"\r\n\r\n") if is_http(block) else -1
    return (block[:n + 4], block[n + 4:]) if n >= 0 else (b"", block)


def http_header(head: bytes, name: bytes) -> str | None:
    for line in head.split(b"\r\n"):
        key, sep, value = line.partition(b":")
        if sep and key.strip().lower() == name:
            return value.strip().decode("utf-8", "replace")
    return None


def warc_type(url: str, block: bytes = b"") -> str:
    """response for an HTTP block, whatever the url; else by the url: warcinfo for the version block, resource for dns and the like."""
    if is_http(block):
        return "response"
    scheme = url.split(":", 1)[0].lower()
    return "warcinfo" if scheme == "filedesc" else "response" if scheme in ("http", "https", "unknown") or "://" in url or ":" not in url else "resource"


def warc_date(date: str) -> str:
    """ISO 8601 of 14 (or fewer, padded) digits."""
    d = (date + "00000101000000"[len(date):])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(url: str, date: str, page: str | None, digest: str) -> str:
    """The same for the same capture, so that a repeated conversion gives the same archive."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{url} {date} {page} {digest}')}>"


CONVERTED = "url string, date string, content_type string, type string, page string, record_id string, payload_digest string, payload_bytes bigint, block binary"


def convert(arc: DataFrame) -> DataFrame:
    """Equivalent WARC fields of ARC records: identifier, timestamp, type and payload digest."""
    names = fields(CONVERTED).names

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in names}
            for url, date, kind, block in zip(*[batch.column(c).to_pylist() for c in ("url", "date", "content_type", "block")], strict=True):
                head, payload = split_http(block)
                digest, page = sha1_base32(payload), http_header(head, b"x-page-id")
                row = {"url": url, "date": warc_date(date), "content_type": kind, "type": warc_type(url, block), "page": page, "block": block,
                       "record_id": record_id(url, date, page, digest), "payload_digest": digest, "payload_bytes": len(payload)}
                for c, x in row.items():
                    out[c].append(x)
            return out
        return work

    return arrow_map(arc.select("url", "date", "content_type", "block"), CONVERTED, start)


def mark_revisits(records: DataFrame, min_bytes: int = MIN_REVISIT_BYTES, id_type: str = "bigint") -> DataFrame:
    """Adds refers_to (the page) and refers_id (the record): of equal payloads the smallest page is the response.

    Every row that has the smallest page stays a response, repeated rows too;
    a null page revisits a page that isn't null.  Payloads are equal if digest
    and size are.
    """
    page = F.col("page").cast(id_type)
    enough = (F.col("type") == "response") & (F.col("payload_bytes") >= min_bytes)
    payload = ["payload_digest", "payload_bytes"]
    # the first record of each repeated payload, pre-aggregated from the columns beside the blocks
    firsts = (records.where(enough).groupBy(*payload).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(page.isNull(), page.alias("page"), "record_id")).alias("first"))
              .where("n > 1").select(*payload, F.col("first.page").alias("first_page"), F.col("first.record_id").alias("first_id")))
    firsts = stored(firsts, "llm-first-records")
    shared = records.sparkSession.sparkContext.broadcast(bloom.build(firsts, F.xxhash64(*payload), firsts.count()))

    @F.pandas_udf("boolean")
    def may_repeat(hashes: pd.Series) -> pd.Series:
        return pd.Series(bloom.probe(shared.value, hashes.to_numpy()))

    marked = records.withColumn("_may", enough & may_repeat(F.xxhash64(*payload)))
    some = marked.where("_may").join(firsts, payload, "left")
    revisit = F.col("first_id").isNotNull() & ~page.eqNullSafe(F.col("first_page"))
    some = some.withColumn("refers_to", F.when(revisit, F.col("first_page"))).withColumn("refers_id", F.when(revisit, F.col("first_id")))
    rest = marked.where(~F.col("_may")).withColumn("refers_to", F.lit(None).cast(id_type)).withColumn("refers_id", F.lit(None).cast("string"))
    return some.drop("_may", "first_page", "first_id").unionByName(rest.drop("_may"))


def write_warc(records: DataFrame, path: str) -> None:
    """A WARC/1.1 file per partition. A revisit holds its HTTP headers only; its digest is that of the full payload."""
    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = []
            names = ("url", "date", "content_type", "type", "record_id", "payload_digest", "refers_to", "refers_id", "block")
            for url, date, kind, type_, rid, digest, to, to_id, block in zip(*[batch.column(c).to_pylist() for c in names], strict=True):
                head, _ = split_http(block)
                revisit = to is not None
                body = head if revisit else block
                lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else type_}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}"]
                lines += [f"WARC-Filename: {url.removeprefix('filedesc://')}"] if type_ == "warcinfo" else [f"WARC-Target-URI: {url}"]
                lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(body)}"]
                if revisit:
                    lines += [f"WARC-Refers-To: {to_id}", f"WARC-Refers-To-Page: {to}",
                              "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                http = "application/http; msgtype=response"
                lines += [f"Content-Type: {'application/warc-fields' if type_ == 'warcinfo' else http if head else kind}", f"Content-Length: {len(body)}"]
                out.append(("\r\n".join(lines) + "\r\n\r\n").encode() + body)
            return {"record": out}
        return work

    rows = records.withColumn("refers_to", F.col("refers_to").cast("string"))
    _write(arrow_map(rows, "record binary", start), path, WARC_END)


def _parse_warc(pieces):
    def length_of(head: bytes, file: str) -> int:
        return int(http_header(head, b"content-length"))

    def head_size(data: bytes) -> int:
        n = data.find(b"\r\n\r\n")
        return n + 4 if n >= 0 else -1

    for file, head, block in _records(pieces, head_size, length_of):
        if not head.startswith(b"WARC/1."):
            raise ValueError(f"{file}: not a WARC record: {head[:40]!r}")
        http, payload = split_http(block)
        if http_header(head, b"warc-block-digest") != f"sha1:{sha1_base32(block)}":
            raise ValueError(f"{file}: block digest of {http_header(head, b'warc-record-id')} differs")
        type_ = http_header(head, b"warc-type")
        digest = (http_header(head, b"warc-payload-digest") or "").removeprefix("sha1:")
        size = len(payload)
        if type_ == "revisit":  # the headers of the response it stands for declare the payload's size
            size = int(http_header(http, b"content-length"))
        elif digest and digest != sha1_base32(payload):
            raise ValueError(f"{file}: payload digest of {http_header(head, b'warc-record-id')} differs")
        yield {"file": file, "type": type_, "record_id": http_header(head, b"warc-record-id"), "date": http_header(head, b"warc-date"),
               "url": http_header(head, b"warc-target-uri"), "page": http_header(http, b"x-page-id"), "payload_digest": digest, "payload_bytes": size,
               "refers_id": http_header(head, b"warc-refers-to"), "refers_to": http_header(head, b"warc-refers-to-page"), "payload": payload}


WARC_ROW = ("file string, type string, record_id string, date string, url string, page string, payload_digest string, payload_bytes bigint, "
            "refers_id string, refers_to string, payload binary")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record with declared lengths and digests checked; a revisit's payload is empty, its size and digest are the full payload's."""
    return _read(spark, path, WARC_ROW, _parse_warc)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as legacy archives, converted to WARC, and read back from the WARC files.

    A row per page, whatever its url.  Null html is an empty payload.  Empty table: no archives, no rows.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    root, kind = scratch_path(spark, "llm-archives"), dict(pages.dtypes)["page_id"]
    write_arc(pages, f"{root}/arc")
    records = stored(convert(read_arc(spark, f"{root}/arc")), "llm-records")
    write_warc(mark_revisits(records, id_type=kind), f"{root}/warc")
    back = read_warc(spark, f"{root}/warc").where("type != 'warcinfo'")
    return back.select(F.col("page").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
                       F.col("refers_to").cast(kind).alias("refers_to"))


# DuckDB has no SHA-1; everything but payload_digest can be compared (see the tests).
SQL = None
