"""Legacy archive converter: ARC files to WARC files, and readers and writers of both.

ARC: version 1 and 2 files are told apart by their `filedesc:` block, whose second line names the
version; the header line of each record then has 5 or 10 fields, the last of which is the declared
length of the document that follows. Documents are taken by that length, never by searching.

WARC: each document becomes a record with a synthesised identifier (a UUID from file name and
offset, so a repeated conversion gives the same one), a W3C timestamp from the 14-digit ARC date,
type, and SHA-1 digests of payload and block; the ARC's address and media type are kept. A document
without an HTTP header becomes a resource of its media type. Of documents with equal payloads of at
least `least_bytes` bytes, the one with the largest id stays a response; others become revisits, which
keep the HTTP header but not the payload and name the response's identifier, URL and date.

Files are written and read by Spark only (text sink with the record's end mark as line separator,
gzip; binaryFile source), so any store that Spark knows will do. Payloads are bytes throughout.
The sink makes one gzip member of a file, not one of each record, and the source takes files of less
than 2 GB, compressed; writers make a file of each partition.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm.shared import new_path, staged, tune

#: Fields of a record's header line by ARC version.
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
ID_HEADER = b"X-Row-Id"
DATE = "20240102030405"
#: Revisits that may be broadcast, at about 100 bytes each.
MOST_BROADCAST = 200_000
RECORDS = "id long, url string, ip string, arc_date string, mime string, http string, payload binary, payload_bytes long, payload_sha1 string, origin string"
RESULT = "id long, url string, record_id string, warc_date string, record_type string, refers_to long, payload_digest string, payload_bytes long, block_bytes long, payload binary"


def arc_document(row_id: int | None, payload: bytes) -> bytes:
    """An HTTP response with the payload; the row's id travels as a header."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n" % len(payload)
    if row_id is not None:
        head += b"%s: %d\r\n" % (ID_HEADER, row_id)
    return head + b"\r\n" + payload


def arc_field(value: str | None) -> str:
    """A field of a header line: no white space, `-` if there is nothing."""
    return "".join("%%%02X" % ord(c) if c in " \t\r\n\x0b\x0c" else c for c in value or "") or "-"


def write_arc(df: DataFrame, path: str, version: int | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Writes df as ARC files, one per partition, of one version or, with None, of both by turns.
    Null payloads are empty ones."""
    tune(df.sparkSession)
    wanted = version

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        version = wanted or 1 + TaskContext.get().partitionId() % 2
        fields = V2 if version == 2 else V1
        told = f"{version} 0 converter\n{fields}\n".encode()
        first = f"filedesc://part.arc 0.0.0.0 {DATE} text/plain {'200 - - 0 part.arc ' if version == 2 else ''}{len(told)}\n".encode() + told
        for b in batches:
            out, size = [first] if first else [], 0
            first = b""
            ids, urls, payloads = b.columns
            for i in range(len(b)):
                payload = payloads[i].as_py() or b""
                doc = arc_document(ids[i].as_py(), payload)
                head = f"{arc_field(urls[i].as_py())} 0.0.0.0 {DATE} text/html {'200 - - 0 part.arc ' if version == 2 else ''}{len(doc)}\n"
                out.append(head.encode() + doc)
                size += len(doc)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("binary").alias("payload"))
    rows.mapInArrow(lines, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\n").option("compression", "gzip").mode("append").text(path)


class Source:
    """Reads forward over the pieces of a gzip stream or plain bytes; holds one piece and what is asked for."""

    def __init__(self, data: memoryview) -> None:
        self.data, self.at, self.have, self.offset = data, 0, bytearray(), 0
        self.inflate = zlib.decompressobj(31) if data[:2] == b"\x1f\x8b" else None

    def more(self) -> bool:
        if self.at >= len(self.data) and not (self.inflate and self.inflate.unconsumed_tail):
            return False
        piece = self.data[self.at : self.at + (1 << 18)]
        self.at += len(piece)
        while self.inflate and len(piece):
            self.have += self.inflate.decompress(piece)
            piece = self.inflate.unused_data
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
        if not self.inflate:
            self.have += piece
        return True

    def line(self, end: bytes = b"\n") -> bytes | None:
        """Up to end, which is taken but not returned; None when nothing is left."""
        seen = 0
        while (i := self.have.find(end, seen)) < 0:
            seen = max(0, len(self.have) - len(end))
            if not self.more():
                if not self.have:
                    return None
                i = len(self.have)
                break
        return self.take(i + len(end))[:i]

    def take(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        got = bytes(memoryview(self.have)[:n])
        del self.have[:n]
        self.offset += len(got)
        return got


def http_parts(doc: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Header with its empty line, payload, fields by lower-cased name. Without a header all is payload."""
    if not doc.startswith(b"HTTP/") or (cut := doc.find(b"\r\n\r\n")) < 0:
        return b"", doc, {}
    fields = {}
    for line in doc[:cut].split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        fields[name.strip().lower()] = value.strip()
    return doc[: cut + 4], doc[cut + 4 :], fields


def whole(value: bytes | None) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def arc_records(data: memoryview, origin: str) -> Iterator[tuple]:
    """The records of one ARC file; a header line that its version doesn't allow ends it with an error."""
    source = Source(data)
    first = source.line()
    if first is None:
        return
    told = source.take(int(first.rsplit(b" ", 1)[1]))
    version = told.split(b" ", 1)[0]
    width = {b"1": 5, b"2": 10}.get(version)
    if not first.startswith(b"filedesc:") or width is None:
        raise ValueError(f"{origin}: no ARC version block")
    while True:
        at = source.offset
        line = source.line()
        if line is None:
            return
        if not line.strip():
            continue
        fields = line.rstrip(b"\r").split(b" ")
        if len(fields) != width or (length := whole(fields[-1])) is None:
            raise ValueError(f"{origin}: at {at} a header line of {len(fields)} fields, not {width}")
        doc = source.take(length)
        if len(doc) < length:
            raise ValueError(f"{origin}: at {at} {length} bytes are declared, {len(doc)} are there")
        head, payload, known = http_parts(doc)
        text = [x.decode("utf-8", "replace") for x in fields[:4]]
        yield (whole(known.get(ID_HEADER.lower())), None if text[0] == "-" else text[0], text[1], text[2], text[3], head.decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode(), payload, len(payload), hashlib.sha1(payload).hexdigest(), f"{origin}#{at}")


def in_batches(rows: Iterator[tuple], schema: pa.Schema, weight, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += weight(row)
        if size > limit or len(out) >= 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)


def arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def read_arc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of RECORDS, one per document of the ARC files under path; on request without payload and header."""
    tune(spark)
    schema = RECORDS if payload else ", ".join(x for x in RECORDS.split(", ") if x.split()[0] not in ("http", "payload"))
    kept = [i for i, x in enumerate(RECORDS.split(", ")) if x in schema.split(", ")]
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                origin = name.as_py().rsplit("/", 1)[-1]
                rows = arc_records(memoryview(content.as_buffer()).cast("B"), origin)
                yield from in_batches((tuple(r[i] for i in kept) for r in rows) if len(kept) < 10 else rows, arrow_schema(schema), lambda r: r[7] if payload else 100)

    return files.mapInArrow(parse, schema)


def warc_head(kind: str, record_id: str, date: str, url: str | None, block: bytes, payload_sha1: str, more: dict[str, str]) -> bytes:
    digest = lambda x: "sha1:" + base64.b32encode(x).decode()
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "WARC-Block-Digest": digest(hashlib.sha1(block).digest()), "WARC-Payload-Digest": digest(bytes.fromhex(payload_sha1))} | more
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + f"Content-Length: {len(block)}\r\n\r\n").encode()


def name_uuid(name: str) -> str:
    """The same name always gives the same identifier."""
    return str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def warc_info(origin: str) -> bytes:
    info = b"software: archive converter\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name_uuid('info ' + origin)}>\r\nWARC-Date: {warc_date(DATE)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info


def is_date(arc_date: str) -> bool:
    return arc_date.isascii() and arc_date.isdigit() and 4 <= len(arc_date) <= 14


def warc_date(arc_date: str) -> str:
    """14 digits to a W3C timestamp; shorter dates are filled up, others give the epoch."""
    d = arc_date if is_date(arc_date) else "19700101000000"
    d += "00000101000000"[len(d) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def revisits(keys: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """(origin, refers_to, first) of the records that repeat another's payload, from keys' id, url, arc_date,
    payload_sha1, payload_bytes and origin; first: origin, URL and date of what they refer to.

    Records that share the largest id are all responses, and the one of the least origin is referred to;
    one without an id never wins over one that has an id, and where none has an id all are responses.
    """
    large = keys.where(F.col("payload_bytes") >= least_bytes)
    first = F.min_by(F.struct("origin", "url", "arc_date"), F.when(F.col("id").isNotNull(), F.struct(-F.col("id"), "origin")))
    groups = large.groupBy("payload_sha1", "payload_bytes").agg(F.max("id").alias("refers_to"), first.alias("first"), F.count("*").alias("n")).where("n > 1 and refers_to is not null")
    joined = large.join(groups.drop("n"), ["payload_sha1", "payload_bytes"])
    return joined.where("id is null or id <> refers_to").select("origin", "refers_to", "first")


def with_revisits(records: DataFrame, found: DataFrame) -> DataFrame:
    """records with refers_to. Few revisits are broadcast, so that no payload is shuffled; many are joined."""
    few = found.count() <= MOST_BROADCAST
    return records.join(F.broadcast(found) if few else found, "origin", "left").select(*records.columns, "refers_to", "first")


def write_warc(records: DataFrame, path: str) -> None:
    """Writes records (RECORDS, refers_to and first) as WARC files, one per partition, each with a warcinfo."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started = False
        for b in batches:
            out = [] if started or not len(b) else [warc_info(str(b.column("origin")[0]))]
            started = started or bool(out)
            for r in b.to_pylist():
                refers = r["refers_to"]
                block = r["http"].encode() + (r["payload"] if refers is None else b"")
                more = {}
                if refers is not None:
                    first = r["first"]
                    more = {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{name_uuid(first['origin'])}>", "WARC-Refers-To-Target-URI": first["url"], "WARC-Refers-To-Date": warc_date(first["arc_date"]), "X-Refers-To-Row": str(refers), "X-Payload-Length": str(r["payload_bytes"])}
                if r["ip"] not in ("-", "0.0.0.0"):
                    more["WARC-IP-Address"] = r["ip"]
                if "/" in r["mime"]:
                    more["WARC-Identified-Payload-Type"] = r["mime"]
                    if not r["http"]:
                        more["Content-Type"] = r["mime"]
                if not is_date(r["arc_date"]):
                    more["X-Archive-Date"] = r["arc_date"]
                if r["id"] is not None:
                    more[ID_HEADER.decode()] = str(r["id"])
                kind = "revisit" if refers is not None else "response" if r["http"] else "resource"
                out.append(warc_head(kind, name_uuid(r["origin"]), warc_date(r["arc_date"]), r["url"], block, r["payload_sha1"], more) + block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    records.mapInArrow(lines, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").mode("append").text(path)


def warc_records(data: memoryview, origin: str) -> Iterator[tuple]:
    """The response, resource and revisit records of one WARC file."""
    source = Source(data)
    while (head := source.line(b"\r\n\r\n")) is not None:
        if not head.strip():
            continue
        lines = head.lstrip(b"\r\n").split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise ValueError(f"{origin}: no WARC record at {source.offset}")
        f = {k.strip().lower(): v.strip().decode("utf-8", "replace") for k, _, v in (x.partition(b":") for x in lines[1:])}
        block = source.take(int(f[b"content-length"]))
        source.take(4)
        kind = f.get(b"warc-type")
        if kind not in ("response", "resource", "revisit"):
            continue
        payload = block if kind == "resource" else http_parts(block)[1]
        digest = base64.b32decode(f[b"warc-payload-digest"].removeprefix("sha1:")).hex()
        if kind != "revisit" and hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"{origin}: the payload of {f[b'warc-record-id']} does not fit its digest")
        size = len(payload) if kind != "revisit" else whole(f.get(b"x-payload-length"))
        yield (whole(f.get(b"x-row-id")), f.get(b"warc-target-uri"), f[b"warc-record-id"].strip("<>").removeprefix("urn:uuid:"), f.get(b"warc-date"), kind, whole(f.get(b"x-refers-to-row")), digest, size, len(block), payload if kind != "revisit" else None)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of RESULT, one per response or revisit record of the WARC files under path; payloads are
    checked against their digests, and left out on request."""
    tune(spark)
    schema = RESULT if payload else RESULT.removesuffix(", payload binary")
    width = len(schema.split(", "))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                rows = warc_records(memoryview(content.as_buffer()).cast("B"), name.as_py())
                yield from in_batches((r[:width] for r in rows), arrow_schema(schema), lambda r: r[8] if payload else 100)

    return files.mapInArrow(parse, schema)


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = 1000) -> None:
    """ARC files under arc_path to WARC files under warc_path."""
    found = staged(revisits(read_arc(spark, arc_path, payload=False), least_bytes), "revisits")
    write_warc(with_revisits(read_arc(spark, arc_path), found), warc_path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: pages as ARC files of both versions, converted to WARC and read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    convert(spark, arc, warc)
    back = read_warc(spark, warc, payload=False)
    return back.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
q as (select page_id, octet_length(b) as n, sha1(b) as d from p),
g as (select d, n, max(page_id) as last from q where n >= 1000 group by d, n)
select q.page_id, cast(q.n as bigint) as payload_bytes, q.d as payload_digest,
       case when g.last is null or g.last = q.page_id then 'response' else 'revisit' end as record_type,
       case when g.last <> q.page_id then g.last end as refers_to
from q left join g on q.d = g.d and q.n = g.n
"""
