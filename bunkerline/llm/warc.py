"""WARC archives: written in segments, read back by reassembling continuation records.

**Writing.** Of rows with equal payloads of at least `least` bytes the one with the largest id (of equal ids the one that was
read last) becomes a `response`, the others a `revisit` that names it; all other rows are responses. A response holds
an HTTP message with chunked transfer framing; a message longer than `segment_bytes` is cut into a first record and
`continuation` records, which name the first one's id, their segment number and, on the last, the total length. Every record is a
gzip member of its own. Tasks write files of about `FILE_BYTES` through the file system that the folder's URI names; what counts is
the table of files that finished tasks return, so leftovers of lost or repeated attempts are never read.

**Reading.** One task reads a file as a stream, record by record. Messages in one piece are decoded there. Segments are dealt by
their origin's id, sorted by segment number and decoded while they pass: a message's head, its chunks and its digest never need
more than one segment in memory (the payload itself only with `payloads`). Revisits then meet the response they refer to.

Each record has `fault`, null where all is well: `segment k missing`, `total length`, `no total length`, `head`, `chunk`, `digest`
(differs from the stated one), `truncated` (a file ends within a record), `no response` (a revisit of something that is not
there). A repeated segment number counts once. A faulty record keeps what could be decoded before it.

Null texts are empty; null ids and urls are left out of the record and come back as null, repeated rows are rows of their own, and a
null id is smaller than any other. Ids come back as strings. Characters of a url that a header cannot hold are percent-encoded. An
empty table gives an empty archive and no rows. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bunkerline.llm.common import stash
from bunkerline.session import shared_dir

#: Payloads from here on are revisited; bytes of a segment, of a chunk and of a file, about.
LEAST, SEGMENT_BYTES, CHUNK_BYTES, FILE_BYTES = 1000, 8192, 4096, 64 << 20
#: Bytes that a message's head may have.
HEAD_BYTES = 1 << 16
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
PRINTABLE = "".join(map(chr, range(33, 127)))
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in [*parts, b""])


def record(headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))] if v is not None)
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + b"\r\n" + block + b"\r\n\r\n") + pack.flush()


def name(archive: str, row: int, segment: int = 1) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{archive}/{row}/{segment}'.encode()).digest())}>"


def records_of(archive: str, row: int, page: str | None, uri: str | None, payload: bytes, origin: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a row: a revisit of row `origin`, or a response in segments."""
    about = [("WARC-Date", DATE), ("WARC-Target-URI", None if uri is None else quote(uri, safe=PRINTABLE)), ("WARC-Page-ID", None if page is None else quote(page, safe=""))]
    digest = ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode())
    kind = ("Content-Type", "application/http; msgtype=response")
    own = ("WARC-Record-ID", name(archive, row))
    if origin is not None:
        yield record([("WARC-Type", "revisit"), own, *about, digest, kind, ("WARC-Profile", REVISIT), ("WARC-Refers-To", name(archive, origin))], HEAD + b"\r\n")
        return
    block = HEAD + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    n = -(-len(block) // segment_bytes)
    yield record([("WARC-Type", "response"), own, *about, digest, kind, ("WARC-Segment-Number", "1" if n > 1 else None)], block[:segment_bytes])
    for k in range(2, n + 1):
        last = ("WARC-Segment-Total-Length", str(len(block)) if k == n else None)
        yield record([("WARC-Type", "continuation"), ("WARC-Record-ID", name(archive, row, k)), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", own[1]), ("WARC-Segment-Number", str(k)), last], block[(k - 1) * segment_bytes : k * segment_bytes])


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", folder: str | None = None, segment_bytes: int = SEGMENT_BYTES, least: int = LEAST) -> DataFrame:
    """Write a row's records each; (path, n_records, n_bytes) of the files."""
    archive = uuid.uuid4().hex
    folder = f"{(folder or shared_dir(pages.sparkSession)).rstrip('/')}/warc-{archive}"
    rows = stash(pages.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("body"),
    ), "zstd")
    key = F.when(F.length("body") >= least, F.unhex(F.sha2("body", 256)))
    groups = rows.select("id", "row", key.alias("key")).where("key is not null").groupBy("key").agg(F.max(F.struct("id", "row"))["row"].alias("origin"), F.count("*").alias("n")).where("n > 1")
    joined = rows.withColumn("key", key).join(groups, "key", "left")
    joined = joined.select("row", F.col("id").cast("string").alias("page"), "url", "body", F.when(F.col("origin") != F.col("row"), F.col("origin")).alias("origin"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        at = TaskContext.get()
        files, out, size = [], None, 0
        where, path = FileSystem.from_uri(folder)
        for batch in batches:
            for row, page, uri, body, origin in zip(*(batch.column(c).to_pylist() for c in ("row", "page", "url", "body", "origin"))):
                if out is None:
                    where.create_dir(path, recursive=True)
                    file = f"part-{at.partitionId():05d}-{at.taskAttemptId()}-{len(files)}.warc.gz"
                    out, size = where.open_output_stream(f"{path}/{file}", compression=None), 0
                    files.append([f"{folder}/{file}", 0, 0])
                for data in records_of(archive, row, page, uri, body, origin, segment_bytes):
                    out.write(data)
                    files[-1][1:] = files[-1][1] + 1, files[-1][2] + len(data)
                if files[-1][2] >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in files], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    return stash(joined.mapInArrow(write, "path string, n_records long, n_bytes long"))


class Message:
    """An HTTP message that arrives in parts: its head, its payload's length and SHA-1, and the payload where it is kept."""

    def __init__(self, keep: bool):
        self.kept = [] if keep else None
        self.digest, self.n, self.seen = hashlib.sha1(), 0, 0
        self.fault: str | None = None
        self.state, self.left, self.held = "head", 0, b""

    def _out(self, data: bytes) -> None:
        self.digest.update(data)
        self.n += len(data)
        if self.kept is not None:
            self.kept.append(data)

    def feed(self, data: bytes) -> None:
        self.seen += len(data)
        data, self.held = self.held + data if self.held else data, b""
        at = 0
        while at < len(data) and not self.fault and self.state != "over":
            if self.state == "plain":
                self._out(data[at:])
                return
            if self.state == "data":
                part = data[at : at + self.left]
                self._out(part)
                at, self.left = at + len(part), self.left - len(part)
                if not self.left:
                    self.state = "end of data"
                continue
            mark = b"\r\n\r\n" if self.state == "head" else b"\r\n"
            end = data.find(mark, at)
            if end < 0:
                self.held = data[at:]
                if len(self.held) > HEAD_BYTES:
                    self.fault = "head" if self.state == "head" else "chunk"
                return
            line, at = data[at:end], end + len(mark)
            if self.state == "head":
                fields = [x.partition(b":") for x in line.lower().split(b"\r\n")[1:]]
                coded = any(k.strip() == b"transfer-encoding" and v.strip().split(b",")[-1].strip() == b"chunked" for k, _, v in fields)
                self.state = "size" if coded else "plain"
                if not line.startswith(b"HTTP/"):
                    self.fault = "head"
            elif self.state == "end of data":
                self.state, self.fault = "size", "chunk" if line else None
            elif self.state == "trailer":
                self.state = "trailer" if line else "over"
            else:
                digits = line.partition(b";")[0].strip()
                try:
                    self.left = int(digits, 16) if digits.isalnum() else -1
                except ValueError:
                    self.left = -1
                if self.left < 0:
                    self.fault = "chunk"
                else:
                    self.state = "data" if self.left else "trailer"

    def end(self) -> tuple[int, str, bytes | None, str | None]:
        if not self.fault and self.state not in ("plain", "over"):
            self.fault = "head" if self.state == "head" else "chunk"
        return self.n, self.digest.hexdigest(), None if self.kept is None else b"".join(self.kept), self.fault


def stated(digest: str | None) -> str | None:
    """A stated SHA-1 in hex; None if there is none that can be read."""
    label, _, value = (digest or "").partition(":")
    if label.lower() != "sha1":
        return None
    if len(value) == 40:
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex()
    except ValueError:
        return None


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (names in lower case) and block of every record of a file; a block that ends early is None."""
    while True:
        try:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line:
                return
            headers: dict[str, str] = {}
            field = ""
            good = line.startswith(b"WARC/")
            while good and (line := stream.readline()) not in (b"\r\n", b"\n"):
                good = line.endswith(b"\n")
                text = line.decode("utf-8", "replace")
                if text[:1] in " \t" and field:
                    headers[field] += " " + text.strip()
                else:
                    field, _, value = text.partition(":")
                    field = field.strip().lower()
                    headers[field] = value.strip()
            length = headers.get("content-length", "")
            block = stream.read(int(length)) if good and length.isdecimal() else None
        except (EOFError, zlib.error, gzip.BadGzipFile):
            headers, block = {}, None
        if block is None or len(block) < int(length):
            yield headers, None
            return
        yield headers, block


FIELDS = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("page", pa.string()), ("uri", pa.string()), ("refers", pa.string()), ("stated", pa.string()), ("origin", pa.string()),
    ("segment", pa.int64()), ("total", pa.int64()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("fault", pa.string()),
]
KINDS = {"record_id": "string", "segment": "long", "total": "long", "block": "binary", "payload_bytes": "long", "payload": "binary"}
RAW = ", ".join(f"{n} {KINDS.get(n, 'string')}" for n, _ in FIELDS)
WHOLE = ", ".join(f"{n} {KINDS.get(n, 'string')}" for n, _ in FIELDS if n not in ("origin", "segment", "total", "block"))


def _decoded(row: dict, message: Message, fault: str | None = None) -> dict:
    n, digest, payload, bad = message.end()
    wrong = "digest" if row["stated"] and row["stated"] != digest else None
    return row | {"payload_bytes": n, "payload_digest": digest, "payload": payload, "fault": row.get("fault") or fault or bad or wrong}


def _batches(rows: Iterator[dict], fields: list[tuple[str, pa.DataType]], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    schema, held, size = pa.schema(fields), [], 0
    for row in rows:
        held.append(row)
        size += 200 + len(row.get("block") or b"") + len(row.get("payload") or b"")
        if size > limit:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isdecimal() else None


def read_rows(stream: BinaryIO, keep: bool) -> Iterator[dict]:
    """Responses, revisits and continuations of a file; messages in one piece are decoded, segments carry their block."""
    for headers, block in records(stream):
        kind = headers.get("warc-type")
        if block is not None and kind not in ("response", "revisit", "continuation"):
            continue
        page, own = headers.get("warc-page-id"), headers.get("warc-record-id")
        row = {
            "record_id": own, "record_type": kind, "page": None if page is None else unquote(page), "uri": headers.get("warc-target-uri"), "refers": headers.get("warc-refers-to"),
            "stated": stated(headers.get("warc-payload-digest")), "origin": headers.get("warc-segment-origin-id", own), "segment": _number(headers.get("warc-segment-number")), "total": _number(headers.get("warc-segment-total-length")),
        }
        if block is None:
            yield row | {"segment": None, "fault": "truncated"}
        elif kind == "revisit":
            yield row | {"segment": None}
        elif row["segment"] is None:
            message = Message(keep)
            message.feed(block)
            yield _decoded(row, message)
        else:
            yield row | {"block": block}


def reassemble(rows: Iterator[dict], keep: bool) -> Iterator[dict]:
    """Rows sorted by origin and segment; those of one origin become one row."""
    row, message, expected, total, fault = None, None, 1, None, None

    def over() -> Iterator[dict]:
        if row is not None:
            bad = fault or ("no total length" if total is None else None if total == message.seen else "total length")
            yield _decoded(row, message, bad)

    for segment in rows:
        if segment["segment"] is None:
            yield segment
            continue
        if row is None or segment["origin"] != row["origin"]:
            yield from over()
            row, message, expected, total, fault = segment | {"block": None}, Message(keep), 1, None, None
            if segment["segment"] != 1:  # the first record is lost, and with it what is known of the page
                row |= {"record_id": segment["origin"], "record_type": "response", "page": None}
        number = segment["segment"]
        if number < expected:
            continue
        if number > expected:
            fault = fault or f"segment {expected} missing"
        expected, total = number + 1, total if segment["total"] is None else segment["total"]
        message.feed(segment["block"])
    yield from over()


def read_archives(files: DataFrame, payloads: bool = False) -> DataFrame:
    """(record_id, record_type, page, uri, refers_to, payload_bytes, payload_digest, payload, fault) of the responses and revisits in files named by `path`.

    refers_to is the page of the response that a revisit names, and payload_bytes, payload_digest and payload are that response's.
    """
    paths = files.select("path").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, inner = FileSystem.from_uri(path)
                with where.open_input_file(inner) as raw:
                    packed = raw.read(2) == b"\x1f\x8b"
                    raw.seek(0)
                    with gzip.GzipFile(fileobj=raw) if packed else raw as stream:
                        yield from _batches(read_rows(stream, payloads), FIELDS)

    def join_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        names = [n.split()[0] for n in WHOLE.split(", ")]
        yield from _batches(({n: r.get(n) for n in names} for r in reassemble(rows, payloads)), [(n, k) for n, k in FIELDS if n in names])

    raw = paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(read, RAW)
    whole = stash(raw.repartition("origin").sortWithinPartitions("origin", "segment").mapInArrow(join_segments, WHOLE), "zstd")
    same = ["payload_bytes", "payload_digest", "payload"]
    own = whole.where("record_type = 'response' or fault is not null").withColumn("refers_to", F.lit(None).cast("string"))
    revisits = whole.where("record_type = 'revisit' and fault is null").drop(*same)
    told = whole.where("record_type = 'response'").select(F.col("record_id").alias("refers"), F.col("page").alias("refers_to"), *same, F.col("fault").alias("theirs"), F.lit(True).alias("found"))
    met = revisits.join(told, "refers", "left")
    wrong = F.when(F.col("found").isNull(), "no response").when(F.col("theirs").isNotNull(), F.col("theirs")).when(F.col("stated") != F.col("payload_digest"), "digest")
    names = ["record_id", "record_type", "page", "uri", "refers_to", *same, "fault"]
    return own.select(names).unionByName(met.withColumn("fault", wrong).select(names))
