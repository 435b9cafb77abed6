"""WARC archives: written as one gzip stream each, normalised to a member a record.

``write_archives`` stores pages as a crawler that compresses whole files would: one
gzip stream over all records, which cannot be entered in the middle.  ``normalise``
inflates each such stream once, rewrites every record as a gzip member of its own and
writes a sidecar index of offsets beside it.  ``read_records`` then enters the
archives at those offsets, in any order and from any number of tasks.

Files are named at random and listed in tables that Spark commits, so a task that
runs twice leaves a file nobody lists, never a mixed one.  Streams are copied in
pieces; no task holds an archive, nor more than a record's header and a piece.
"""

from __future__ import annotations

import hashlib
import json
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medloom.llm.common import dealt, new_folder, saved

#: payloads from this size on are stored once
REVISIT_BYTES = 1000
#: an archive is closed when its records, inflated, pass this size
ARCHIVE_BYTES = 32 << 20
PIECE = 1 << 20
LEVEL = 6
DATE = "2024-01-01T00:00:00Z"
LISTED = "path string, records long"
MEMBERS = "path string, offset long, length long"
RECORDS = "page_id string, url string, record_type string, payload_bytes long, payload_digest string, refers_to string, payload binary"


def plan_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """``page_id, url, payload, refers_to``; ``refers_to`` is set for revisits.

    Payloads are equal if their SHA-256 and length are.  The digests are counted
    with map-side combining; only those that repeat are joined back.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload"))
    digest = F.unhex(F.sha2("payload", 256))
    repeated = (
        rows.where(F.octet_length("payload") >= least)
        .groupBy(digest.alias("digest"))
        .agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first").isNotNull())
        .select("digest", "first")
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("digest", digest).join(saved(repeated, "repeated"), "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("first").isNotNull() & other, F.col("first")).alias("refers_to")
    )


def page_uri(page_id) -> str:
    """The name of a page's record.  Ids are percent-encoded; a missing one has no second part."""
    return "<urn:page>" if page_id is None else f"<urn:page:{urllib.parse.quote(str(page_id), safe='')}>"


def page_of(uri: str | None) -> str | None:
    """The id that ``page_uri`` wrote."""
    found = re.fullmatch("<urn:page:([^>]*)>", uri or "")
    return found and urllib.parse.unquote(found[1])


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP header of its payload only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {page_uri(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{hashlib.sha1(payload).hexdigest()}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe=":/?#[]@!$&'()*+,;=~%-._"))
    if refers_to is not None:
        head += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {page_uri(refers_to)}",
        ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _open(folder: str):
    where, path = files.FileSystem.from_uri(folder)
    where.create_dir(path, recursive=True)
    return where, path


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``plan_records`` rows to ``folder``; the archives: ``path, records``."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _open(folder)
        out = None
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, gz, size, n = where.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(LEVEL, wbits=31), 0, 0
                data = record(*(v.as_py() for v in row))
                out.write(gz.compress(data))
                size, n = size + len(data), n + 1
                if size >= archive_bytes:
                    out.write(gz.flush())
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}])
        if out is not None:
            out.write(gz.flush())
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}])

    return saved(records.mapInArrow(write, LISTED), "archives")


class Stream:
    """Inflated bytes of a gzip file of any number of members."""

    def __init__(self, source):
        self.source, self.gz, self.buffer = source, zlib.decompressobj(31), b""

    def _more(self) -> bool:
        data = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        data = data or self.source.read(PIECE)
        if data:
            self.buffer += self.gz.decompress(data, PIECE)
            return True
        # what the inflater still holds when the input ends
        rest = b"" if self.gz.eof else self.gz.flush()
        self.buffer += rest
        return bool(rest)

    def header(self) -> bytes | None:
        """Up to and with the next empty line; None at the end."""
        while (at := self.buffer.find(b"\r\n\r\n")) < 0:
            if not self._more():
                if self.buffer.strip():
                    raise ValueError("an archive ends inside a record")
                return None
        head, self.buffer = self.buffer[: at + 4], self.buffer[at + 4 :]
        return head

    def pieces(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.buffer and not self._more():
                raise ValueError("an archive ends inside a record")
            piece, self.buffer = self.buffer[:length], self.buffer[length:]
            length -= len(piece)
            if piece:
                yield piece


def fields(header: bytes) -> dict[str, str]:
    """Names (lower case) and values of a WARC or HTTP header."""
    lines = header.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines if x)}


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives to ``folder``, a gzip member for each record.

    Returns the new archives: ``path, records``.  Beside each lies ``path + ".idx"``:
    a JSON line ``path, offset, length`` for every record, in order.
    """

    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, path = _open(folder)
        for batch in batches:
            for source in batch.column("path").to_pylist():
                name, offset, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                where, old = files.FileSystem.from_uri(source)
                with where.open_input_stream(old, compression=None) as data, to.open_output_stream(f"{path}/{name}", compression=None) as out, to.open_output_stream(f"{path}/{name}.idx", compression=None) as index:
                    stream = Stream(data)
                    while (head := stream.header()) is not None:
                        gz = zlib.compressobj(LEVEL, wbits=31)
                        length = out.write(gz.compress(head))
                        # the block and the two line ends behind it
                        for piece in stream.pieces(int(fields(head)["content-length"]) + 4):
                            length += out.write(gz.compress(piece))
                        length += out.write(gz.flush())
                        index.write(json.dumps({"path": f"{folder}/{name}", "offset": offset, "length": length}).encode() + b"\n")
                        offset, n = offset + length, n + 1
                yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": n}])

    # an archive is a task's work: gzip streams cannot be split
    each = dealt(archives.select("path"), archives.count(), "path")
    return saved(each.mapInArrow(rewrite, LISTED), "normalised")


def read_index(archives: DataFrame) -> DataFrame:
    """``path, offset, length`` of all records of the listed archives.

    Each task reads the index files of its archives; the driver lists nothing.  The
    records are dealt out by stretches of archives, as many as there are archives.
    """

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                where, at = files.FileSystem.from_uri(f"{path}.idx")
                with where.open_input_stream(at, compression=None) as lines:
                    rows = [json.loads(line) for line in lines.read().splitlines()]
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    n = archives.count()
    listed = saved(dealt(archives.select("path"), n, "path").mapInArrow(read, MEMBERS), "members")
    return dealt(listed, n, "path", "offset").sortWithinPartitions("path", "offset")


def parse(member: bytes) -> dict:
    """A record of ``RECORDS`` from its gzip member; checks length and digest."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(fields(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    revisit = warc["warc-type"] == "revisit"
    if not revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {warc['warc-record-id']}")
    return {
        "page_id": page_of(warc.get("warc-record-id")), "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"],
        "payload_bytes": size, "payload_digest": digest, "refers_to": page_of(warc.get("warc-refers-to")),
        "payload": None if revisit else payload,
    }


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The indexed records, each inflated from its own offset.

    ``payload`` is null for revisits, and for all if ``payloads`` is false; the
    digest of a response is checked either way.
    """
    schema = pa.schema([(k, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for k, t in (x.split() for x in RECORDS.split(", "))])

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows: list[dict] = []
            held = 0
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    where, at = files.FileSystem.from_uri(path)
                    name, source = path, where.open_input_file(at)
                source.seek(offset)
                rows.append(parse(source.read(length)))
                held += rows[-1]["payload_bytes"] if payloads else 0
                if not payloads:
                    rows[-1]["payload"] = None
                if held > 8 * PIECE or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    return index.mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, folder: str | None = None, payloads: bool = False) -> DataFrame:
    """Write pages to archives, normalise them and read all records back.

    One row per page with the columns of ``RECORDS``; ``page_id`` and ``refers_to``
    have the type of ``page_id``.  Null html is an empty payload; a null ``page_id``
    stays null, and payloads whose ids are all null are not revisited.  Of equal
    payloads of 1000 bytes or more, all rows with the largest ``page_id`` are
    responses.  Urls are percent-encoded where a header needs it; other columns are
    not archived.  Archives stay in ``folder`` (default: a new shared one).
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    kind = pages.schema["page_id"].dataType
    members = f"{folder}/members"
    archives = write_archives(plan_records(pages), f"{folder}/streams")
    listed = normalise(archives, members)
    if listed.isEmpty():
        return pages.sparkSession.createDataFrame([], RECORDS).withColumns(
            {c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}
        )
    found = read_records(read_index(listed), payloads)
    typed: dict[str, Column] = {c: F.col(c).cast(kind) for c in ("page_id", "refers_to")}
    return found.withColumns(typed)
