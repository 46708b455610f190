"""WARC: write records with revisits, segments and chunked bodies; read them back whole.

Rows are written once with a number of their own, from which a record's identifier is made. So a revisit
names the very record that holds its payload, also where page_ids repeat or are null, and the reader
resolves it by that identifier.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Equal payloads of at least this many bytes are stored once.
REVISIT_BYTES = 1000
#: Blocks above this many bytes are cut into continuation records.
SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
#: An archive is closed when it has reached this size.
ARCHIVE_BYTES = 2 << 20
#: Repeated payloads are broadcast up to this many rows (about 100 bytes each), joined by shuffle beyond.
BROADCAST_ROWS = 100_000

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Where the page_id of a record stands; the format lets readers skip fields that they don't know.
_PAGE = "X-Page-ID"


def record_id(space: str, number: int | str) -> str:
    """The identifier of a row's record in the set of archives ``space``."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{space}:{number}')}>"


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """A body in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(framed: bytes) -> bytes:
    """The body of a chunked framing; ValueError where it is broken or followed by anything."""
    at, parts = 0, []
    while True:
        end = framed.index(b"\r\n", at)
        size = int(framed[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            break
        if framed[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk has the wrong length")
        parts.append(framed[at : at + size])
        at += size + 2
    if not framed.endswith(b"\r\n", at) or framed[at:] != b"\r\n":
        raise ValueError("bytes follow the last chunk")
    return b"".join(parts)


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record; ValueError where an archive is broken."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        version, *lines = archive[at:end].decode().split("\r\n")
        if not version.startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
        start = end + 4
        at = start + int(headers["content-length"])
        if archive[at : at + 4] != b"\r\n\r\n":
            raise ValueError("a record has the wrong length")
        yield headers, archive[start:at]
        at += 4


def _clean(url: str | None) -> str:
    return "".join(c for c in url or "" if c not in "\r\n") or "about:blank"


class Writer:
    """Collects records and gives archives of about ``archive_bytes``.

    ``task`` numbers the writer: names of archives, and of records without a row number, are made from it.
    """

    def __init__(self, task: int, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, space: str = "archives"):
        self.task, self.segment, self.most, self.space = task, segment_bytes, archive_bytes, space
        self.n, self.closed, self.parts, self.size = 0, 0, [], 0

    def page(
        self, page_id: int | None, url: str | None, body: bytes, digest: str, refers_to: int | None, revisit: bool, row: int | None = None, refers_row: int | None = None
    ) -> Iterator[bytes]:
        self.n += 1
        name = record_id(self.space, f"{self.task}-{self.n}" if row is None else row)
        uri = ("WARC-Target-URI", _clean(url))
        head = [("WARC-Record-ID", name), ("WARC-Date", _DATE), uri, ("WARC-Payload-Digest", f"sha1:{digest}")]
        kind, own = ("Content-Type", "application/http; msgtype=response"), [(_PAGE, str(page_id))] * (page_id is not None)
        http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        if revisit:
            more = [("WARC-Type", "revisit"), ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(self.space, refers_row)), ("WARC-Refers-To-Date", _DATE), ("WARC-Truncated", "length")]
            yield from self.put(record([*more, *head, kind, *own], f"{http}Content-Length: {len(body)}\r\n\r\n".encode()))
            return
        block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(body)
        if len(block) <= self.segment:
            yield from self.put(record([("WARC-Type", "response"), *head, kind, *own], block))
            return
        count = -(-len(block) // self.segment)
        for k in range(1, count + 1):
            part = block[(k - 1) * self.segment : k * self.segment]
            if k == 1:
                fields = [("WARC-Type", "response"), *head, kind, *own]
            else:
                fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", record_id(self.space, f"{name}/{k}")), ("WARC-Date", _DATE), uri, ("WARC-Segment-Origin-ID", name)]
            fields.append(("WARC-Segment-Number", str(k)))
            yield from self.put(record(fields + [("WARC-Segment-Total-Length", str(len(block)))] * (k == count), part))

    def put(self, made: bytes) -> Iterator[bytes]:
        if not self.parts:
            info = b"software: quillforge\r\nformat: WARC File Format 1.1\r\n"
            name = record_id(self.space, f"info-{self.task}-{self.closed}")
            self.parts = [record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", name), ("WARC-Date", _DATE), ("WARC-Filename", self.filename(self.closed)), ("Content-Type", "application/warc-fields")], info)]
        self.parts.append(made)
        self.size += len(made)
        if self.size >= self.most:
            yield from self.close()

    def filename(self, number: int) -> str:
        return f"{self.task:06d}-{number:06d}.warc"

    def close(self) -> Iterator[bytes]:
        made, self.parts, self.size = self.parts, [], 0
        if made:
            self.closed += 1
            yield b"".join(made)


def body_of(block: bytes) -> bytes:
    """The payload of an HTTP response block."""
    head, _, rest = block.partition(b"\r\n\r\n")
    return unchunked(rest) if b"transfer-encoding: chunked" in head.lower() else rest


def plan_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """row, page_id, url, payload, digest, response_id, response_row: the page and row that store the payload, null where it isn't shared.

    The rows are written once, so that a row's number is the same for all who read it. Digests are counted
    without the payloads (partial sums before the shuffle, so a page with very many copies is no hot group).
    The shared ones are written, counted, and broadcast only when few.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    own = scratch.save(own.select(F.monotonically_increasing_id().alias("row"), "*", F.sha1("payload").alias("digest")))
    shared = (
        own.where((F.octet_length("payload") >= REVISIT_BYTES) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.max(F.struct("page_id", "row")).alias("top"))
        .select(F.col("digest").alias("d"), F.col("top.page_id").alias("response_id"), F.col("top.row").alias("response_row"))
    )
    # Alone, a payload is its own response; only shared ones need the lookup.
    often = own.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"))
    shared = scratch.save(shared.join(often, "d", "left_semi"))
    if shared.count() <= BROADCAST_ROWS:
        shared = F.broadcast(shared)
    return own.join(shared, F.col("digest") == F.col("d"), "left").drop("d")


def write_archives(planned: DataFrame, segment_bytes: int = SEGMENT_BYTES, archive_bytes: int = ARCHIVE_BYTES, space: str = "archives") -> DataFrame:
    """Archives as rows: archive (the file's name), content (binary)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = Writer(TaskContext.get().partitionId() if TaskContext.get() else 0, segment_bytes, archive_bytes, space)

        def out(content: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
            for c in content:
                yield pa.RecordBatch.from_arrays([pa.array([writer.filename(writer.closed - 1)]), pa.array([c], pa.binary())], names=["archive", "content"])

        for b in batches:
            for i in range(b.num_rows):
                page_id, url, payload, digest, response_id, response_row, row = (b.column(c)[i].as_py() for c in range(7))
                revisit = response_id is not None and response_id != page_id
                yield from out(writer.page(page_id, url, payload, digest, response_id, revisit, row, response_row))
        yield from out(writer.close())

    return planned.select("page_id", "url", "payload", "digest", "response_id", "response_row", "row").mapInArrow(run, "archive string, content binary")


def save_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a ``.warc`` file of ``folder`` (a path or URI that all executors share); archive, bytes of each.

    A file is written under a name of its own and then moved, so a task that runs again leaves whole files only.
    ``spark.read.format("binaryFile")`` reads them back for ``read_archives``.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for b in batches:
            names, sizes = [], []
            for name, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part = f"{base}/_{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                store.move(part, f"{base}/{name}")
                names.append(name)
                sizes.append(len(content.as_buffer()))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return archives.select("archive", "content").mapInArrow(run, "archive string, bytes long")


_PART = "origin string, segment long, total long, page_id long, record_type string, refers string, digest string, length long, content binary"
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_WHOLE = "origin string, page_id long, payload_bytes long, payload_digest string, record_type string, refers string"


def _table(rows: list[tuple], kinds: list[pa.DataType], ddl: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in ddl.split(", ")])


def assemble(archives: DataFrame) -> DataFrame:
    """origin (the record's identifier), page_id, payload_bytes, payload_digest, record_type, refers of each record of ``archives`` (content).

    Records in one piece are decoded where they are read; of the others each segment goes to its
    origin's group, which is as large as one record. A total length that doesn't agree, a missing
    segment, broken framing or a digest that doesn't agree fails the job.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for archive in b.column(0):
                rows = []
                for h, block in records(archive.as_py()):
                    kind = h["warc-type"]
                    if kind == "warcinfo":
                        continue
                    name = h.get("warc-segment-origin-id", h["warc-record-id"])
                    digest = h.get("warc-payload-digest", ":").split(":")[1] or None
                    total, segment, page = (int(h[k]) if k in h else None for k in ("warc-segment-total-length", "warc-segment-number", _PAGE.lower()))
                    length, content = None, block
                    if kind == "revisit":
                        length, content = int(block.split(b"Content-Length: ")[1].split(b"\r\n")[0]), None
                    elif segment is None:
                        length, content = _verified(block, digest), None
                    rows.append((name, segment, total, page, None if kind == "continuation" else kind, h.get("warc-refers-to"), digest, length, content))
                yield _table(rows, _KINDS, _PART)

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.to_pylist():
                if x["length"] is None:
                    parts = x["parts"]
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or x["total"] is None:
                        raise ValueError(f"{x['origin']}: a segment is missing")
                    block = b"".join(p["content"] for p in parts)
                    if len(block) != x["total"]:
                        raise ValueError(f"{x['origin']}: the total length doesn't agree")
                    x["length"] = _verified(block, x["digest"])
                rows.append((x["origin"], x["page_id"], x["length"], x["digest"], x["record_type"], x["refers"]))
            yield _table(rows, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], _WHOLE)

    parts = archives.select("content").mapInArrow(parse, _PART)
    whole = parts.groupBy("origin").agg(
        F.max("page_id").alias("page_id"), F.max("total").alias("total"), F.max("record_type").alias("record_type"), F.max("refers").alias("refers"),
        F.max("digest").alias("digest"), F.max("length").alias("length"),
        F.sort_array(F.collect_list(F.when(F.col("content").isNotNull(), F.struct("segment", "content")))).alias("parts"),
    )
    return whole.mapInArrow(join, _WHOLE)


def read_archives(archives: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: one row per record of ``archives`` (content).

    Records are put together as ``assemble`` says, and revisits are resolved: the response that a revisit's
    WARC-Refers-To names must be there and have its digest and length, else the job fails. ``refers_to`` is
    that response's page_id. The responses that are referred to are looked up without payloads, and
    broadcast only when few.
    """
    scratch = scratch or Scratch(archives.sparkSession)
    whole = scratch.save(assemble(archives))
    asked = whole.where("record_type = 'revisit'").select("refers").distinct()
    held = whole.where("record_type = 'response'").select(F.col("origin").alias("r"), F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("n"))
    named = scratch.save(held.join(asked, F.col("r") == F.col("refers"), "left_semi"))
    if named.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type")
    single = whole.where("record_type <> 'revisit'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    again = whole.where("record_type = 'revisit'").join(named, F.col("refers") == F.col("r"), "left")
    agrees = (F.col("d") == F.col("payload_digest")) & (F.col("n") == F.col("payload_bytes"))
    broken = F.when(F.col("r").isNull(), F.concat(F.lit("a revisit refers to no response: "), F.coalesce("refers", F.lit("-")))).when(~agrees, F.concat(F.lit("a revisit doesn't agree with its response: "), F.col("refers")))
    checked = again.where(F.when(broken.isNotNull(), F.raise_error(broken).cast("boolean")).otherwise(True))
    return single.unionByName(checked.select(*columns, "refers_to"))


def _verified(block: bytes, digest: str | None) -> int:
    body = body_of(block)
    if hashlib.sha1(body).hexdigest() != digest:
        raise ValueError("a payload doesn't agree with its digest")
    return len(body)


def warc_round_trip(pages: DataFrame, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and read the written archives back.

    Of equal payloads of at least 1000 bytes the largest page_id is the response and the others
    revisit it; smaller ones are all responses. Null html is empty. Rows that repeat the largest
    page_id are responses as well, and revisits refer to one of them; a null page_id revisits where there
    is a response, else it is one. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession)
    archives = scratch.save(write_archives(plan_revisits(pages, scratch), segment_bytes, space=scratch.base.rsplit("/", 1)[-1]))
    return read_archives(archives, scratch)
