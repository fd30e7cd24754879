"""WARC archives: one gzip member a record, and a reader that splits files anywhere.

The reader's tasks own byte ranges. A task looks for gzip magic in its range,
decompresses the start of each candidate and takes it for a record only if a WARC
header comes out; it then reads the records that start inside its range, the last one
beyond the end if need be. A range that starts inside a record skips to the next.

Records must follow each other without a gap: behind its last record a task looks at
the start of the next one, also where another task owns it, so that a damaged or cut
record is an error and never a missing row. Files that aren't compressed have nothing
to find a record by and are read by one task each.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
BLOCK = 1 << 20
LEAST_PAYLOAD = 100
#: Stored bytes of repeated digests that are broadcast.
SMALL_BYTES = 16 << 20
SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_offset long, file string"


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """pages with digest, record_type and refers_to; of equal payloads the smallest page_id responds.

    Only digest, id and length are grouped, with partial sums. The digests that repeat are
    stored; up to SMALL_BYTES of them go to every task, so that no page is shuffled, and
    beyond that both sides are joined by digest. A null id is never referred to and, where
    an id exists for its payload, revisits it. Rows that repeat the smallest id are
    responses too.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n"))
    first = rows.where(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1 and first is not null").select(F.col("digest").alias("d"), "first")
    first = common.written(first, "digests")
    both = rows.join(F.broadcast(first) if common.plan_bytes(first) <= SMALL_BYTES else first, F.col("digest") == F.col("d"), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return both.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "digest", F.col("n").cast("long").alias("n"), refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str | None, digest: str, n: int, refers_to: int | None) -> bytes:
    """The bytes of one record, compressed. A revisit keeps the HTTP header, whose Content-Length is the payload's."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n".encode()
    block = http if refers_to is not None else http + (html or "").encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", "WARC-Date: 2024-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {' '.join((url or '').split())}", f"X-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {_urn(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(4, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, str(page_id))}>"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all rows of pages(page_id, url, html); (uri, bytes, records) of each file.

    Null html is an empty payload, null ids and urls are written empty, repeated rows
    are all written, other columns are not read; an empty table gives no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = [0]

        def members() -> Iterator[bytes]:
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "n", "refers_to"))):
                    n[0] += 1
                    yield record(*r)

        source = members()
        first = next(source, None)
        if first is None:
            return
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        size = common.write_whole(folder, name, (m for part in ((first,), source) for m in part))
        yield pa.RecordBatch.from_pydict({"uri": [f"{folder}/{name}"], "bytes": pa.array([size], pa.int64()), "records": pa.array([n[0]], pa.int64())})

    return plan_records(pages).mapInArrow(run, "uri string, bytes long, records long")


def splits(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(uri, lo, hi) of the ranges of all archives in a folder; a file that isn't compressed is one range."""
    store, root = common.open_fs(folder)
    found = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith((".warc.gz", ".warc"))]
    step = lambda f: split_bytes if f.path.endswith(".gz") else max(1, f.size)
    ranges = [(f"{folder}/{f.base_name}", lo, min(f.size, lo + step(f))) for f in sorted(found, key=lambda f: f.path) for lo in range(0, f.size, step(f))]
    frame = spark.createDataFrame(ranges, "uri string, lo long, hi long")
    return frame.repartition(max(1, len(ranges)), "uri", "lo")


def read_range(uri: str, lo: int, hi: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records of a file that start in [lo, hi); an error if one is damaged or cut, or if records leave a gap."""
    store, path = common.open_fs(uri)
    with store.open_input_file(path) as file:
        size = file.size()
        member = _member if path.endswith(".gz") else _plain
        at = lo if lo == 0 else _first(file, lo, min(hi, size), size)
        while at is not None and at < size:
            content, after = member(file, at, size, at >= hi)
            if content is None:
                raise ValueError(f"{uri}: no whole record at {at}")
            if at >= hi:
                return
            yield at, content
            at = after


def _first(file, at: int, hi: int, size: int) -> int | None:
    """Offset of the first record that starts in [at, hi)."""
    while (at := _next_magic(file, at, hi)) is not None:
        if _member(file, at, size, True)[0] is not None:
            return at
        at += 1
    return None


def _next_magic(file, at: int, hi: int) -> int | None:
    while at < hi:
        file.seek(at)
        data = file.read(min(BLOCK, hi - at) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if 0 <= found and at + found < hi:
            return at + found
        at += BLOCK
    return None


def _member(file, at: int, size: int, start: bool = False) -> tuple[bytes | None, int]:
    """Content and end of the gzip member at an offset, of its start only if that is asked; None if no record stands there whole."""
    file.seek(at)
    unpack, out, seen, read = zlib.decompressobj(31), [], 0, 0
    try:
        while not unpack.eof and at + read < size:
            data = file.read(64 << 10)
            read += len(data)
            out.append(unpack.decompress(data))
            seen += len(out[-1])
            if seen >= 5 and b"".join(out[:2])[:5] != b"WARC/":
                return None, at
            if seen >= 5 and start:
                return b"WARC/", at
    except zlib.error:
        return None, at
    if not unpack.eof or seen < 5:
        return None, at
    content = b"".join(out)
    return (content, at + read - len(unpack.unused_data)) if content[:5] == b"WARC/" else (None, at)


def _plain(file, at: int, size: int, start: bool = False) -> tuple[bytes | None, int]:
    """Content and end of the record at an offset of a file that isn't compressed; None if none stands there whole."""
    file.seek(at)
    head = b""
    while b"\r\n\r\n" not in head and len(head) < BLOCK and (data := file.read(64 << 10)):
        head += data
    end = head.find(b"\r\n\r\n")
    length = re.search(rb"\r\ncontent-length:\s*(\d+)\s*(?:\r\n|$)", head[: max(0, end)], re.I)
    if head[:5] != b"WARC/" or not length:
        return None, at
    after = at + end + 4 + int(length[1]) + 4
    file.seek(at)
    content = file.read(after - at)
    return (content, after) if content[-4:] == b"\r\n\r\n" and len(content) == after - at else (None, at)


def parse(content: bytes) -> dict:
    """Fields of a record; the payload is digested anew for responses, a revisit names it in its headers."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:")
    kind, n = fields["WARC-Type"], len(payload)
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if digest and digest != found:
            raise ValueError("a payload does not match its digest")
        digest = found
    else:
        lengths = [line.split(b":")[1] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        n = int(lengths[0]) if lengths else 0
    number = lambda k: int(fields[k]) if fields.get(k) else None
    return {"page_id": number("X-Page-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload}


def read(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives in a folder, by byte ranges.

    An empty folder gives no row; a record without a page id has a null one. A record that
    is damaged, cut or does not match its digest fails the job.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        types = [pa.string() if x.split()[1] == "string" else pa.int64() for x in SCHEMA.split(", ")]
        for batch in batches:
            for s in batch.to_pylist():
                rows: list[dict] = []
                for at, content in read_range(s["uri"], s["lo"], s["hi"]):
                    rows.append(parse(content) | {"record_offset": at, "file": s["uri"].rpartition("/")[2]})
                    rows[-1].pop("payload")
                    if len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names)
                        rows = []
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, types)], names)

    return splits(spark, folder, split_bytes).mapInArrow(run, SCHEMA)


def archive(pages: DataFrame) -> DataFrame:
    """Write all pages to the shared folder and read the records back from the archives.

    A null html is an empty payload. Null page_ids stay null and are never referred to. Each
    repeated row is a record of its own; of equal payloads of 100 bytes or more that of
    the smallest page_id is the response. Other columns are not read. An empty table gives
    no row.
    """
    folder = common.shared_dir(pages.sparkSession, "warc")
    write(pages, folder).agg(F.sum("records")).collect()
    return read(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_offset", "file")
