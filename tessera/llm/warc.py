"""WARC archives: written with an index of every record, read back by coalesced byte ranges.

Each task writes archives of gzip members, one per record, into the shared folder and returns their index rows (archive,
offset, length, URL, digest). A failed task's archive is named by nobody; the retry writes another. Reading sorts the wanted
index rows by archive and offset, and merges neighbours into one range read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, kept, mapped, materialize, new_path, scratch

#: Payloads below this many bytes are always written whole.
LEAST_REVISIT = 100
#: An archive is closed beyond this size; the size of a task's memory, too.
ARCHIVE_BYTES = 64 << 20
#: Compressed bytes that one task reads, where there are enough for all tasks.
RANGE_BYTES = 128 << 20
#: Ranges with at most this gap between them are read at once, up to READ_BYTES.
GAP_BYTES, READ_BYTES = 64 << 10, 4 << 20
DATE = "1970-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"


def _one_line(value: str) -> str:
    return " ".join(value.split())


def _record(page_id, url: str | None, payload: bytes, digest: str, revisits, first_url: str | None) -> bytes:
    """Record ids are random, as rows may share their page_id; a revisit names its response by URL, date and page."""
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisits is not None else 'response'}", f"WARC-Record-ID: <{uuid.uuid4().urn}>", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_one_line(url or '')}", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisits is not None:
        head += [f"WARC-Refers-To-Target-URI: {_one_line(first_url or '')}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page-ID: {revisits}"]
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and payload; a length that doesn't fit the record is an error."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    size = int(headers["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:size]


def choose_revisits(pages: DataFrame) -> DataFrame:
    """pages with refers_to and first_url: of equal payloads of LEAST_REVISIT bytes or more, all but the smallest page_id revisit it.

    Only (page_id, url, digest) are compared; payloads are then joined by page_id and digest, so that a frequent digest isn't
    gathered in one place.
    """
    long = pages.where((F.col("payload_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "url", "payload_digest")
    first = F.min(F.struct(F.col("page_id").alias("refers_to"), F.col("url").alias("first_url"))).alias("first")
    groups = long.groupBy("payload_digest").agg(first, F.max("page_id").alias("last")).where("first.refers_to < last").select("payload_digest", "first.*")
    later = long.select("page_id", "payload_digest").join(groups, "payload_digest").where("page_id > refers_to").distinct()
    return pages.join(bounded(later, 1 << 16), ["page_id", "payload_digest"], "left")


def write_warc(pages: DataFrame, path: str) -> DataFrame:
    """Write a record for each row of pages(page_id, url, payload, payload_digest, refers_to, first_url); returns the index."""

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(path)
        out, buffer = [], bytearray()

        def close():
            name = f"{uuid.uuid4().hex}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(bytes(buffer))
            rows = {k: [r[k] for r in out] for k in ("offset", "length", "page_id", "url", "payload_digest", "record_type", "refers_to")}
            kinds = {"offset": pa.int64(), "length": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64()}
            batch = pa.record_batch({"archive": pa.array([name] * len(out)), **{k: pa.array(v, kinds.get(k, pa.string())) for k, v in rows.items()}})
            out.clear()
            buffer.clear()
            return batch

        store.create_dir(root, recursive=True)
        for batch in batches:
            for page_id, url, payload, digest, refers, first_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "payload_digest", "refers_to", "first_url")), strict=True):
                pack = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = pack.compress(_record(page_id, url, payload, digest, refers, first_url)) + pack.flush()
                out.append({"offset": len(buffer), "length": len(member), "page_id": page_id, "url": url, "payload_digest": digest, "record_type": "response" if refers is None else "revisit", "refers_to": refers})
                buffer.extend(member)
                if len(buffer) >= ARCHIVE_BYTES:
                    yield close()
        if out:
            yield close()

    rows = pages.select("page_id", "url", F.col("payload").cast("binary").alias("payload"), "payload_digest", "refers_to", "first_url")
    return materialize(mapped(rows, run, INDEX), "warc-index")


def read_warc(index: DataFrame, path: str) -> DataFrame:
    """The records of index rows: page_id, url, record_type, refers_to, payload (null in revisits), payload_digest.

    Digests of payloads are computed from the bytes read and must equal the records' own. index may be any selection of rows.
    Tasks share the bytes, not the rows, of the index.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        store, root = fs.FileSystem.from_uri(path)
        for batch in batches:
            archive, offset, length = (batch.column(c).to_pylist() for c in ("archive", "offset", "length"))
            out = {k: [] for k in ("page_id", "url", "record_type", "refers_to", "payload", "payload_digest")}
            i = 0
            while i < len(archive):
                j, end = i + 1, offset[i] + length[i]
                while j < len(archive) and archive[j] == archive[i] and 0 <= offset[j] - end <= GAP_BYTES and offset[j] + length[j] - offset[i] <= READ_BYTES:
                    end, j = offset[j] + length[j], j + 1
                with store.open_input_file(f"{root}/{archive[i]}") as f:
                    block = f.read_at(end - offset[i], offset[i])
                for k in range(i, j):
                    at = offset[k] - offset[i]
                    headers, payload = parse_record(zlib.decompress(block[at : at + length[k]], 31))
                    number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                    digest, kind = headers["warc-payload-digest"].removeprefix("sha256:"), headers["warc-type"]
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{archive[k]} at {offset[k]}: the payload doesn't have its digest")
                    out["page_id"].append(number("x-page-id"))
                    out["url"].append(headers["warc-target-uri"])
                    out["record_type"].append(kind)
                    out["refers_to"].append(number("x-refers-to-page-id"))
                    out["payload"].append(payload if kind == "response" else None)
                    out["payload_digest"].append(digest)
                i = j
            kinds = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
            yield pa.record_batch({k: pa.array(v, kinds.get(k, pa.string())) for k, v in out.items()})

    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(1, size // RANGE_BYTES, min(size >> 20, 2 * index.sparkSession.sparkContext.defaultParallelism))
    ranges = index.repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset").select("archive", "offset", "length")
    return mapped(ranges, run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string")


def payload_columns(html: Column) -> dict[str, Column]:
    payload = F.coalesce(html.cast("string"), F.lit("")).cast("binary")
    return {"payload": payload, "payload_bytes": F.octet_length(payload).cast("long"), "payload_digest": F.sha2(payload, 256)}


def archive_pages(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each row of pages(page_id, url, html), as read back.

    The payload is the html in UTF-8, a null one empty. A record with a payload of LEAST_REVISIT bytes or more whose equal has
    a smaller page_id is written as a revisit of the smallest; its size and digest are those of the response it refers to.
    Rows with the smallest page_id in common are all responses; a null page_id is never revisited and never revisits. A null
    URL is written empty. Repeated rows stay repeated. A payload of any length is one record, read at once: a task needs memory
    for the longest. The archives stay in the shared folder.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    path = new_path(pages.sparkSession, "warc")
    ready = pages.withColumns(payload_columns(F.col("html"))).drop("html")
    with scratch(pages.sparkSession):
        index = write_warc(choose_revisits(ready), path)
        read = read_warc(index, path).select("page_id", "record_type", "refers_to", "payload_digest", F.octet_length("payload").cast("long").alias("payload_bytes"))
        return kept(with_sizes(materialize(read, "warc-read")), "warc-pages")


def with_sizes(read: DataFrame) -> DataFrame:
    """read(page_id, record_type, refers_to, payload_digest, payload_bytes) with the size of revisits: what was read of the
    response. A revisit whose response wasn't read is an error."""
    response = (
        read.where("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
        .agg(F.min("payload_bytes").alias("first_bytes"))
    )
    joined = read.where("record_type = 'revisit'").join(response, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.col("refers_to").cast("string"))).cast("long")
    revisits = joined.withColumn("payload_bytes", F.when(F.col("first_bytes").isNull(), lost).otherwise(F.col("first_bytes")))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(*columns).union(revisits.select(*columns))
