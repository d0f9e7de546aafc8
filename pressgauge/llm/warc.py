"""WARC archives: a writer with revisit records, and a reader that salvages what damage leaves.

Writing: every task writes its pages as one archive of gzip members, a record each, under a name that follows from
the task's partition; it is moved into place when complete, so a task that runs again replaces its own archive. Of
pages with equal payloads of ``least`` bytes or more, that with the smallest page_id is written in full and the others
as revisits that refer to it.

Reading: every member's checksum, lengths and block digest are checked. After a failed check the reader looks for the
next gzip member or WARC version line from the byte after, tries each, and goes on from the first valid one; the bytes
between are reported as a quarantined gap. A task holds one record at a time.

Edge cases: a null html counts as empty; null page_ids and urls are left out of the record; rows that repeat page_id
and payload are all in full if they hold the smallest page_id; rows without page_id refer to the smallest one of their
payload, if there is any; an empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressgauge.llm.scratch import cut, new_dir, small_side

GZIP, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A record that is not complete after so many bytes counts as damaged.
LONGEST = 1 << 30
STEP = 1 << 20

RECORD = "file string, at long, size long, damage string, page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to long, payload binary"
_KINDS = [
    ("file", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("damage", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()),
    ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("payload", pa.binary()),
]


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record, not compressed; a revisit keeps the HTTP headers and leaves the payload out."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}"] if url else []),
        *([f"X-Page-Id: {page_id}"] if page_id is not None else []),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page-Id: {refers_to}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def open_fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def plan_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to): null for pages that are written in full."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    slim = slim.withColumn("_sha1", F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary"))))
    repeated = slim.where("_sha1 is not null").groupBy(F.col("_sha1").alias("_known")).agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    # Only payloads that repeat are looked up; the pages are shuffled only if those are too many to send around.
    repeated = small_side(cut(repeated, "payloads"), limit=200_000)
    both = slim.join(repeated, F.col("_sha1") == F.col("_known"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_first")), F.col("_first"))
    return both.select("page_id", "url", "html", refers.alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z", level: int = 4) -> DataFrame:
    """Write the archives below ``path``; returns (file, records, bytes), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, folder = open_fs(path)
        fs.create_dir(folder, recursive=True)
        name = f"{folder}/part-{context.partitionId():06d}.warc.gz"
        draft, records, out = f"{name}.{context.taskAttemptId()}.tmp", 0, None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in columns)
                out = out or fs.open_output_stream(draft, compression=None)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                out.write(press.compress(build_record(page_id, url, html.encode(), refers_to, date)) + press.flush())
                records += 1
        if out:
            size = out.tell()
            out.close()
            fs.move(draft, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{name.rpartition('/')[2]}"]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], names=["file", "records", "bytes"])

    return cut(plan_revisits(pages, least).mapInArrow(run, "file string, records long, bytes long"), "archives")


class Damaged(ValueError):
    """A record that fails a check."""


def parse_record(raw: bytes) -> dict:
    """Fields of one whole record, or ``Damaged``."""
    if not VERSION.match(raw):
        raise Damaged("no version line")
    head, mark, rest = raw.partition(b"\r\n\r\n")
    if not mark:
        raise Damaged("headers do not end")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, mark, value = line.partition(b":")
        if not mark:
            raise Damaged("header without a colon")
        fields[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise Damaged("wrong block length")
    block = rest[:-4]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != sha1_base32(block):
        raise Damaged("wrong block digest")
    http, mark, payload = block.partition(b"\r\n\r\n")
    whole = fields.get("warc-type") != "revisit"
    stated = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    number = lambda key: int(fields[key]) if re.fullmatch(r"-?\d+", fields.get(key, "")) else None
    digest = sha1_base32(payload) if whole else fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if whole and fields.get("warc-payload-digest", f"sha1:{digest}") != f"sha1:{digest}":
        raise Damaged("wrong payload digest")
    return {
        "page_id": number("x-page-id"), "record_type": fields.get("warc-type"), "target_uri": fields.get("warc-target-uri"), "payload_digest": digest,
        "payload_bytes": len(payload) if whole else int(stated[1]) if stated else None, "refers_to": number("x-refers-to-page-id"), "payload": payload if whole else None,
    }


def salvage(stream: BinaryIO) -> Iterator[dict]:
    """Records of an archive with ``at`` and ``size``, and gaps with ``damage``, in the order of their bytes."""
    held, base, ended = bytearray(), 0, False

    def more() -> bool:
        nonlocal ended
        got = b"" if ended else stream.read(STEP)
        ended = ended or not got
        held.extend(got)
        return bool(got)

    def member() -> tuple[bytes, int]:
        """The uncompressed member that starts at held[0], and its size."""
        press, out, used = zlib.decompressobj(31), bytearray(), 0
        while not press.eof:
            if used == len(held) and not more():
                raise Damaged("member is cut off")
            some = bytes(held[used : used + STEP])
            used += len(some)
            try:
                # No more than one byte beyond the longest record is ever inflated.
                out += press.decompress(some, LONGEST + 1 - len(out))
            except zlib.error as error:
                raise Damaged(str(error)) from error
            if len(out) > LONGEST:
                raise Damaged("member is too long")
        return bytes(out), used - len(press.unused_data)

    def plain() -> tuple[bytes, int]:
        """The record without compression that starts at held[0]."""
        while (end := held.find(b"\r\n\r\n")) < 0:
            if len(held) > STEP or not more():
                raise Damaged("headers do not end")
        length = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", held[:end])
        size = end + 8 + int(length[1]) if length else 0
        if not length or size > LONGEST:
            raise Damaged("no block length")
        while len(held) < size:
            if not more():
                raise Damaged("record is cut off")
        return bytes(held[:size]), size

    gap, reason = None, ""
    while True:
        if len(held) < 16:
            more()
        if not held:
            break
        try:
            raw, size = member() if held.startswith(GZIP) else plain() if held.startswith(b"WARC/") else (b"", 0)
            found = parse_record(raw) | {"at": base, "size": size, "damage": None}
        except Damaged as error:
            if gap is None:
                gap, reason = base, str(error)
            # The next place where a member or a version line may start; what lies before it is not held any longer.
            at = 1
            while True:
                places = [p for p in (held.find(GZIP, at), held.find(b"WARC/1.", at)) if p >= 0]
                if places:
                    step = min(places)
                    break
                at = max(1, len(held) - 8)
                if at > STEP:
                    del held[: at - 1]
                    base, at = base + at - 1, 1
                if not more():
                    step = len(held)
                    break
            del held[:step]
            base += step
            continue
        if gap is not None:
            yield {"at": gap, "size": base - gap, "damage": reason}
            gap = None
        yield found
        del held[:size]
        base += size
    if gap is not None:
        yield {"at": gap, "size": base - gap, "damage": reason}


def read_archives(files: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps (rows with ``damage``) of the archives named in column ``file``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in _KINDS], names=[n for n, _ in _KINDS])

        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = open_fs(file)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for found in salvage(stream):
                        if not payloads:
                            found["payload"] = None
                        rows.append({"file": file} | found)
                        size += len(found.get("payload") or b"") + 200
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("file").repartition(max(1, files.count())).mapInArrow(run, RECORD)


def quarantined(records: DataFrame) -> DataFrame:
    """The log of byte gaps: (file, at, size, damage)."""
    return records.where("damage is not null").select("file", "at", "size", "damage")


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 0) -> DataFrame:
    """Write and read back; a revisit takes size and digest from the response that it refers to, where that survived."""
    files = write_archives(pages, new_dir(spark, "warc"), least)
    records = cut(read_archives(files, payloads=False).where("damage is null").select("page_id", "record_type", "payload_digest", "payload_bytes", "refers_to"), "records")
    full = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    whole = records.join(full, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return whole.select("page_id", F.coalesce("_bytes", "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH pages_text AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), firsts AS (
  SELECT page_id, html, sha1(html) || '0' AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM pages_text
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (1 + (i * 5) // 4)::INTEGER, 2))::INTEGER >> (3 - (i * 5) % 4)::INTEGER) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""
