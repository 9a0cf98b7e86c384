"""Operator 6: WARC archives, written with an index and read back by coalesced byte ranges."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delaymill.session import scratch_path, spool

NAMESPACE = 0x6B1F52A07C3D4E81  # the upper half of every record id; the lower half is the page id
DATE = "2024-01-01T00:00:00Z"
GAP = 64 << 10  # bytes between two wanted records that are read along rather than skipped
SPAN = 8 << 20  # of an archive, read by one task in few reads
TASK_BYTES = 128 << 20  # of archives, for one task; fewer while there are stretches for more
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = (
    "page_id long, url string, file string, offset long, length long, digest string, record_type string"
)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    """The record id of a page; pages without id share one that names none."""
    if page_id is None:
        return "<urn:uuid:" + str(uuid.UUID(int=0)) + ">"
    return "<urn:uuid:" + str(uuid.UUID(int=NAMESPACE << 64 | page_id & (1 << 64) - 1)) + ">"


def page_of(record: str) -> int | None:
    number = uuid.UUID(record.strip("<>").removeprefix("urn:uuid:")).int
    if number >> 64 != NAMESPACE:
        return None
    low = number & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as its own gzip member. A revisit keeps the HTTP head, and so the payload's length, but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": " ".join((url or "").split()),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if refers_to is not None:
        head |= {"WARC-Profile": REVISIT, "WARC-Refers-To": record_id(refers_to)}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse_record(raw: bytes) -> dict:
    """The headers of a record, with ``payload`` (bytes, None in a revisit) and ``payload_bytes``."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(out["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if out["WARC-Type"] == "revisit":
        return out | {"payload": None, "payload_bytes": length}
    if length != len(payload):
        raise ValueError("a payload is cut short")
    return out | {"payload": payload, "payload_bytes": length}


def _store(folder: str):
    return pafs.FileSystem.from_uri(folder)


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html; others ignored) below ``folder`` and return the stored index.

    A null html is an empty payload, rows without id share a record id, repeated rows give a record each; of rows that share the smallest page_id all are
    responses. An empty table gives an empty index and no archive.

    Of pages with equal payloads of at least ``least_bytes`` bytes, those with the smallest page_id are
    responses and the others revisit it; shorter payloads, and payloads that only rows without id have, are
    responses. Only digests and ids are shuffled to find the smallest; a payload on very many pages is aggregated
    before. Each task writes one archive under a name of its own, and its index rows name that file, so files of lost
    attempts are never read.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload"))
    sized = rows.filter(F.length("payload") >= least_bytes).select("page_id", "sha")
    groups = sized.groupBy("sha").agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = spool(groups.select(F.col("sha").alias("_sha"), "least"), "payloads")
    same = (F.col("sha") == F.col("_sha")) & (F.length("payload") >= least_bytes)
    marked = rows.join(groups, same, "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    filesystem, root = _store(folder)
    filesystem.create_dir(root, recursive=True)

    def write(batches):
        filesystem, root = _store(folder)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        at, sink = 0, None
        for batch in batches:
            out = []
            for page_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                digest = payload_digest(payload)
                record = record_bytes(page_id, url, payload, digest, refers_to)
                sink = sink or filesystem.open_output_stream(f"{root}/{name}", compression=None)
                sink.write(record)
                kind = "response" if refers_to is None else "revisit"
                out.append((page_id, url, name, at, len(record), digest, kind))
                at += len(record)
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), _INDEX_TYPES, strict=True)] if out else []
            if columns:
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in INDEX.split(", ")])
        if sink:
            sink.close()

    index = marked.select("page_id", "url", "payload", refers.alias("refers_to")).mapInArrow(write, INDEX)
    path = scratch_path(spark, "warc-index")
    index.write.parquet(path)
    return spark.read.schema(index.schema).parquet(path)


_INDEX_TYPES = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def ranges(places: list[tuple[int, int]], gap: int = GAP) -> list[tuple[int, int]]:
    """Byte ranges that cover sorted (offset, length) places, joined where at most ``gap`` bytes lie between."""
    out: list[tuple[int, int]] = []
    for offset, length in places:
        if out and offset - out[-1][1] <= gap:
            out[-1] = out[-1][0], max(out[-1][1], offset + length)
        else:
            out.append((offset, offset + length))
    return out


def reading_tasks(index: DataFrame) -> int:
    """How many tasks read the records of ``index``: by their bytes, and while they are few, by their stretches."""
    total = index.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-total // TASK_BYTES), min(-(-total // SPAN), 2 * cores))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, payload (null in revisits), payload_bytes, payload_digest, record_type, refers_to of indexed records.

    ``index`` may be any selection of index rows. Its places are grouped by archive and stretch, sorted, and each
    group is read in few ranges; everything but the place comes from the archive. The tasks are as many as the bytes that
    the selected records take up ask for, however short their index is. Repeated index rows give a record each, an empty index none.
    """

    def read(batches):
        filesystem, root = _store(folder)
        for batch in batches:
            names, offsets, lengths = (c.to_pylist() for c in batch.columns[:3])
            start = 0
            for i in range(1, len(names) + 1):
                if i < len(names) and names[i] == names[start] and offsets[i] - offsets[start] < SPAN:
                    continue
                places = list(zip(offsets[start:i], lengths[start:i], strict=True))
                yield _read_group(filesystem, f"{root}/{names[start]}", places)
                start = i

    stretch = F.floor(F.col("offset") / SPAN)
    placed = index.select("file", "offset", "length", stretch.alias("stretch"))
    placed = placed.repartition(reading_tasks(index), "file", "stretch").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(
        read,
        "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def _read_group(filesystem, path: str, places: list[tuple[int, int]]) -> pa.RecordBatch:
    out = []
    with filesystem.open_input_file(path) as source:
        spans = ranges(places)
        held, at = b"", -1
        begin = 0
        for offset, length in places:
            while at < 0 or offset >= spans[at][1]:
                at += 1
                begin = spans[at][0]
                held = source.read_at(spans[at][1] - begin, begin)
            r = parse_record(held[offset - begin : offset - begin + length])
            refers = r.get("WARC-Refers-To")
            if r["payload"] is not None and payload_digest(r["payload"]) != r["WARC-Payload-Digest"].removeprefix("sha1:"):
                raise ValueError(f"{path}: a payload does not match its digest")
            out.append(
                (
                    page_of(r["WARC-Record-ID"]),
                    r["WARC-Target-URI"],
                    r["payload"],
                    r["payload_bytes"],
                    r["WARC-Payload-Digest"].removeprefix("sha1:"),
                    r["WARC-Type"],
                    page_of(refers) if refers else None,
                )
            )
    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


ORACLE = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), grouped AS (SELECT h, min(page_id) AS least FROM sized GROUP BY h
), digits AS (
  SELECT *, list_transform([1, 11, 21, 31], lambda i: CAST('0x' || substr(h, i, 10) AS BIGINT)) AS fives FROM sized JOIN grouped USING (h)
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(fives, lambda v: array_to_string(list_transform([35, 30, 25, 20, 15, 10, 5, 0],
         lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> s) & 31 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM digits
"""
