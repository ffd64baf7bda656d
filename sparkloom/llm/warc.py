"""WARC archives with an index: write (file, offset, length, URL, digest) per record, then read selected records by coalesced ranges.

Records are gzip members of their own, so a byte range is all a reader needs. A payload that a record with a smaller id already
holds is written as a revisit record, which names the record it refers to and has no body.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import filesystem, materialize, scratch, sliced, table

MIN_REVISIT = 100
FILE_BYTES = 128 << 20
#: Reads: ranges less than GAP apart become one, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long, file string, offset long, length long"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"Page-ID: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}"]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is None:
        block += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    else:
        head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
        block += b"\r\n"
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    raw = zlib.decompress(member, wbits=31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int) -> Iterator[pa.RecordBatch]:
    system, base = filesystem(folder)
    system.create_dir(base, recursive=True)
    out = name = None
    at = 0
    for batch in sliced(batches, "html", 8 << 20):
        index = []
        for page_id, url, html, digest, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            if out is None or at >= file_bytes:
                if out is not None:
                    out.close()
                name, at = f"{uuid.uuid4().hex}.warc.gz", 0  # of its own: a task that runs twice leaves an unlisted file, never a torn one
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            payload = (html or "").encode("utf-8", "surrogatepass")
            member = gzip.compress(_record(page_id, url, payload, digest, refers_to), 4, mtime=0)
            out.write(member)
            index.append((page_id, url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to, f"{folder}/{name}", at, len(member)))
            at += len(member)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*index, strict=True), kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])
    if out is not None:
        out.close()


def write_archives(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes one record per row of pages (page_id, url, html) and returns the index.

    Null html is an empty payload. Of equal payloads of at least min_revisit bytes the smallest id is the response, larger ids
    are revisits; rows that repeat id and payload are responses alike. Rows with a null id are responses. Other columns are
    ignored; an empty table gives an empty index.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    large = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "digest")
    first = large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    again = large.join(first, "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to").distinct()
    decided = rows.join(again, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")
    return materialize(decided.mapInArrow(lambda it: _write(it, folder, file_bytes), INDEX), "warc-index")


def _ranges(spots: list[tuple[int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[int, int, int, int]]:
    """(first, last + 1, from byte, to byte) of the reads for sorted (offset, length) spots."""
    i = 0
    while i < len(spots):
        j, start, end = i + 1, spots[i][0], sum(spots[i])
        while j < len(spots) and spots[j][0] <= end + gap and sum(spots[j]) - start <= most:
            end, j = max(end, sum(spots[j])), j + 1
        yield i, j, start, end
        i = j


def _read(batches: Iterator[pa.RecordBatch], with_payload: bool) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in RESULT.split(", ")] + ["payload"] * with_payload
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    opened, handle = None, None
    for batch in batches:
        files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
        start = 0
        while start < len(files):
            stop = start
            while stop < len(files) and files[stop] == files[start]:
                stop += 1
            if files[start] != opened:
                system, path = filesystem(files[start])
                opened, handle = files[start], system.open_input_file(path)
            for i, j, low, high in _ranges(list(zip(offsets[start:stop], lengths[start:stop], strict=True))):
                handle.seek(low)
                data, rows = handle.read(high - low), []
                for k in range(start + i, start + j):
                    fields, payload = _parse(data[offsets[k] - low : offsets[k] - low + lengths[k]])
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest()
                    if f"sha256:{digest}" != fields["WARC-Payload-Digest"]:
                        raise ValueError(f"{opened} at {offsets[k]}: the payload doesn't match its digest")
                    size = int(fields["Payload-Length"]) if revisit else len(payload)
                    own, to = fields["Page-ID"].strip(), fields.get("Refers-To-Page-ID")
                    rows.append((int(own) if own else None, size, digest, fields["WARC-Type"], int(to) if to else None) + ((payload,) if with_payload else ()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            start = stop


def read_records(selected: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the selected index rows, read back from the archives; a payload that doesn't match its digest is an error."""
    ordered = selected.select("file", "offset", "length").repartition("file").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(lambda it: _read(it, with_payload), RESULT + ", payload binary" * with_payload)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(write_archives(table(spark, sf_dir, "pages"), scratch(spark, "warc")))


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= {MIN_REVISIT} AND m < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {MIN_REVISIT} AND m < page_id THEN m END AS refers_to
FROM q
"""
