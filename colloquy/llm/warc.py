"""WARC archives, index first.

Writing.  Pages are dealt to archives by a hash; within an archive, records are ordered by page.
A task streams its archives' pages, already sorted, and writes each record as a gzip member of
its own, as web archives are kept.  What it returns is the index: archive file, offset, length,
URL and digest per record, stored as a Parquet table.  Archives have fixed names and the same
bytes in every attempt, and appear under their name only when complete, so a lost or doubled task
does no harm.  Pages cross the network once: only the narrow facts which record refers to which
are joined, and travel to the archive's task as rows of their own.

Reading.  Index rows are selected, sorted by (file, offset) and coalesced into byte ranges:
records less than ``GAP`` bytes apart are read in one request.  The ranges are dealt to one task
per ``RANGE`` bytes selected; a task reads its ranges one by one, cuts them by
the index, and parses every record's header and payload.

Of records with equal payloads, of at least ``smallest`` bytes, the one with the least page id
is a response and the others are revisits that name it and carry no payload; smaller payloads
are always responses.  Payloads are equal when their SHA-1 is.

Null html is an empty payload, a null URL an empty one.  A null page id is ordered last and
written as an empty id; rows that share the least page id of a payload are all responses.  Line
ends in a URL are written percent-encoded.  Empty tables give an empty index.  Other columns of
the input, clashing names included, are not carried.  Records of any length are written whole; a
range holds at least one record.

The folder must be one that tasks reach by its URI: a shared file system, or a store that
pyarrow's file systems open.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import prepare

#: Payload bytes that an archive holds on average.
ARCHIVE = 16 << 20
#: Bytes between two selected records that are rather read than skipped.
GAP = 64 << 10
#: Bytes at which a range ends.
RANGE = 8 << 20
#: The alphabets of base 32 digits and of RFC 4648.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_END = "\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"


def base32_sha1(payload: Column) -> Column:
    """Five hexadecimal digits are four base-32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), _DIGITS, _BASE32)


def tape(pages: DataFrame, smallest: int = 0, archives: int | None = None) -> DataFrame:
    """What the writers need, by archive: every page, behind a note (no html) of the page that it
    refers to if it is a revisit."""
    html = F.coalesce(F.col("html"), F.lit(""))
    url = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), "\r", "%0D"), "\n", "%0A")
    rows = pages.select("page_id", url.alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), base32_sha1(html.cast("binary")).alias("digest"))
    if archives is None:
        total = rows.agg(F.sum("bytes")).first()[0] or 0  # one number
        archives = total // ARCHIVE + 1
    rows = rows.withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(archives)).cast("int"))
    first = rows.where(F.col("bytes") >= smallest).groupBy("digest").agg(F.min("page_id").alias("first")).where("first IS NOT NULL")
    notes = rows.where(F.col("bytes") >= smallest).select("archive", "page_id", "url", "digest").distinct().join(first, "digest")
    notes = notes.where("page_id IS NULL OR page_id <> first")
    both = rows.select("archive", "page_id", "url", "digest", F.lit(None).cast("long").alias("first"), "html").unionByName(
        notes.select("archive", "page_id", "url", "digest", F.col("first").cast("long").alias("first"), F.lit(None).cast("string").alias("html")))
    # one archive a task, whatever the session's number of partitions
    return both.repartitionById(int(archives), "archive").sortWithinPartitions("archive", F.col("page_id").asc_nulls_last(), "url", "digest", F.col("first").asc_nulls_last())


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def record(page: object, url: str, digest: str, payload: bytes, first: int | None) -> bytes:
    block = payload if first is None else b""
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {_DATE}",
            f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(block)}"]
    return ("\r\n".join(head) + _END).encode() + block + _END.encode()


_INDEX = pa.schema([("archive", pa.int32()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        now = out = note = None
        part = name = ""
        offset = 0

        def done() -> None:
            if out is not None:
                out.close()
                store.move(part, name)

        for batch in batches:
            index: list[dict] = []
            for archive, page, url, digest, first, html in zip(*(batch.column(n).to_pylist() for n in ("archive", "page_id", "url", "digest", "first", "html"))):
                if archive != now:
                    done()
                    now, offset = archive, 0
                    name = f"{root}/archive-{archive:06d}.warc.gz"
                    part = f"{root}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(part)
                if html is None:
                    note = (page, url, digest, first)
                    continue
                refers = note[3] if note and note[:3] == (page, url, digest) else None
                member = gzip.compress(record(page, url, digest, html.encode(), refers), 6, mtime=0)
                out.write(member)
                index.append({"archive": archive, "file": f"{folder}/archive-{archive:06d}.warc.gz", "offset": offset, "length": len(member), "page_id": page, "url": url,
                              "payload_digest": digest, "record_type": "response" if refers is None else "revisit"})
                offset += len(member)
            yield pa.RecordBatch.from_pylist(index, _INDEX)
        done()

    return run


def write(pages: DataFrame, path: str, smallest: int = 0, archives: int | None = None) -> DataFrame:
    """Write the archives under ``path`` and return the index."""
    spark = pages.sparkSession
    prepare(spark)
    folder = f"{path}/archives"
    store, root = _store(folder)
    store.create_dir(root)
    rows = tape(pages, smallest, archives).mapInArrow(_writer(folder), "archive int, file string, offset bigint, length bigint, page_id bigint, url string, payload_digest string, record_type string")
    rows.write.parquet(f"{path}/index")
    return spark.read.parquet(f"{path}/index")


def ranges(index: DataFrame, gap: int = GAP, most: int = RANGE) -> DataFrame:
    """Selected index rows, coalesced: file, start, stop and the records inside."""
    order = W.partitionBy("file").orderBy("offset")
    rows = index.withColumn("prev", F.lag(F.col("offset") + F.col("length")).over(order))
    cut = F.col("prev").isNull() | (F.col("offset") - F.col("prev") > gap) | (F.floor(F.col("offset") / most) != F.floor(F.lag("offset").over(order) / most))
    rows = rows.withColumn("run", F.sum(cut.cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)))
    part = F.struct("offset", "length")
    return rows.groupBy("file", "run").agg(F.min("offset").alias("start"), F.max(F.col("offset") + F.col("length")).alias("stop"), F.sort_array(F.collect_list(part)).alias("parts"))


def parse(record: bytes) -> dict:
    """Header fields and payload of one record."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/") or not record.endswith(b"\r\n\r\n"):
        raise ValueError("no WARC record at this place")
    found = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = block[:-4]
    if len(block) != int(found["Content-Length"]):
        raise ValueError("a record's length differs from its header")
    return {"fields": found, "payload": block}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(name: str) -> int | None:
        return int(text) if (text := name.removeprefix("<urn:page:").removesuffix(">")) else None

    for batch in batches:
        for row in batch.to_pylist():
            store, place = _store(row["file"])
            with store.open_input_file(place) as f:
                data = f.read_at(row["stop"] - row["start"], row["start"])
            out = []
            for part in row["parts"]:
                at = part["offset"] - row["start"]
                r = parse(gzip.decompress(data[at : at + part["length"]]))
                h, payload = r["fields"], r["payload"]
                digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
                if h["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                    raise ValueError("a payload differs from its digest")
                out.append({
                    "page_id": number(h["WARC-Record-ID"]), "url": h["WARC-Target-URI"], "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": digest,
                    "record_type": h["WARC-Type"], "refers_to": number(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None, "html": payload.decode("utf-8")})
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def read(index: DataFrame) -> DataFrame:
    """The records that the index rows name: page_id, url, payload_bytes and payload_digest (of
    the full payload), record_type, refers_to and html (empty for revisits)."""
    prepare(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0  # one number
    # the ranges are few and small rows, but each stands for up to RANGE bytes: tasks by bytes, not by rows
    return ranges(index).repartition(int(total // RANGE) + 1).mapInArrow(_read, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, html string")


#: DuckDB SQL of the records' facts over pages.
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda j: substr('{_BASE32}', ((('0x' || substr(sha1(h), 1 + 5 * (j // 4), 5))::BIGINT >> (15 - 5 * (j % 4))) & 31)::BIGINT + 1, 1)), '') AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
