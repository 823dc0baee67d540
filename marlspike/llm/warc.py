"""WARC: a deterministic sharded writer and its reader.

Records are dealt by ranges of their key and sorted, so shard files hold disjoint key ranges. Every
header is made anew from the payload: lengths, block and payload digests, record ids. Each record is a
gzip member of its own, without time or name; a file is closed when its compressed size reaches the
limit. A task writes under a temporary name and renames when the file is whole, so a task that runs
again, or twice, leaves the same file. The manifest, written and renamed last, lists the files that
count; readers read only these.
"""

from __future__ import annotations

import base64
import contextlib
import gzip
import hashlib
import io
import json
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import filesystem
from .common import shared_dir, sliced, table

#: Compressed bytes at which a file is closed; the date in all headers; the manifest's name.
FILE_BYTES, DATE, MANIFEST = 256 << 20, "2000-01-01T00:00:00Z", "manifest.json"
#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key, digest: str, nth: int, kind: str) -> str:
    """Unique: rows that repeat a key and a payload are numbered."""
    return f"<urn:marlspike:{'null' if key is None else key}:{digest}:{nth}:{kind}>"


def record(key, url: str, payload: bytes, refers_to, nth: int = 0) -> bytes:
    """One record as a gzip member: a response, or a revisit of the first record that refers_to (a one-element tuple, its key) names."""
    digest = base32_sha1(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = ("response", http + payload) if refers_to is None else ("revisit", http)
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(key, digest, nth, kind)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to[0], digest, 0, 'response')}"]
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as z:
        z.write("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")
    return out.getvalue()


def safe_url(url: str | None) -> str:
    """The URL without what would end its header line."""
    return "".join(c for c in url or "" if c >= " " and c != "\x7f")


def writing(folder: str, file_bytes: int):
    """From rows sorted by (key, is_record): revisit notes (digest, refers_to) of a key, then its records. Yields (name, records, bytes)."""

    def f(batches):
        fs, path = filesystem(folder)
        task = TaskContext.get()
        shard, attempt = task.partitionId(), task.taskAttemptId()
        out, held, notes, seen = None, object(), {}, {}
        made: list[tuple[str, int, int]] = []

        def close():
            nonlocal out
            if out is not None:
                stream, name, n, size = out
                stream.close()
                fs.move(f"{path}/.tmp-{attempt}-{name}", f"{path}/{name}")
                made.append((name, n, size))
                out = None

        for batch in sliced(batches, "html"):
            for key, is_record, digest, refers_to, url, html in zip(*(batch.column(i).to_pylist() for i in range(6))):
                if key != held:
                    held, notes, seen = key, {}, {}
                if not is_record:
                    notes[digest] = refers_to
                    continue
                payload = (html or "").encode()
                member = record(key, safe_url(url), payload, (notes[digest],) if digest in notes else None, seen.get(digest, 0))
                seen[digest] = seen.get(digest, 0) + 1
                if out is None:
                    name = f"part-{shard:05d}-{len(made):05d}.warc.gz"
                    out = [fs.open_output_stream(f"{path}/.tmp-{attempt}-{name}", compression=None), name, 0, 0]
                out[0].write(member)
                out[2], out[3] = out[2] + 1, out[3] + len(member)
                if out[3] >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["name", "records", "bytes"])

    return f


def revisits(pages: DataFrame, key: str, html: str, least_bytes: int) -> DataFrame:
    """(key, digest, refers_to) of the records whose payload a record of a larger key also has."""
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.sha1(F.encode(text, "utf-8")).alias("digest"), F.octet_length(text).alias("bytes")).where(F.col("bytes") >= least_bytes)
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("key").alias("largest")).where("n > 1 AND largest IS NOT NULL").select("digest", "largest")
    groups = groups.checkpoint()  # small: what is joined then is two plain exchanges, which Spark can split where one payload has many rows
    return rows.join(groups, "digest").where(~F.col("key").eqNullSafe(F.col("largest"))).select("key", "digest", F.col("largest").alias("refers_to")).distinct()


def write_archives(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES) -> dict:
    """Writes a record for each row into folder, a URI that driver and executors share, and returns the manifest.

    Of rows with equal payloads of least_bytes or more, those of the largest key are responses and the
    others revisit it; null keys are below all others and come first, and if all keys are null all are
    responses. A null payload or URL is empty. Rows that repeat a key and a payload are records alike.
    """
    from pyarrow.fs import FileSelector

    shared_dir(pages.sparkSession)
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    text = F.coalesce(F.col(html).cast("string"), F.lit(""))
    notes = revisits(pages, key, html, least_bytes).select("key", F.lit(False).alias("is_record"), "digest", "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    records = pages.select(F.col(key).cast("long").alias("key"), F.lit(True).alias("is_record"), F.sha1(F.encode(text, "utf-8")).alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.col(url).cast("string").alias("url"), text.alias("html"))
    by_key = notes.union(records).repartitionByRange("key").sortWithinPartitions("key", "is_record", "digest", "url")
    files = by_key.mapInArrow(writing(folder, file_bytes), "name string, records long, bytes long").toArrow().to_pylist()
    for left in fs.get_file_info(FileSelector(path)):  # of attempts that failed
        if left.base_name.startswith(".tmp-"):
            with contextlib.suppress(FileNotFoundError):
                fs.delete_file(left.path)
    manifest = {"files": sorted(files, key=lambda x: x["name"])}
    with fs.open_output_stream(f"{path}/.tmp-{MANIFEST}", compression=None) as out:
        out.write(json.dumps(manifest, indent=1).encode())
    fs.move(f"{path}/.tmp-{MANIFEST}", f"{path}/{MANIFEST}")
    return manifest


def records_of(stream):
    """(headers, block) of each record of an archive stream, one gzip member at a time; checks lengths and block digests."""
    unzip, text, fed = zlib.decompressobj(31), bytearray(), b""
    while True:
        if not fed:
            fed = stream.read(1 << 20)
            if not fed:
                if text:
                    raise ValueError("the archive ends within a record")
                return
        text += unzip.decompress(fed)
        fed = unzip.unused_data if unzip.eof else b""
        if unzip.eof:
            head, _, rest = bytes(text).partition(b"\r\n\r\n")
            headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            block = rest[: int(headers["Content-Length"])]
            if rest[len(block) :] != b"\r\n\r\n" or headers["WARC-Block-Digest"] != "sha1:" + base32_sha1(block):
                raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
            yield headers, block
            unzip, text = zlib.decompressobj(31), bytearray()


READ = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string"


def reading(folder: str, with_html: bool):
    def number(urn: str | None):
        n = urn and urn.split(":")[2]
        return None if n in (None, "null") else int(n)

    def f(batches):
        fs, path = filesystem(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with fs.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for h, block in records_of(stream):
                        payload = block.partition(b"\r\n\r\n")[2]
                        response = h["WARC-Type"] == "response"
                        if response and "sha1:" + base32_sha1(payload) != h["WARC-Payload-Digest"]:
                            raise ValueError(f"{h['WARC-Record-ID']} has another payload than its digest")
                        rows.append((number(h["WARC-Record-ID"]), h["WARC-Target-URI"], int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], number(h.get("WARC-Refers-To")), payload.decode() if with_html and response else None))
                        if len(rows) >= 1000:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    def made(rows):
        types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["key", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"])

    return f


def read_archives(spark: SparkSession, folder: str, with_html: bool = False) -> DataFrame:
    """The records of the files in a folder's manifest; html only for responses and on demand."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
        names = [x["name"] for x in json.loads(f.read())["files"]]
    files = spark.createDataFrame([(x,) for x in names], "name string")
    return files.repartition(max(1, len(names)), "name").mapInArrow(reading(folder, with_html), READ)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY sha1(b)) AS m FROM p),
bits AS (SELECT page_id, payload_bytes, m, hex, array_to_string(list_transform(range(1, 41), lambda i: bin((strpos('0123456789abcdef', hex[i]) - 1) + 16)[2:]), '') AS s FROM h)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + list_sum(list_transform(range(0, 5), lambda j: s[5 * k + j + 1]::INTEGER * (1 << (4 - j))))::INTEGER]), '') AS payload_digest,
 CASE WHEN m IS NULL OR page_id = m THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> m THEN m END AS refers_to FROM bits
"""
