"""WARC archives whose records are Zstandard frames that share a dictionary.

A dictionary is built from DICT_RECORDS of the records (those of the least hashed ids, no longer than
DICT_RECORD_BYTES; a bounded sample). Every archive starts with a skippable frame (0x184D2A5D) that holds it,
followed by one frame for each record, compressed on its own, so that a record is read by its offset alone.
Of records with equal payloads of at least MIN_BYTES that with the smallest page_id is a response; the others
are revisits that name it and carry no payload.

Edge cases: a null html is an empty payload; null urls become ``urn:page:<id>``; smaller payloads than MIN_BYTES
are always responses; records of null page_id are responses; rows that repeat a page_id and its payload are
written each, all of them responses if the first is; very long payloads are one frame each, compressed whole; other
columns are not read, so names can't clash; with an empty table there is no archive and no row.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, get_file, map_arrow, map_batches, put_file, shared_folder, shuffle_partitions, written

MIN_BYTES = 0
DICT_RECORDS, DICT_RECORD_BYTES, DICT_BYTES = 400, 65536, 65536
SKIPPABLE = 0x184D2A5D
LEVEL = 3


def _record_id(page_id: int | None, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")


def _head(kind: str, page_id: int | None, uri: str, digest: str, length: int, block: int, first: int | None) -> bytes:
    rid = _record_id(page_id, digest)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{rid}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {length}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{_record_id(first, digest)}>", f"X-Refers-To-Page: {first}"]
    return ("\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {block}"]) + "\r\n\r\n").encode("utf-8", "surrogatepass")


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None) -> bytes:
    """One record; a revisit of page ``first`` where that is given."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = re.sub(r"[\r\n]", " ", url) if url else f"urn:page:{page_id}"
    body = b"" if first is not None else payload
    return _head("response" if first is None else "revisit", page_id, uri, digest, len(payload), len(body), first) + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return fields | {"payload": rest[: int(fields["Content-Length"])]}


def dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of these records; empty where they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=1024, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def leading_frame(trained: bytes) -> bytes:
    return struct.pack("<II", SKIPPABLE, len(trained)) + trained


def read_archive(data: bytes):
    """(offset, record) of an archive."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("archive lacks its dictionary frame")
    trained = data[8 : 8 + size]
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(trained)) if trained else zstandard.ZstdDecompressor()
    at = 8 + size
    view = memoryview(data)
    while at < len(data):
        frame = reader.decompressobj()
        out = [frame.decompress(view[at : at + 65536])]
        upto = at + 65536
        while not frame.eof:
            out.append(frame.decompress(view[upto : upto + 65536]))
            upto += 65536
        end = min(upto, len(data)) - len(frame.unused_data)
        yield at, b"".join(out)
        at = end


def _small(table: DataFrame) -> DataFrame:
    """A written table of digests and ids, broadcast where it has at most 100,000 rows (10 MB)."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS // 10 else table


def revisits(pages: DataFrame) -> DataFrame:
    """page_id and first for pages whose payload a smaller page_id has; payloads meet as digests only."""
    payload = F.coalesce("html", F.lit(""))
    sums = pages.where("page_id IS NOT NULL").select("page_id", F.sha1(payload).alias("sum"), F.octet_length(payload).alias("size")).where(F.col("size") >= MIN_BYTES)
    first = sums.groupBy("sum", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("sum", "size", "first")
    first = _small(written(first, "payloads"))
    return sums.join(first, ["sum", "size"]).where("page_id > first").groupBy("page_id", "sum").agg(F.min("first").alias("first"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write every page; the manifest has path, records and bytes of each archive."""
    pages = pages.select("page_id", "url", "html")
    pick = [r[0] for r in pages.where("page_id IS NOT NULL").select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(DICT_RECORDS).collect()]
    some = pages.where(F.col("page_id").isin(pick) & (F.length(F.coalesce("html", F.lit(""))) <= DICT_RECORD_BYTES)).orderBy("page_id").limit(DICT_RECORDS).collect() if pick else []
    trained = dictionary([record(r["page_id"], r["url"], (r["html"] or "").encode("utf-8", "surrogatepass"), None) for r in some])
    full = pages.withColumn("sum", F.sha1(F.coalesce("html", F.lit("")))).join(_small(written(revisits(pages), "revisits")), ["page_id", "sum"], "left").select("page_id", "url", "html", "first")

    def run(batches):
        import pyarrow as pa

        count = 0

        def parts():
            nonlocal count
            yield leading_frame(trained)
            with_dict = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
            writer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **with_dict)
            for batch in [head, *batches]:
                for page_id, url, html, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    count += 1
                    yield writer.compress(record(page_id, url, (html or "").encode("utf-8", "surrogatepass"), first))

        batches = iter(batches)
        head = next((b for b in batches if b.num_rows), None)
        if head is not None:
            path, size = put_file(folder, f"part-{TaskContext.get().partitionId():05d}.warc.zst", parts())
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count], "bytes": [size]})

    return written(map_arrow(full, run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives: ids, digest (checked for responses), type, and place."""

    def make():
        def work(x: dict) -> dict:
            names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_offset")
            out: dict[str, list] = {k: [] for k in names}
            for path in x["path"]:
                for at, data in read_archive(get_file(path)):
                    r = parse(data)
                    digest = r["WARC-Payload-Digest"][5:]
                    if r["WARC-Type"] == "response" and base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() != digest:
                        raise ValueError(f"payload digest of page {r['X-Page-Id']}")
                    refers = r.get("X-Refers-To-Page")
                    row = (int(r["X-Page-Id"]) if r["X-Page-Id"] else None, int(r["X-Payload-Length"]), digest, r["WARC-Type"], None if refers is None else int(refers), path.rsplit("/", 1)[1], at)
                    for k, v in zip(names, row, strict=True):
                        out[k].append(v)
            return out

        return work

    files = manifest.select("path").repartition(shuffle_partitions(manifest.sparkSession), "path")
    return map_batches(files, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, record_offset long")


def archive_pages(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, shared_folder(pages.sparkSession, "warc")))
