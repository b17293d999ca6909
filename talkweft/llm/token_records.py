"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

A record is: payload length (u64), masked CRC-32 of those 8 bytes (u32), payload, masked CRC-32 of the payload
(u32), all little-endian. A payload is: 1 if it has a doc_id (u8), doc_id (i64), bytes an id (u8), ids. The index
of a file has 16 bytes a record: offset (u64) and length of the whole record (u64), so that readers may take
records in any order. A checksum c is masked as rotate_right(c, 15) + 0xA282EAD8 modulo 2^32, lest sums of data
that hold sums be weak. Files follow ascending doc_id (null ids first; equal ids by text), a range of ids each;
a repeated task replaces its file by the same bytes.

Edge cases: null and empty texts are the end id alone; rows that repeat a doc_id are records of their own;
an empty table writes nothing and reads back as no rows; very long texts are one record each; other columns are not read,
so names can't clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import get_file, map_arrow, map_batches, put_file, release, shared_folder, shuffle_partitions, slices, written
from .tokens import WordCache, default_vocabulary, ids_of

END_ID = 1


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(doc_id: int | None, ids: np.ndarray) -> bytes:
    """One record; ids that all fit take two bytes each, else four."""
    wide = 2 if ids.max() < 65536 else 4
    payload = struct.pack("<BqB", doc_id is not None, doc_id or 0, wide) + ids.astype(f"<u{wide}").tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked(length)), payload, struct.pack("<I", masked(payload))))


def unframe(data: memoryview) -> tuple[int | None, np.ndarray]:
    """doc_id and ids of a record whose checksums hold."""
    size, head = struct.unpack_from("<QI", data)
    if masked(data[:8]) != head:
        raise ValueError("length checksum")
    payload = data[12 : 12 + size]
    if len(data) != size + 16 or masked(payload) != struct.unpack_from("<I", data, 12 + size)[0]:
        raise ValueError("payload checksum")
    there, doc_id, wide = struct.unpack_from("<BqB", payload)
    return doc_id if there else None, np.frombuffer(payload[10:], f"<u{wide}")


def write_records(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write; the manifest has part, path, records, tokens and bytes of each file."""
    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache, index, tokens = WordCache(vocabulary), [], 0

        def parts():
            nonlocal tokens
            for batch in (s for whole in batches for s in slices(whole)):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.append(ids_of(text, cache), np.uint32(end_id))
                    tokens += len(ids)
                    data = frame(doc_id, ids)
                    index.append(len(data))
                    yield data

        part = TaskContext.get().partitionId()
        stream = parts()
        first = next(stream, None)
        if first is not None:
            path, size = put_file(folder, f"part-{part:05d}.rec", _after(first, stream))
            ends = list(accumulate(index))
            put_file(folder, f"part-{part:05d}.idx", [np.column_stack([np.array(ends) - index, index]).astype("<u8").tobytes()])
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "records": [len(index)], "tokens": [tokens], "bytes": [size]})
        release()

    return written(map_arrow(ordered, run, "part long, path string, records long, tokens long, bytes long"), "record-manifest")


def _after(first: bytes, rest: Iterator[bytes]) -> Iterator[bytes]:
    yield first
    yield from rest


def read_records(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, found by the index.

    ``start`` counts from the first file on: one row a file, of a bounded number of files, meets in one window.
    """
    from pyspark.sql import Window

    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = manifest.select("path", before.alias("base")).repartition(shuffle_partitions(manifest.sparkSession), "path")

    def make():
        def work(x: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            for path, at in zip(x["path"], x["base"], strict=True):
                data = memoryview(get_file(path))
                index = np.frombuffer(get_file(path[:-4] + ".idx"), "<u8").reshape(-1, 2)
                for offset, size in index.tolist():
                    doc_id, ids = unframe(data[offset : offset + size])
                    out["doc_id"].append(doc_id)
                    out["start"].append(at)
                    out["n_tokens"].append(len(ids))
                    out["ids_crc32"].append(zlib.crc32(ids.astype("<u4").tobytes()))
                    at += len(ids)
            return out

        return work

    return map_batches(files, make, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_records(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    return read_records(write_records(docs, shared_folder(docs.sparkSession, "records"), vocabulary or default_vocabulary()))
