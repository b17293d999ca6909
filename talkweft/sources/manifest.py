"""Manifests as a data source: one input partition for each byte range of each split's file.

    spark.dataSource.register(ManifestSource)
    spark.read.format("talkweft_manifest").load("/corpus/manifest.json").where("split = 'train'")

Columns: split, file, offset (of the line in its file) and value (the line, without its break; a mark of byte order is
dropped). Filters on split are pushed down (``spark.sql.python.filterPushdown.enabled``): files of other splits are never
opened. A line belongs to the range in which it begins, so ranges need nothing of each other. Files are opened with pyarrow:
local paths, and stores whose URI it knows.

Options: ``range_bytes`` (64 MB), ``verify`` (false): then every file that is read is held against the sha256 of its manifest
entry, in one pass over its bytes by one task, block by block.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

RANGE_BYTES = 64 << 20
BLOCK = 1 << 20
LINES = "split string, file string, offset long, value string"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def entries_of(manifest: dict, folder: str) -> list[tuple[str, str, str | None]]:
    """split, file and sha256 of what a manifest includes; a path that leaves the manifest's folder is refused."""
    found = []
    listed = [(e.get("split", e.get("name")), e) for e in manifest.get("tool_sft", [])]
    for name, e in manifest.get("splits", {}).items():
        listed += [(name, x) for x in (e if isinstance(e, list) else [e])]
    for split, e in listed:
        if e.get("included", True):
            if e["path"].startswith("/") or ".." in e["path"].split("/"):
                raise ValueError(f"{split} path must be manifest-relative")
            found.append((split, f"{folder}/{e['path']}", e.get("sha256")))
    if not found:
        raise ValueError("manifest has no split")
    return found


def file_digest(uri: str) -> str:
    """sha256 of a file, a block at a time."""
    fs, path = _open(uri)
    state = hashlib.sha256()
    with fs.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            state.update(block)
    return state.hexdigest()


@dataclass
class _Range(InputPartition):
    split: str
    file: str
    start: int
    end: int
    sha256: str | None


def lines_of(uri: str, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a range of bytes."""
    fs, path = _open(uri)
    with fs.open_input_file(path) as f:
        at, rest = max(0, start - 1), b""  # the byte before the range says whether a line begins with it
        f.seek(at)
        skip, done = start > 0, False
        while not done:
            block = f.read(BLOCK)
            data, done = rest + block, not block
            pieces = data.split(b"\n")
            rest = b"" if done else pieces.pop()
            if done and not pieces[-1]:
                pieces.pop()
            for line in pieces:
                if skip:
                    skip = False
                elif at >= end:
                    return
                else:
                    yield at, line.removesuffix(b"\r")
                at += len(line) + 1
            if at >= end and not skip:
                return


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.manifest, self.splits = options["path"], None
        self.range_bytes = int(options.get("range_bytes", RANGE_BYTES))
        self.verify = options.get("verify", "false").lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("split",):
                wanted = set(f.value if isinstance(f, In) else [f.value])
                self.splits = wanted if self.splits is None else self.splits & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, path = _open(self.manifest)
        with fs.open_input_stream(path) as f:
            entries = entries_of(json.loads(f.read()), self.manifest.rsplit("/", 1)[0])
        out: list[InputPartition] = []
        for split, file, sha256 in entries:
            if self.splits is not None and split not in self.splits:
                continue
            if self.verify and not sha256:
                raise ValueError(f"manifest has no digest of {file}")
            files, where = _open(file)
            size = files.get_file_info(where).size
            if size is None:
                raise FileNotFoundError(file)
            ranges = range(0, max(size, 1), self.range_bytes)
            out += [_Range(split, file, a, min(a + self.range_bytes, size), sha256 if self.verify and a == 0 else None) for a in ranges]
        return out

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # no split is left
            return
        if part.sha256 and file_digest(part.file) != part.sha256.removeprefix("sha256:"):
            raise ValueError(f"digest of {part.file} differs")
        names, rows, size = ["split", "file", "offset", "value"], [], 0
        for offset, line in lines_of(part.file, part.start, part.end):
            text = line.decode("utf-8-sig" if offset == 0 else "utf-8")
            rows.append((offset, text))
            size += len(line)
            if size > 8 * BLOCK or len(rows) == 10_000:
                yield self._batch(part, rows, names)
                rows, size = [], 0
        if rows:
            yield self._batch(part, rows, names)

    @staticmethod
    def _batch(part: _Range, rows: list, names: list[str]) -> pa.RecordBatch:
        offsets, texts = zip(*rows, strict=True)
        columns = [pa.array([part.split] * len(rows)), pa.array([part.file] * len(rows)), pa.array(offsets, pa.int64()), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names)


class ManifestSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "talkweft_manifest"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read_manifest_lines(spark: SparkSession, manifest: str, splits: list[str] | None = None, **options) -> DataFrame:
    """Lines of a manifest's files; of these splits alone, where they are named."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ManifestSource)
    df = spark.read.format(ManifestSource.name()).options(**{k: str(v) for k, v in options.items()}).load(manifest)
    return df if splits is None else df.where(df["split"].isin(splits))
