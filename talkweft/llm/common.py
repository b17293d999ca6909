"""What the corpus operators share: the cluster's shared folder, written tables, whole files, batches."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import talkweft
from talkweft.sources.shared import numbered, shared_folder

__all__ = ["numbered", "shared_folder"]  # besides what is defined here

# Functions of this package travel to the workers whole, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(talkweft)

BROADCAST_ROWS = 1_000_000  # 8-byte ids: 8 MB at most are broadcast; more take a shuffled join
SLICE_BYTES = 4 << 20  # texts of an Arrow batch that are Python objects at a time (one text at least)
BATCH_BYTES = 8 << 20  # an Arrow batch between JVM and Python (one row at least), where the session sets no other size


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._talkweft_path = path
    return out


def forget(table: DataFrame) -> None:
    """Remove the folder of a written() table that no plan will read again."""
    jvm, path = table.sparkSession._jvm, table._talkweft_path
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_ids(docs: DataFrame, ids: DataFrame, how: str, key: str = "doc_id") -> DataFrame:
    """Semi or anti join on ``key``. Counted ids up to BROADCAST_ROWS are broadcast, more are shuffled."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return docs.join(ids, key, how)


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of a batch whose strings and binaries stay within SLICE_BYTES together, or single rows."""
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, at = np.cumsum(size), 0
    while at < batch.num_rows:
        before = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right")))
        yield batch.slice(at, end - at)
        at = end


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as by rows: 10,000 long texts would be too many at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def release() -> None:
    """Give memory that a task freed back to the system: Python workers live on after it, beside the JVM."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str) -> DataFrame:
    """Arrow map. ``make`` runs once a task and gives a function of column lists, some MB at a time, that returns column lists."""
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    fields = _arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole):
                out = work({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)})
                if out[names[0]] is not None and len(out[names[0]]):
                    yield pa.RecordBatch.from_arrays([pa.array(out[n], fields.field(n).type) for n in names], schema=fields)
        del work
        release()

    return map_arrow(df, run, schema)


def filter_batches(df: DataFrame, make: Callable[[], Callable[..., list[bool]]], reads: list[str]) -> DataFrame:
    """The rows of ``df`` for which the function that ``make`` gives, called with the lists of columns ``reads``, says True.

    Only those columns become Python objects; rows pass as Arrow.
    """
    at = [df.columns.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole):
                kept = batch.filter(pa.array(work(*(batch.column(i).to_pylist() for i in at)), pa.bool_()))
                if kept.num_rows:
                    yield kept
        del work
        release()

    return map_arrow(df, run, df.schema)


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def put_file(folder: str, name: str, parts: Iterable[bytes]) -> tuple[str, int]:
    """Write one whole file and move it into place: a repeated task replaces it by the same bytes."""
    fs, root = pafs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")
    fs.create_dir(root, recursive=True)
    part, size = f"{root}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part) as out:
        for b in parts:
            out.write(b)
            size += len(b)
    fs.move(part, f"{root}/{name}")
    return f"{folder}/{name}", size


def get_file(uri: str) -> bytes:
    fs, path = pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")
    with fs.open_input_file(path) as f:
        return f.read()
