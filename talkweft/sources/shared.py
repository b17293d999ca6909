"""Tables between jobs, where every executor sees them, and rows numbered over all partitions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="talkweft-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and a lost executor costs nothing."""
    path = shared_folder(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list, name: str, number: str = "number") -> DataFrame:
    """``df`` written in ``order``, with 0, 1, ... over all partitions: sorted ranges, and the sizes of those before each.

    Rows that ``order`` doesn't tell apart are numbered in any order. Only one row a range meets in one task.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranges = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = written(ranges.withColumn("_at", F.monotonically_increasing_id()), name)
    part = F.shiftright("_at", 33)
    sizes = table.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))
    at = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return table.withColumn("_part", part).join(starts, "_part").withColumn(number, F.col("_start") + at).drop("_part", "_start", "_at")
