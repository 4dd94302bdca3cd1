"""Tables written to the folder that driver and executors share.

Cutting lineage by a written table keeps a job recoverable: a lost executor
costs a reread, never a recomputation of everything upstream.
"""

from __future__ import annotations

import math
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, one of our own if all tasks run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or os.path.join(tempfile.gettempdir(), "checkpoints")


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    """What runs inside leaves no shuffle files behind."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)


def stage(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """Write `df` to the shared folder, apart for each value of `by`, and return a reader of what was written; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    with _released(spark):
        write = df.write.option("compression", "zstd")
        (write.partitionBy(by) if by else write).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if by:  # a folder's column comes last
        out = out.select(*df.columns)
    out._staged_path = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a staged table that no later plan reads."""
    path = getattr(df, "_staged_path", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def _bytes(df: DataFrame) -> int:
    """Size of the tables behind `df`: of its plan's leaves, as estimates of single columns miss how long texts are, or measured where a leaf has none."""
    plan, unknown = df._jdf.queryExecution().optimizedPlan(), df.sparkSession._jsparkSession.sessionState().conf().defaultSizeInBytes()
    found = plan.collectLeaves()
    leaves = [int(str(found.apply(i).stats().sizeInBytes())) for i in range(found.size())]
    if max(leaves, default=0) >= unknown:
        return int(df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    return sum(leaves)


def groups_of(size: int, partitions: int, mb_each: float = 4, row_bytes: int = 4096) -> int:
    """How many groups, and as many buckets, `size` bytes of documents are dealt into.

    Every group sends every bucket a row, so groups grow with the square root
    of the input once they pass `mb_each`: rows stay at one for `row_bytes` of
    input, however large that is (11 MB a group at 30 GB, 640 MB at 100 TB).
    Small inputs spread over the session's partitions.
    """
    each = max(mb_each * 1e6, math.sqrt(size * row_bytes))
    return max(1, math.ceil(size / each), min(partitions, size >> 20))


def width(df: DataFrame, mb_each: float = 4, row_bytes: int = 4096) -> int:
    """groups_of() the documents of `df`, from the plan's size statistics (file sizes, no job), or one scan where it has none."""
    return groups_of(_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), mb_each, row_bytes)
