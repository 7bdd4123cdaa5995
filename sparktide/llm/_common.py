"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_SPLIT = r"[\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch handed to a Python worker.
BATCH_ROWS, BATCH_BYTES = 2000, 16 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Unset on a single machine (tests): a folder for temporary files. Unset on
    a cluster: the warehouse, which is shared too.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.startswith("local"):
            found = f"file://{tempfile.gettempdir()}/checkpoints"
        else:
            found = spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/sparktide/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches, so that very long texts don't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lean(fn):
    """A mapInArrow function whose worker gives memory back between batches.

    Workers are used again; what one stage held would add up with the next.
    """

    @functools.wraps(fn)
    def run(batches):
        import pyarrow as pa

        pa.set_memory_pool(pa.system_memory_pool())
        for out in fn(batches):
            yield out
            del out
            trim()
        trim()

    return run


class Workspace:
    """Intermediate tables in the shared folder.

    A written table cuts the lineage: a lost executor costs the tasks that it
    ran, not the stages before. ``drop`` removes tables no longer needed.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.label, self.paths = spark, label, {}

    def table(self, df: DataFrame, name: str, *partition_by: str, level: int = 3) -> DataFrame:
        path = new_path(self.spark, f"{self.label}-{name}")
        schema = df.schema
        writer = df.write.option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
        writer = writer.option("parquet.compression.codec.zstd.level", str(level))
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                remove(self.spark, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of frames that nobody holds any more."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give freed memory of this process back to the system."""
    import ctypes

    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def local_table(spark: SparkSession, data: dict, schema: str) -> DataFrame:
    """A DataFrame of driver-side columns, without a Python stage."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kind = to_arrow_schema(_parse_datatype_string(schema))
    return spark.createDataFrame(pa.table({f.name: pa.array(data[f.name], f.type) for f in kind}, schema=kind))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
