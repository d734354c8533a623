"""What the corpus operators share: the shared folder, written intermediate tables, slices of batches."""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, local mode gets a new folder; a cluster gets an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recordspark-"))
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Steps:
    """Intermediate tables of a job, in the shared folder; those that nothing reads any more can be dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, label: str, df: DataFrame) -> DataFrame:
        """df, written as Parquet and read back: cuts lineage and outlives executors."""
        self._collect_garbage()
        self.paths[label] = path = new_path(self.spark, label)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        for label in labels:
            remove(self.spark, self.paths.pop(label))
        self._collect_garbage()

    def _collect_garbage(self) -> None:
        """Shuffle files of earlier steps go once nothing refers to them."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, label: str) -> DataFrame:
    return Steps(df.sparkSession).write(label, df)


def scan_partitions(df: DataFrame) -> int:
    """How many partitions df has; for a scan, that follows the size of its files."""
    return max(1, df.rdd.getNumPartitions())


def whole_row(df: DataFrame) -> Column:
    """All columns in one struct, so that columns added beside it clash with none. Unpack it by select("row.*")."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns)).alias("row")


def sliced(batches, column: str, most: int = 4_000_000):
    """Arrow batches in slices of about `most` bytes in `column` (strings or binaries)."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            yield batch.slice(start, end - start)
            start = end
    pa.default_memory_pool().release_unused()  # workers live on; what they don't need goes back


def slice_arrays(column: pa.Array, most: int = 4_000_000):
    """An array of strings or binaries in slices of about `most` bytes."""
    for part in sliced([pa.RecordBatch.from_arrays([column], ["x"])], "x", most):
        yield part.column(0)
