"""The folder that driver and executors share: where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset a folder of our own if all runs in one process, else an error; checkpoint() works after this."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        found = context._jsc.sc().getCheckpointDir()
        if found.isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="tessella-"))
            found = context._jsc.sc().getCheckpointDir()
        base = found.get()
    elif context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(base)
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses and that goes when the session ends."""
    path = f"{shared_folder(spark)}/tessella-{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


@contextmanager
def own_shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, a write drops the shuffle files that it alone made once it has ended."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read again."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with own_shuffles_dropped(spark):
        df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
