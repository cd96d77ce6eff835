"""Incremental work on streams: only rows whose content changed are processed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessella.operators.quality import difference


def changed_rows(batch: DataFrame, previous: DataFrame | None, key: str, content: str) -> DataFrame:
    """Rows of a batch that are new or differ from the previous generation."""
    if previous is None:
        return batch
    fresh = difference(previous, batch, key, content).where("status IN ('added', 'rebuilt')").select(key)
    return batch.join(fresh, key, "left_semi")


def start(spark: SparkSession, source: DataFrame, key: str, content: str, state_path: str, checkpoint: str, process: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Run `process` on each micro-batch's changed rows and remember their content in one folder per batch.

    A batch that runs again after a failure overwrites its own folder and compares with the earlier ones only, so it sees the same rows.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        session = batch.sparkSession
        before = None
        if epoch:
            try:
                older = session.read.parquet(state_path).where(f"epoch < {epoch}")
                before = older.groupBy(key).agg(F.max_by(content, "epoch").alias(content))
            except Exception as e:  # no state yet: the first batches were empty
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                    raise
        fresh = changed_rows(batch, before, key, content)
        process(fresh, epoch)
        fresh.select(key, content).write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

