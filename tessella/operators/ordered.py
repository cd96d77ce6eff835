"""Total orders without one task that holds all rows: global ranks and digests of ordered groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.sources.shared import written


def global_rank(rows: DataFrame, order: list[Column | str], name: str = "rank") -> DataFrame:
    """rows with their ranks from 1 in a total order: ranges are ranked apart and shifted by the sizes of those before.

    The ranges are written once, as two passes over a sampled partitioning could differ.
    """
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).drop("_n")
    inner = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranges.withColumn("_inner", inner).join(F.broadcast(before), "_range").withColumn(name, (F.col("_inner") + F.col("_before")).cast("long")).drop("_range", "_inner", "_before")


def tree_digest(rows: DataFrame, group: str, key: str, part: Column, fan: int = 1000, levels: int = 3) -> DataFrame:
    """(group, digest): sha256 of a tree of digests: of the parts in key order for each run of `fan` keys, then of those digests, and so on.

    No list has more than `fan` entries up to fan ** levels keys in a group.
    """
    level = rows.select(group, F.col(key).cast("long").alias("_k"), F.sha2(F.encode(part, "utf-8"), 256).alias("_h"))
    for i in range(levels):
        above = F.lit(0).cast("long") if i == levels - 1 else F.floor(F.col("_k") / fan).cast("long")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("_k", "_h"))), lambda x: x["_h"])
        level = level.withColumn("_up", above).groupBy(group, "_up").agg(F.sha2(F.array_join(ordered, ""), 256).alias("_h")).withColumnRenamed("_up", "_k")
    return level.select(group, F.col("_h").alias("digest"))
