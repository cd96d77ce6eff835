"""Pairs within groups, in blocks of bounded size: a group of any size becomes many small tasks, and small groups share a call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forest

#: Rows that a call gets at least, if there are as many, from one group or several.
CALL_ROWS = 4096


def paired_blocks(rows: DataFrame, group: list[str], key: str, size: int, weight: Column | None = None, most: int = 0) -> DataFrame:
    """Each row once for every pair of blocks of its group that its own block is part of.

    Adds bi <= bj, the pair of blocks, and `second`, whether the row's block is bj (not when bi = bj). Grouped by (*group, bi, bj), the
    pairs of rows with unlike `second`, or any two rows where bi = bj, are the pairs of the group, each once. Groups of one row go.
    Blocks have about `size` rows, and a weight (bytes) of about `most`, whichever is less.
    """
    blocks = F.ceil(F.count("*") / size) if weight is None else F.greatest(F.ceil(F.count("*") / size), F.ceil(F.sum(weight) / most))
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n"), blocks.cast("int").alias("_blocks")).where("_n > 1").drop("_n")
    own = F.pmod(F.xxhash64(key), F.col("_blocks")).cast("int")
    dealt = rows.join(counts, group).withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return dealt.select("*", F.least("_own", "_other").alias("bi"), F.greatest("_own", "_other").alias("bj"), (F.col("_own") > F.col("_other")).alias("second")).drop("_blocks", "_own", "_other")


def by_groups(rows: DataFrame, group: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """`work` over tables of whole groups: it gets rows and where each group starts in them.

    Groups are told apart by a 64-bit hash. A table has some CALL_ROWS rows, or those of its one larger group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < CALL_ROWS:
                continue
            table = pa.Table.from_batches(held)
            g = table["_g"].to_numpy()
            last = int(np.searchsorted(g, g[-1]))  # the last group may go on
            if last:
                yield from _worked(table.slice(0, last), work)
            held = table.slice(last).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from _worked(pa.Table.from_batches(held), work)

    marked = rows.select(F.xxhash64(*group).alias("_g"), "*")
    return marked.repartition("_g").sortWithinPartitions("_g").mapInArrow(run, schema)


def _worked(table: pa.Table, work: Callable) -> Iterator[pa.RecordBatch]:
    g = table["_g"].to_numpy()
    starts = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
    yield from work(table.combine_chunks(), starts).to_batches()


def keyed_candidates(classes: DataFrame, work: Callable[[pa.Table, np.ndarray], pa.Table], most: int) -> DataFrame:
    """(id, root): what `work` finds among the classes (node, keys, sketch) that share a key; only keys and sketches move.

    Keys that hold the same classes are met once; one of more than `most` classes is met in pairs of blocks.
    """
    bands = classes.select("node", F.explode("keys").alias("key"))
    held = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.expr("bit_xor(xxhash64(node))").alias("set")).where("n > 1")
    once = held.groupBy("n", "least", "set").agg(F.min("key").alias("key")).select("key", "n")
    met = bands.join(once, "key").join(classes.select("node", "sketch"), "node")
    blocks = F.ceil(F.col("n") / most).cast("int")
    met = met.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    met = met.select("key", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "node", "sketch")
    return by_groups(met, ["key", "bi", "bj"], work, "id long, root long")


def connected(nodes: np.ndarray, starts: np.ndarray, near: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Table:
    """(id, root) rows that connect the nodes whose rows are near and in one group; near(i, j) tells which rows i[k] and j[k] are.

    In a group each row is held against those rows that no cluster has yet, so a dense group takes linear time.
    """
    ends = np.append(starts[1:], len(nodes))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = np.repeat(ends - starts <= 16, ends - starts)
    group = np.repeat(np.arange(len(starts)), ends - starts)
    for d in range(1, 16):  # small groups together: all pairs, by how far apart they lie
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if not len(i):
            break
        i = i[near(i, i + d)]
        a.append(nodes[i + d])
        b.append(nodes[i])
    for lo, hi in zip(starts[ends - starts > 16], ends[ends - starts > 16], strict=True):
        free = np.arange(lo, hi)
        while len(free):
            root, queue, free = free[0], [free[0]], free[1:]
            while queue and len(free):
                hit = near(np.full(len(free), queue.pop()), free)
                a.append(nodes[free[hit]])
                b.append(np.full(int(hit.sum()), nodes[root]))
                queue.extend(free[hit].tolist())
                free = free[~hit]
    member, root = forest(np.concatenate(a), np.concatenate(b))
    return pa.table({"id": member, "root": root})
