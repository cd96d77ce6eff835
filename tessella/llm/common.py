"""What the corpus operators share: shared-folder tables, Arrow tokenising, hashing, blocks of a group."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.shared import fresh_path, shared_folder, written

__all__ = ["arrow_rows", "bucketed", "crc_mod", "forest", "fresh_path", "hashes", "mix", "rolling", "shared_folder", "shingle_sets", "slices", "word_hashes", "words_of", "written"]

#: Bytes of text that one numpy step works on; a longer text is a step of its own.
SLICE_BYTES = 8 << 20


@contextmanager
def arrow_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Within it, jobs send n rows at most to a Python worker at once: for rows that are large themselves."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Write a table of large rows bucketed by its column `block`, without a shuffle; the table and its number of rows.

    A join with it on that column moves the other side only.
    """
    spark = df.sparkSession
    path, table = fresh_path(spark, name), f"tessella_{name}_{uuid.uuid4().hex}"
    buckets = max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.format("parquet").option("path", path).option("compression", "uncompressed").bucketBy(buckets, "block").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # of an external table the files stay, which is all that `out` needs
    return out, out.count()


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts have about `limit` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        step = (np.cumsum(size) - size) // limit
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(step)) + 1, [len(size)]))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(lo, hi - lo)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case, one after another, and the offset of each row's first (null: none)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = parts.flatten(), parts.offsets.to_numpy()
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    return flat.filter(pa.array(full)), before[ends - ends[0]]


def hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of a few distinct words."""
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and the offset of each row's first word."""
    flat, offsets = words_of(texts)
    coded = flat.dictionary_encode()
    table = hashes(coded.dictionary.to_pylist())
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(table) else np.zeros(0, np.uint64), offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def rolling(hashed: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; entry i starts at word i."""
    if len(hashed) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashed) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mix(hashed[i : len(hashed) - k + 1 + i])
    return mix(out)


def shingle_sets(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingles of each row, one after another, and each row's offset. A text of 1 to k - 1 words is one shingle."""
    hashed, at = word_hashes(texts)
    counts = np.diff(at)
    rolled = rolling(hashed, k)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    rows = np.repeat(np.arange(len(counts)), n)
    starts = np.concatenate(([0], np.cumsum(n)))
    index = np.arange(len(rows)) - starts[:-1][rows] + at[:-1][rows]
    values = rolled[np.minimum(index, max(len(rolled) - 1, 0))] if len(rolled) else np.zeros(len(rows), np.uint64)
    for r in np.flatnonzero((counts > 0) & (counts < k)):
        values[starts[r]] = rolling(hashed[at[r] : at[r + 1]], int(counts[r]))[0]
    order = np.lexsort((values, rows))
    values, rows = values[order], rows[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    values, rows = values[new], rows[new]
    return values, np.searchsorted(rows, np.arange(len(counts) + 1))


def crc_mod(column: Column | str, by: int) -> Column:
    """crc32 of an id's decimal text, modulo `by`."""
    return F.crc32(F.col(column).cast("string").cast("binary") if isinstance(column, str) else column.cast("string").cast("binary")) % by


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the links between a[i] and b[i], a subset that connects what they connect, as (member, least of its component)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]
