"""n-gram Jaccard join with Bayesian candidate pruning.

Documents with one set of word shingles form a class; only class representatives are compared. Banded MinHash keys propose candidates
(a pair at the threshold shares a band but for about 1 in 10^7). Classes that share a key meet as sketches (a byte of each MinHash value): they are
compared a few values at a time, and a pair drops out when the posterior probability of reaching the threshold falls below the tolerance (uniform
prior). Keys that hold the same classes are met once. What survives connects classes into groups; within a group, in blocks, every pair is verified
on the whole shingle sets. Links are counted and joined into forests where they are found, so rows stay linear in documents.

Nulls: a null or empty text has no shingles and links with nothing; a text of fewer words than a shingle is one shingle; a null id
links with nothing. Rows that repeat an id and text count each as a member of the class; an id with several texts is in several
classes, each of which is compared by a text of its own, and which it joins into one component. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import connected, keyed_candidates, paired_blocks
from .common import arrow_rows, forest, mix, shingle_sets, slices, written
from .graph import components

BANDS, ROWS = 40, 5
SKETCH = "doc_id long, print long, h1 long, h2 long, keys array<long>, sketch binary"
#: MinHash values in a sketch; classes of a key that are compared at once; bytes of text in a block of a group.
VALUES, MET, BLOCK_BYTES = 128, 4096, 4 << 20


def minhash(values: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
    """(sets, n) least hashes; the sets, none empty, lie one after another at `at`."""
    rng = np.random.default_rng(seed)
    factor, term = rng.integers(0, 2**32, n, np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, np.uint32)
    low = (values ^ (values >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(at) - 1, n), np.uint32)
    for k in range(n):
        h = low * factor[k]
        h ^= h >> np.uint32(15)
        h += term[k]
        out[:, k] = np.minimum.reduceat(h, at[:-1]) if len(at) > 1 else 0
    return out


def _sketches(k: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            values, at = shingle_sets(batch.column("text"), k)
            full = np.flatnonzero(np.diff(at))
            own = np.append(at[full], len(values))
            sums = np.zeros((2, batch.num_rows), np.int64)
            keys, low = np.zeros((len(full), BANDS), np.int64), np.zeros((len(full), VALUES), np.uint8)
            if len(full):
                for i, salt in enumerate((0x51ED270B, 0x2545F491)):
                    sums[i, full] = np.add.reduceat(mix(values ^ np.uint64(salt << 17)), own[:-1]).astype(np.int64)
                sig = minhash(values, own, BANDS * ROWS, 3)
                low = sig[:, :VALUES].astype(np.uint8)
                sig = sig.astype(np.uint64).reshape(len(full), BANDS, ROWS)
                h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(full), 1), np.uint64)
                for r in range(ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, r])
                keys = h.astype(np.int64)
            ends = np.concatenate(([0], np.cumsum(np.diff(at) > 0))) * BANDS
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(keys.reshape(-1)))
            sketch: list = [None] * batch.num_rows
            for i, row in zip(full.tolist(), low, strict=True):
                sketch[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("print"), pa.array(sums[0]), pa.array(sums[1]), lists, pa.array(sketch, pa.binary())], [x.split()[0] for x in SKETCH.split(", ")])

    return run


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of n MinHash values that may agree: with a uniform prior, P(similarity >= threshold | m of n agree) = P(Binomial(n + 1, threshold) <= m)."""
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if below >= tolerance:
            return m
    return n


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, step: int = 16) -> np.ndarray:
    """Which rows of two signature tables incremental comparison doesn't drop."""
    at, m = np.arange(len(b)), np.zeros(len(b), np.int64)
    for lo in range(0, b.shape[1], step):
        m = m + (a[at, lo : lo + step] == b[at, lo : lo + step]).sum(axis=1)
        stay = m >= least_matches(lo + step, threshold, tolerance)
        at, m = at[stay], m[stay]
    out = np.zeros(len(b), bool)
    out[at] = True
    return out


def _candidates(threshold: float, tolerance: float):  # noqa: ANN202
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        nodes, sig = table["node"].to_numpy(), np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(-1, VALUES)
        return connected(nodes, starts, lambda i, j: surviving(sig[i], sig[j], threshold, tolerance))

    return work


def shared(values: np.ndarray, rows: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """(left, right) table of how many values two sets have in common, by products of incidence matrices of a few thousand values."""
    _, code, counts = np.unique(values, return_inverse=True, return_counts=True)
    keep = counts[code] > 1
    code, rows = np.unique(code[keep], return_inverse=True)[1], rows[keep]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(code, kind="stable")
    code, rows, width = code[order], rows[order], 4096
    for lo in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        at = slice(*np.searchsorted(code, (lo, lo + width)))
        table = np.zeros((n, width), np.float32)
        table[rows[at], code[at] - lo] = 1
        out += table[left] @ table[right].T
    return out.astype(np.int64)


def _verifier(k: int, threshold: float):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        ids, weight, second = table["id"].to_numpy(), table["n_docs"].to_numpy(), table["second"].to_numpy()
        values, at = shingle_sets(table["text"].combine_chunks(), k)
        size, rows = np.diff(at), np.repeat(np.arange(len(ids)), np.diff(at))
        same = table["bi"][0].as_py() == table["bj"][0].as_py()
        left = np.flatnonzero(~second)
        right = left if same else np.flatnonzero(second)
        common = shared(values, rows, len(ids), left, right)
        i, j = np.nonzero(common >= threshold * (size[left][:, None] + size[right][None, :] - common) - 1e-9)
        i, j = (left[i], right[j]) if not same else (left[i[i < j]], right[j[i < j]])
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        own = np.flatnonzero(links)
        member, root = forest(ids[i], ids[j])
        mask = np.arange(len(own) + len(member)) < len(own)
        return pa.table({"id": np.concatenate((ids[own], member)), "n": np.concatenate((links[own], np.zeros(len(member), np.int64))), "root": pa.array(np.concatenate((np.zeros(len(own), np.int64), root)), mask=mask)})

    return run


def joined(documents: DataFrame, k: int = 5, threshold: float = 0.8, tolerance: float = 1e-6, block: int = 256) -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept) per row.

    class_id: the least id with the same shingle set; n_links: other documents of similarity `threshold` or more; component_id: the
    least id that links reach; kept: whether that is the document itself.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("print", F.xxhash64("text"))
    with arrow_rows(documents.sparkSession, 2000):
        sketches = written(texts.mapInArrow(_sketches(k), SKETCH), "sketches")
    usable = sketches.where("doc_id IS NOT NULL AND size(keys) > 0")
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "print")).alias("least"), F.count("*").alias("n_docs"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    # a class is a node of its own: an id may stand for several
    node = F.xxhash64("h1", "h2").alias("node")
    classes = written(classes.select("h1", "h2", node, F.col("least.doc_id").alias("rep"), F.col("least.print").alias("rep_print"), "n_docs", "keys", "sketch"), "classes")
    groups = components(keyed_candidates(classes, _candidates(threshold, tolerance), MET), "id", "root")
    reps = groups.join(classes.select("node", "rep", "rep_print", "n_docs"), F.col("id") == F.col("node")).drop("node")
    members = texts.join(reps, (F.col("doc_id") == F.col("rep")) & (F.col("print") == F.col("rep_print"))).groupBy("id", "component", "n_docs").agg(F.min("text").alias("text"))
    dealt = paired_blocks(members, ["component"], "id", block, F.octet_length("text"), BLOCK_BYTES)
    found = written(dealt.groupBy("component", "bi", "bj").applyInArrow(_verifier(k, threshold), "id long, n long, root long"), "links")
    counts = found.where("root IS NULL").groupBy("id").agg(F.sum("n").alias("n"))
    by_id = usable.select("doc_id", node)
    several = by_id.groupBy("doc_id").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root <> last").drop("last")
    reach = components(found.where("root IS NOT NULL").select("id", "root").union(by_id.join(several, "doc_id").select("node", "root")), "id", "root")
    least = reach.join(classes.select("node", "rep"), F.col("id") == F.col("node")).groupBy("component").agg(F.min("rep").alias("component_id"))
    own = classes.select("h1", "h2", "node", F.col("rep").alias("class_id"), "n_docs").join(counts, F.col("node") == F.col("id"), "left").drop("id")
    own = own.join(reach.join(least, "component"), F.col("node") == F.col("id"), "left").drop("id", "node", "component")
    rows = sketches.withColumn("usable", F.expr("doc_id IS NOT NULL AND size(keys) > 0")).drop("keys", "print", "sketch")
    out = rows.join(own, (rows["h1"] == own["h1"]) & (rows["h2"] == own["h2"]) & rows["usable"], "left")
    class_id = F.coalesce("class_id", "doc_id")
    out = out.select("doc_id", class_id.alias("class_id"), F.coalesce(F.col("n_docs") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", class_id).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
