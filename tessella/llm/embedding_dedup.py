"""Near-duplicate embeddings by collision-counting projections.

Every vector is projected on many random directions. A pair collides on a direction if its projections lie within a query-centred window;
pairs with at least a calibrated number of collisions are candidates. Vectors meet where several projections fall into the same cells of
a table; the tables are as many as a pair at the threshold needs to meet in one with the wanted recall, and the cells of a table as many as leave a
vector of the largest label some MATES others to meet, so pairs that meet grow with the vectors. (One projection alone is no filter: at cosine 0.93
in 64 dimensions a window that holds 95 % of near pairs holds 40 % of all, wherever its sorted runs are cut.) Candidates connect vectors into
groups, and within a group, in blocks, the cosine of every pair is computed in double precision.

Equal vectors of a label are one class; only classes are compared. Nulls: vectors that are null, empty, zero or hold null or non-finite components,
null labels and null ids link with nothing. A row with a repeated id and the same vector counts once; an id with several vectors has the links
of all of them, counted by vector, and joins them into one component. Vectors of unlike lengths never link. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import connected, keyed_candidates, paired_blocks
from .common import forest, mix, written
from .graph import components

#: Width of a cell in deviations of a near pair's projections; vectors that a vector meets in a cell if all are random; vectors of a cell that are compared at once.
CELL, MATES, MET = 6.0, 32, 4096
#: Steps of a quantised projection in a window.
STEPS = 16
CLASSES = "node long, keys array<long>, sketch binary"


def least_collisions(projections: int, z: float, recall: float) -> int:
    """The largest count that a pair at the threshold reaches with probability `recall` or more; a window of z deviations collides with probability erf(z / sqrt 2)."""
    p, below = math.erf(z / math.sqrt(2)), 0.0
    for t in range(projections + 1):
        below += math.comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if 1 - below < recall:
            return t
    return projections


def same_cell(width: float) -> float:
    """How likely two values fall into one cell, at random offset, whose difference is normal; width: of the cell, in deviations of the difference."""
    return math.erf(width / math.sqrt(2)) - math.sqrt(2 / math.pi) / width * (1 - math.exp(-width * width / 2))


def layout(most: int, gap: float, recall: float) -> tuple[int, int]:
    """(tables, projections of a table) for labels of `most` vectors."""
    near, other = same_cell(CELL), same_cell(CELL * gap / math.sqrt(2))
    each = max(1, math.ceil(math.log(max(most, MATES) / MATES) / -math.log(other)))
    return math.ceil(math.log(1 - recall) / math.log(1 - near**each)), each


def directions(dimensions: int, projections: int, seed: int) -> np.ndarray:
    """Unit vectors, one a column."""
    r = np.random.default_rng(seed).normal(size=(dimensions, projections))
    return r / np.linalg.norm(r, axis=0)


def _sketches(gap: float, window: float, projections: int, tables: int, each: int, seed: int):  # noqa: ANN202
    def run(batches):  # noqa: ANN001, ANN202
        for b in batches:
            vectors, salt = b.column("embedding"), b.column("salt").to_numpy().view(np.uint64)
            n = np.diff(vectors.offsets.to_numpy())
            flat, at = vectors.flatten().to_numpy(), np.concatenate(([0], np.cumsum(n)))
            keys, sketch = np.zeros((b.num_rows, tables), np.uint64), [b""] * b.num_rows
            for d in np.unique(n):
                own = np.flatnonzero(n == d)
                x = flat[at[own][:, None] + np.arange(d)]
                x /= np.linalg.norm(x, axis=1)[:, None]
                x *= math.sqrt(d) / gap  # now a near pair's projections differ by a deviation of 1
                for i, row in zip(own.tolist(), np.clip(np.rint(x @ directions(d, projections, seed) * (STEPS / window)), -127, 127).astype(np.int8), strict=True):
                    sketch[i] = row.tobytes()
                offsets = np.random.default_rng(seed + 1).random(tables * each)
                cells = np.floor(x @ directions(d, tables * each, seed + 2) / CELL + offsets).astype(np.int64).astype(np.uint64).reshape(len(own), tables, each)
                h = salt[own][:, None] + mix(np.arange(tables, dtype=np.uint64) + np.uint64(int(d) << 32))[None, :]
                with np.errstate(over="ignore"):
                    for k in range(each):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + cells[:, :, k])
                keys[own] = h
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * tables), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists, pa.array(sketch, pa.binary())], ["node", "keys", "sketch"])

    return run


def _candidates(projections: int, least: int):  # noqa: ANN202
    def work(table: pa.Table, starts: np.ndarray) -> pa.Table:
        p = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.int8).reshape(-1, projections).astype(np.int16)

        def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            half = projections // 2
            n = (np.abs(p[i, :half] - p[j, :half]) <= STEPS + 1).sum(axis=1)
            out = n >= least - (projections - half)
            own = np.flatnonzero(out)
            out[own] = n[own] + (np.abs(p[i[own], half:] - p[j[own], half:]) <= STEPS + 1).sum(axis=1) >= least
            return out

        return connected(table["node"].to_numpy(), starts, near)

    return work


def _verifier(cosine: float):  # noqa: ANN202
    def run(table: pa.Table) -> pa.Table:
        ids, weight, second = table["id"].to_numpy(), table["n"].to_numpy(), table["second"].to_numpy()
        x = table["embedding"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        x = x / np.linalg.norm(x, axis=1)[:, None]
        same = table["bi"][0].as_py() == table["bj"][0].as_py()
        left = np.flatnonzero(~second)
        right = left if same else np.flatnonzero(second)
        i, j = np.nonzero(x[left] @ x[right].T >= cosine - 1e-9)
        i, j = (left[i], right[j]) if not same else (left[i[i < j]], right[j[i < j]])
        near = np.einsum("ij,ij->i", x[i], x[j]) >= cosine
        i, j = i[near], j[near]
        links = np.zeros(len(ids), np.int64)
        np.add.at(links, i, weight[j])
        np.add.at(links, j, weight[i])
        own = np.flatnonzero(links)
        member, root = forest(ids[i], ids[j])
        mask = np.arange(len(own) + len(member)) < len(own)
        return pa.table({"id": np.concatenate((ids[own], member)), "n": np.concatenate((links[own], np.zeros(len(member), np.int64))), "root": pa.array(np.concatenate((np.zeros(len(own), np.int64), root)), mask=mask)})

    return run


def classes_of(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of sound rows, each once; (node, salt, d, embedding, rep, n) per label and vector: a hash of the label, the least id, the number of ids."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    sound = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").where(~F.exists("embedding", lambda x: x.isNull()))
    peak = F.array_max(F.transform("embedding", F.abs))  # NaN is the largest
    sound = sound.withColumn("peak", peak).where((F.col("peak") > 0) & (F.col("peak") < float("inf")))
    fit = F.when(F.col("peak").between(1e-100, 1e100), F.col("embedding")).otherwise(F.transform("embedding", lambda x: x / F.col("peak")))  # squares stay finite
    sound = sound.select("vec_id", "label", fit.alias("embedding")).withColumn("salt", F.xxhash64("label", F.size("embedding"))).withColumn("h", F.xxhash64("embedding", "label"))
    sound = sound.withColumn("node", F.xxhash64("h", "label", "embedding"))
    ids = written(sound.select("vec_id", "node").distinct(), "vector-ids")
    counts = ids.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"))
    vectors = sound.groupBy("node").agg(F.first("salt").alias("salt"), F.first("embedding").alias("embedding"))
    return ids, written(vectors.join(counts, "node").withColumn("d", F.size("embedding")), "vector-classes")


def linked(classes: DataFrame, cosine: float = 0.93, projections: int = 48, z: float = 2.0, recall: float = 0.9999, meeting: float = 0.999, block: int = 1024, seed: int = 11) -> DataFrame:
    """(id, n, root): link counts of classes (root null), and pairs (id, root) that connect what the links connect (n 0).

    recall: of the collision count; meeting: of the tables, both for a pair at the threshold.
    """
    gap = math.sqrt(2 - 2 * cosine)
    most = classes.groupBy("salt").count().agg(F.max("count")).first()[0] or 0
    tables, each = layout(most, gap, meeting)
    sketched = written(classes.select("node", "salt", "embedding").mapInArrow(_sketches(gap, z, projections, tables, each, seed), CLASSES), "vector-sketches")
    groups = components(keyed_candidates(sketched, _candidates(projections, least_collisions(projections, z, recall)), MET), "id", "root")
    members = classes.join(groups, F.col("node") == F.col("id")).select("id", "component", "d", "embedding", "n")
    return paired_blocks(members, ["component", "d"], "id", block).groupBy("component", "d", "bi", "bj").applyInArrow(_verifier(cosine), "id long, n long, root long")


def deduplicated(embeddings: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """(vec_id, n_links, component_id, kept) per row: links of at least the cosine within a label, and the least id that they reach."""
    ids, classes = classes_of(embeddings)
    found = written(linked(classes, **options), "vector-links")
    counts = found.where("root IS NULL").groupBy("id").agg(F.sum("n").alias("links"))
    several = ids.groupBy("vec_id").agg(F.min("node").alias("root"), F.max("node").alias("last")).where("root <> last").drop("last")
    reach = components(found.where("root IS NOT NULL").select("id", "root").union(ids.join(several, "vec_id").select("node", "root")), "id", "root")
    least = reach.join(classes.select("node", "rep"), F.col("id") == F.col("node")).groupBy("component").agg(F.min("rep").alias("component_id"))
    own = classes.select("node", "rep", "n").join(counts, F.col("node") == F.col("id"), "left").drop("id").join(reach.join(least, "component"), F.col("node") == F.col("id"), "left")
    own = own.select(F.col("node").alias("of"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component_id", "rep").alias("component_id"))
    by_id = ids.join(own, F.col("node") == F.col("of")).groupBy(F.col("vec_id").alias("of_id")).agg(F.sum("links").alias("n_links"), F.min("component_id").alias("component_id"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = rows.join(by_id, F.col("vec_id") == F.col("of_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
