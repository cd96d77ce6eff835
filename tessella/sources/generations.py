"""Index generations: tables written to a folder of their own, published by replacing a pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class StaleIndexError(ValueError):
    """The sources have changed since the generation was built."""


class ConflictError(RuntimeError):
    """Another generation was published since the one that a writer started from."""


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file whole: a temporary one, renamed over the old."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, temporary = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    store = target.getFileSystem(conf)
    out = store.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf) if target.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, target, options)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], fingerprint: str, expected: str | None = None) -> str:
    """Write the tables as a new generation and point to it; until the pointer is replaced readers see the old one. The generation's id.

    expected: the build that must still be the published one ('' for none) when the pointer is replaced, else ConflictError; stores
    without locks leave a moment between the look and the rename, in which the later writer wins.
    """
    build = uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{root}/generations/{build}/{name}")
    if expected is not None and ((manifest(spark, root) or {}).get("build", "")) != expected:
        raise ConflictError(f"{root} has changed since {expected or 'it was empty'}")
    _put(spark, f"{root}/current.json", json.dumps({"build": build, "fingerprint": fingerprint, "tables": sorted(tables)}))
    return build


def manifest(spark: SparkSession, root: str) -> dict | None:
    """What is published, or nothing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/current.json")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return json.loads("".join(r.value for r in spark.read.text(f"{root}/current.json").collect()))


def load(spark: SparkSession, root: str, fingerprint: str | None = None) -> dict[str, DataFrame]:
    """The published tables; a fingerprint that differs from the current sources' raises StaleIndexError."""
    found = manifest(spark, root)
    if found is None:
        raise FileNotFoundError(f"nothing is published in {root}")
    if fingerprint is not None and fingerprint != found["fingerprint"]:
        raise StaleIndexError(f"{root} was built from other sources")
    return {t: spark.read.parquet(f"{root}/generations/{found['build']}/{t}") for t in found["tables"]}


def replaced(current: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """current with all rows of fresh's keys replaced by fresh's."""
    return current.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)
