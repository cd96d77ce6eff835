"""File scans: candidate filters, reading and classifying bytes, languages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.text import glob_regex

MOST_BYTES = 1_000_000
#: Directories that a scan leaves out unless asked for.
EXCLUDED = (".git", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".tessella", ".tox", ".venv", "__pycache__", "build", "dist", "node_modules", "vendor", "venv")
#: Languages by suffix, by file name.
SUFFIXES = {
    "bash": "shell",
    "c": "c",
    "cc": "cpp",
    "cpp": "cpp",
    "css": "css",
    "go": "go",
    "h": "c",
    "hpp": "cpp",
    "html": "html",
    "java": "java",
    "js": "javascript",
    "json": "json",
    "jsonl": "json",
    "jsx": "jsx",
    "md": "markdown",
    "mdx": "markdown",
    "py": "python",
    "pyi": "python",
    "rs": "rust",
    "sh": "shell",
    "sql": "sql",
    "toml": "toml",
    "ts": "typescript",
    "tsx": "tsx",
    "txt": "text",
    "yaml": "yaml",
    "yml": "yaml",
    "zsh": "shell",
}
NAMES = {"dockerfile": "dockerfile", "gemfile": "ruby", "makefile": "makefile"}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def language_of(path: Column) -> Column:
    """Language by file name, then by suffix, else unknown; in lower case."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    suffix = F.regexp_extract(name, r"\.([^./]*)$", 1)
    return F.coalesce(_lookup(NAMES)[name], _lookup(SUFFIXES)[suffix], F.lit("unknown"))


def excluded_directory(path: Column, names: Sequence[str] = EXCLUDED) -> Column:
    """Whether a directory of the path is one of the names."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda p: p.isin(*names))


def selected(path: Column, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> Column:
    """Whether a path matches any include pattern (none: all) and no exclude pattern."""
    matches = lambda ps: F.coalesce(*(F.nullif(path.rlike(glob_regex(p)), F.lit(False)) for p in ps), F.lit(False))
    return (matches(include) if include else F.lit(True)) & ~(matches(exclude) if exclude else F.lit(False))


def classified(files: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """files (content binary) with size_bytes, content_hash, status, skip_reason and text: unreadable, too large, binary (holds NUL), invalid encoding, else read."""
    size, content = F.octet_length("content"), F.col("content")
    as_text = F.decode(content, "utf-8")
    reason = F.when(content.isNull(), "unreadable").when(size > most_bytes, "too_large").when(F.expr("position(x'00' in content) > 0"), "binary").when(~F.is_valid_utf8(content.cast("string")), "invalid_encoding")
    out = files.withColumn("size_bytes", F.coalesce(size, F.lit(0))).withColumn("content_hash", F.sha2(content, 256)).withColumn("skip_reason", reason)
    return out.withColumn("status", F.when(F.col("skip_reason").isNull(), "read").otherwise("skipped")).withColumn("text", F.when(F.col("skip_reason").isNull(), F.regexp_replace(as_text, "^﻿", ""))).drop("content")


def scan(spark: SparkSession, root: str, include: Sequence[str] = (), exclude: Sequence[str] = (), most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files below a folder of any store: path relative to it, language, and what `classified` tells. Filters come before
    contents are read; an excluded directory is scanned if an include pattern names it. Spark's reader leaves out files of no bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    base = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    relative = F.substring("path", F.lit(len(base) + 2), F.length("path"))
    kept = rows.select(relative.alias("path"), "content").where(selected(F.col("path"), include, exclude))
    named = {part for pattern in include for part in pattern.split("/")}
    kept = kept.where(~excluded_directory(F.col("path"), [d for d in EXCLUDED if d not in named]))
    return classified(kept, most_bytes).withColumn("language", language_of(F.col("path")))
