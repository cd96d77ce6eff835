"""Results as JSON envelopes and Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.markdown import source_link

SCHEMA_VERSION = "1"


def envelope(rows: DataFrame, command: str, order: list[str], warnings: tuple[str, ...] = ()) -> DataFrame:
    """(document): one JSON document of schema version, command, rows in order and warnings. For results that a view has bounded."""
    listed = F.array_sort(F.collect_list(F.struct(*order, *[c for c in rows.columns if c not in order])))
    return rows.agg(F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(command).alias("command"), listed.alias("result"), F.array(*map(F.lit, warnings)).cast("array<string>").alias("warnings"))).alias("document"))


def hit_markdown(path: Column, start: Column, end: Column, text: Column) -> Column:
    """A hit: its source link and its text in a fence longer than any inside."""
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0)) + 1))
    return F.concat(source_link(path, start, end), F.lit("\n\n"), fence, F.lit("\n"), text, F.lit("\n"), fence, F.lit("\n"))
