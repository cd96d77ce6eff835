"""Markdown assembly and checks, relative imports, nested keys of manifests."""

from __future__ import annotations

import hashlib
import json
import re
import tomllib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def anchor(kind: str, *identifier: Column) -> Column:
    """A stable anchor: the kind and the sha256 of the identifiers, NUL between them."""
    return F.concat(F.lit(f"{kind}-"), F.sha2(F.encode(F.concat_ws("\0", *identifier), "utf-8"), 256))


def link_text(text: Column) -> Column:
    """Text with the characters that would end or nest a link escaped."""
    return F.regexp_replace(text, r"([\\\[\]`*_<>])", r"\\$1")


def source_link(path: Column, start: Column, end: Column) -> Column:
    """A link to a range of lines of a file."""
    place = F.concat(path, F.lit("#L"), start.cast("string"), F.when(end != start, F.concat(F.lit("-L"), end.cast("string"))).otherwise(""))
    quoted = F.regexp_replace(F.url_encode(place), "%2F", "/")
    return F.concat(F.lit("["), link_text(F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))), F.lit("]("), F.regexp_replace(F.regexp_replace(quoted, r"\+", "%20"), "%23", "#"), F.lit(")"))


def fragment_fault(markdown: Column) -> Column:
    """Why a generated fragment can't be used, or null: NUL, headings above the fifth level, raw HTML outside code."""
    plain = F.regexp_replace(F.regexp_replace(markdown, "(?s)```.*?```", ""), "`[^`\n]*`", "")
    return F.when(F.instr(markdown, "\0") > 0, "nul").when(plain.rlike(r"(?m)^ {0,3}#{1,4}([ \t]|$)"), "heading").when(plain.rlike(r"(?m)^.+\n {0,3}(=+|-+)[ \t]*$"), "heading").when(plain.rlike(r"</?[A-Za-z][^>]*>|<!--"), "html")


def relative_import(package: Column, dots: Column, name: Column) -> Column:
    """The module that a relative import names: one dot is the package itself, each more climbs one."""
    parts = F.split(package, r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0)))
    return F.array_join(F.filter(F.concat(base, F.array(name)), lambda p: p != ""), ".")


class DuplicateKeyError(ValueError):
    """A JSON object names a key twice."""


def strict_json(text: str) -> object:
    """JSON without repeated keys, NaN or infinities."""

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            raise DuplicateKeyError("a key occurs twice")
        return dict(items)

    def constant(name: str) -> object:
        raise ValueError(f"{name} is not JSON")

    return json.loads(text, object_pairs_hook=pairs, parse_constant=constant)


@F.pandas_udf(StringType())
def manifest_value(path: pd.Series, text: pd.Series, key: pd.Series) -> pd.Series:
    """The JSON of a dotted key in a JSON or TOML manifest; null if it is missing or the file can't be read."""

    def one(p: str | None, t: str | None, k: str) -> str | None:
        try:
            value = tomllib.loads(t or "") if (p or "").endswith(".toml") else strict_json(t or "")
            for part in k.split("."):
                value = value[part]
            return json.dumps(value, sort_keys=True, default=str)
        except (ValueError, KeyError, TypeError):
            return None

    return pd.Series([one(*row) for row in zip(path, text, key, strict=True)])


def canonical_digest(value: object) -> str:
    """sha256 of canonical JSON: sorted keys, no spaces, no NaN."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def compiled(template: str, labels: dict[str, str]) -> str:
    """Placeholders {{name}} replaced by labels, comments and headings removed; an unknown name is an error."""
    text = re.sub(r"<!--.*?-->", "", template, flags=re.S)
    text = "\n".join(x for x in text.split("\n") if not re.match(r" {0,3}#{1,6}([ \t]|$)", x))
    return re.sub(r"\{\{([\w.-]+)\}\}", lambda m: labels[m[1]], text).strip()
