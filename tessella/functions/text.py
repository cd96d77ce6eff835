"""Column expressions over text: folding, code-aware tokens, identities, token estimates, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code-v1 token pattern, its separators, and the bytes that count as a token.
WORD_CLASS = r"[\p{L}\p{N}_]"
TOKEN = WORD_CLASS + r"+(?:(?:::|[./:\\-])" + WORD_CLASS + r"+)*"
SEPARATORS = r"[_./:\\-]+"
BYTES_PER_TOKEN = 3


def fold(text: Column) -> Column:
    """Case folding: lower case, sharp s as ss."""
    return F.lower(F.regexp_replace(text, "[ßẞ]", "ss"))


def camel_parts(segment: Column) -> Column:
    """The parts of a segment between case changes and after acronyms."""
    spaced = F.regexp_replace(F.regexp_replace(segment, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.split(spaced, " ")


def match_tokens(match: Column) -> Column:
    """Distinct tokens of one match: itself, folded, and the parts of its segments, each folded too."""
    segments = F.filter(F.split(match, SEPARATORS), lambda s: s != "")
    parts = F.flatten(F.transform(segments, camel_parts))
    every = F.array_distinct(F.concat(F.array(match, fold(match)), F.flatten(F.transform(parts, lambda p: F.array(p, fold(p))))))
    return F.when(match.rlike("^[a-z0-9]+$"), F.array(match)).otherwise(every)  # most words of prose are their only token


def tokens(text: Column) -> Column:
    """All tokens of a text in order; a token repeats as often as matches give it."""
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(TOKEN), 0), match_tokens))


def length_prefixed(*parts: Column) -> Column:
    """Binary of the parts' UTF-8 bytes, each after its length in eight bytes."""
    return F.concat(*(F.concat(F.unhex(F.lpad(F.hex(F.octet_length(p)), 16, "0")), F.encode(p, "utf-8")) for p in parts))


def stable_id(prefix: str, *parts: Column) -> Column:
    """prefix:sha256 of the length-prefixed parts."""
    return F.concat(F.lit(f"{prefix}:"), F.sha2(length_prefixed(*parts), 256))


def token_estimate(text: Column) -> Column:
    """Bytes over three, rounded up."""
    return F.floor((F.octet_length(text) + (BYTES_PER_TOKEN - 1)) / BYTES_PER_TOKEN).cast("long")


def blank(text: Column) -> Column:
    """Whether a text holds white space only."""
    return ~text.rlike(r"(?U)\S")


def lines(text: Column) -> Column:
    """Lines without their ends; a last line that is empty isn't one."""
    parts = F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def glob_regex(pattern: str) -> str:
    """A shell pattern as an anchored regular expression; a star crosses slashes."""
    out = ""
    i = 0
    while i < len(pattern):
        c, i = pattern[i], i + 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + 1)) > 0:
            body, i = pattern[i:end], end + 1
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
        else:
            out += "\\" + c if not c.isalnum() else c
    return f"(?s)^{out}$"
