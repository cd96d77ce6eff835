"""Chat formatting: a finite-state machine over roles and a declarative template.

Rows stream through in turn order, so a conversation of any length needs the memory of one Arrow batch.
Nulls: a null text or role counts as empty, a null turn sorts first, null conversation ids form one conversation.
Ties in turn are ordered by role, then text; repeated rows are turns of their own; an empty table gives no rows.
Other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around each turn, the roles' legal order, and the roles that are trained on.

    open and close: control strings before and after a text. Roles that are not listed get `other`, with the role's name between its
    first two strings. No control string may hold a backslash or be part of another.
    """

    begin: str = "<s>"
    open: dict = field(default_factory=lambda: {"system": "[SYS]", "user": "[INST]", "assistant": "[ANSWER]"})
    close: dict = field(default_factory=lambda: {"system": "[/SYS]", "user": "[/INST]", "assistant": "</s>"})
    other: tuple = ("[ROLE]", "[TEXT]", "[/ROLE]")
    after: dict = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple = ("user", "assistant")
    loss: tuple = ("assistant",)

    def controls(self) -> list[str]:
        return sorted({self.begin, *self.open.values(), *self.close.values(), *self.other}, key=len, reverse=True)

    def pattern(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, self.controls())))


def escape(text: str, pattern: re.Pattern) -> str:
    """Double backslashes and break every control string by a backslash after its first character."""
    return pattern.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


SEGMENTS = "conv_id long, turn_no long, segment string, loss boolean, legal boolean"


def segments(conversations: DataFrame, template: Template | None = None) -> DataFrame:
    """(conv_id, turn_no, segment, loss, legal) rows in output order within each partition; a conversation lies in one partition.

    The segments of a conversation joined are its formatted text. legal: the machine has accepted every turn so far. Turn 0 is the
    beginning mark; each turn gives its opening mark, escaped text and closing mark. A conversation whose last turn may not end it
    gets an empty closing segment that is not legal.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, started, conv, state, legal, turn = template.pattern(), False, None, "", True, 0
        for batch in batches:
            out: list[tuple] = []
            for c, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                role, text = role or "", text or ""
                if not started or c != conv:
                    if started and state not in template.final:
                        out.append((conv, turn, "", False, False))
                    started, conv, state, legal, turn = True, c, "", True, 0
                    out.append((conv, 0, template.begin, False, True))
                turn += 1
                legal, state = legal and role in template.after.get(state, ()), role
                if role in template.open:
                    opening, closing = [template.open[role]], template.close[role]
                else:
                    opening, closing = [template.other[0], escape(role, pattern), template.other[1]], template.other[2]
                out += [(conv, turn, x, False, legal) for x in opening]
                out.append((conv, turn, escape(text, pattern), role in template.loss, legal))
                out.append((conv, turn, closing, False, legal))
            yield _batch(out)
        if started and state not in template.final:
            yield _batch([(conv, turn, "", False, False)])

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "turn_no", "segment", "loss", "legal"])


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, legal boolean"


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Parse formatted segments again and digest each conversation: its turns, the text under the loss mask, its length.

    Only the control strings tell turns apart: a segment that equals one is a mark, for no escaped text holds one.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles, marks, state, conv = {v: k for k, v in template.open.items()}, {*template.controls()}, None, None
        for batch in batches:
            out: list[tuple] = []
            for c, segment, loss, legal in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if segment == template.begin:
                    if state is not None:
                        out.append(state.row(conv))
                    conv, state = c, _Reader(template)
                state.read(segment, loss, legal, roles, marks)
            yield _digests(out)
        if state is not None:
            yield _digests([state.row(conv)])

    return formatted.mapInArrow(run, DIGESTS)


class _Reader:
    def __init__(self, template: Template):
        self.t, self.turns, self.loss = template, hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0
        self.role, self.naming, self.legal, self.inside = "", False, True, False

    def read(self, segment: str, loss: bool, legal: bool, roles: dict, marks: set) -> None:
        self.chars += len(segment)
        self.legal &= legal
        if segment in marks:
            if segment in roles:
                self.role, self.inside = roles[segment], True
            elif segment == self.t.other[0]:
                self.naming = True
            elif segment == self.t.other[1]:
                self.naming, self.inside = False, True
            elif segment != self.t.begin:
                self.n, self.inside = self.n + 1, False
        elif self.naming:
            self.role = unescape(segment)
        elif self.inside:
            text = unescape(segment)
            self.turns.update(f"{self.role}\n{text}\n".encode())
            if loss:
                self.loss.update(text.encode())
                self.loss_chars += len(text)

    def row(self, conv: int | None) -> tuple:
        return (conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.legal)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "legal"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
