"""Pages over evidence: relevant files, mandatory coverage, staleness, assembly, template composition."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.markdown import anchor, link_text

#: The legal steps of a page's state.
STEPS = (("pending", "evidence_ready"), ("pending", "failed"), ("evidence_ready", "generated"), ("evidence_ready", "failed"), ("evidence_ready", "evidence_ready"), ("failed", "evidence_ready"), ("generated", "evidence_ready"))


def relevant(subjects: DataFrame, subject: str, candidates: DataFrame, candidate: str) -> DataFrame:
    """(subject, candidate, shared): for each subject the candidate that shares most distinct terms, ties by candidate. Both sides are (id, term)."""
    shared = candidates.select(candidate, "term").distinct().join(subjects.select(subject, "term").distinct(), "term").groupBy(subject, candidate).agg(F.count("*").alias("shared"))
    rank = F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("shared"), candidate))
    return shared.withColumn("_r", rank).where("_r = 1").drop("_r")


def covered(required: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(subsection, path, key, source): for each required (subsection, path) its best hit (path, key, rank), else the path's first chunk (path, key, start_line), else none."""
    best = hits.groupBy("path").agg(F.min_by("key", "rank").alias("hit"))
    first = chunks.groupBy("path").agg(F.min_by("key", F.struct("start_line", "key")).alias("chunk"))
    met = required.join(best, "path", "left").join(first, "path", "left")
    return met.select("subsection", "path", F.coalesce("hit", "chunk").alias("key"), F.when(F.col("hit").isNotNull(), "ranked").when(F.col("chunk").isNotNull(), "fallback").otherwise("missing").alias("source"))


def reset_stale(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """Pages (page, state) with stale evidence (page, stale) back to pending."""
    stale = evidence.where("stale").select("page").distinct().withColumn("_stale", F.lit(True))
    return pages.join(stale, "page", "left").withColumn("state", F.when(F.col("_stale"), "pending").otherwise(F.col("state"))).drop("_stale")


def unowned_citations(claims: DataFrame, permitted: DataFrame) -> DataFrame:
    """Citations (page, evidence) that the page's evidence doesn't hold."""
    return claims.join(permitted, ["page", "evidence"], "left_anti")


def assembled(sections: DataFrame) -> DataFrame:
    """(document, markdown) from sections (document, position, page, title, body): a table of contents with stable anchors, then the sections in order."""
    place = anchor("page", F.col("page"))
    entry = F.concat(F.lit("- ["), link_text(F.col("title")), F.lit("](#"), place, F.lit(")"))
    body = F.concat(F.lit('<a id="'), place, F.lit('"></a>\n\n## '), link_text(F.col("title")), F.lit("\n\n"), F.rtrim("body"))
    rows = sections.select("document", F.struct("position", "page", entry.alias("entry"), body.alias("body")).alias("s")).groupBy("document").agg(F.array_sort(F.collect_list("s")).alias("s"))
    joined = lambda field, by: F.array_join(F.transform("s", lambda x: x[field]), by)
    return rows.select("document", F.concat(joined("entry", "\n"), F.lit("\n\n"), joined("body", "\n\n"), F.lit("\n")).alias("markdown"))


@dataclass(frozen=True)
class Node:
    """A template node with its children in order."""

    id: str
    children: tuple[Node, ...] = ()


@dataclass(frozen=True)
class Operation:
    """insert_before, insert_after or append to a target node."""

    kind: str
    target: str
    node: Node


class CompositionError(ValueError):
    """Operations whose targets never come to exist, or depend on each other."""


def composed(roots: tuple[Node, ...], operations: tuple[Operation, ...]) -> tuple[Node, ...]:
    """Apply operations in order, those whose target another one brings after it; a small tree, built on the driver."""
    pending = list(operations)
    while pending:
        later = []
        for op in pending:
            done = _applied(roots, op)
            if done is None:
                later.append(op)
            else:
                roots = done
        if len(later) == len(pending):
            raise CompositionError(f"no target for {', '.join(sorted(op.target for op in later))}")
        pending = later
    return roots


def _applied(nodes: tuple[Node, ...], op: Operation) -> tuple[Node, ...] | None:
    for i, node in enumerate(nodes):
        if node.id == op.target:
            if op.kind == "append":
                return (*nodes[:i], replace(node, children=(*node.children, op.node)), *nodes[i + 1 :])
            at = i + (op.kind == "insert_after")
            return (*nodes[:at], op.node, *nodes[at:])
        if (below := _applied(node.children, op)) is not None:
            return (*nodes[:i], replace(node, children=below), *nodes[i + 1 :])
    return None
