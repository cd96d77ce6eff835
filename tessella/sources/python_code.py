"""Symbols and relationships of Python sources, parsed where the rows are."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Confidence of an edge to a definition of the same file, and of one to a name that is only referred to.
DEFINED, REFERRED = 1.0, 0.75
FACTS = "path string, fact string, kind string, name string, qualified string, target string, start_line int, end_line int, confidence double, message string"


def module_name(path: str) -> str:
    """Dotted name of a module's path; a package's own file stands for the package."""
    stem = path.removesuffix(".py").removesuffix("/__init__")
    return stem.replace("/", ".")


def dotted(node: ast.AST) -> str | None:
    """a.b.c of a name or attribute chain, else nothing."""
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class _Facts:
    """One walk collects definitions with their scopes, a second one the edges, when all definitions are known."""

    def __init__(self, path: str, tree: ast.Module, lines: int):
        self.path, self.module, self.out = path, module_name(path), []
        self.defined: dict[str, int] = {self.module: 1}
        self.short: dict[str, list[str]] = {}
        self.out.append((path, "symbol", "module", self.module.rpartition(".")[2], self.module, None, 1, max(1, lines), None, None))
        self._define(tree, self.module, in_class=False)
        self._edges(tree, [self.module], {})

    def _define(self, node: ast.AST, scope: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{scope}.{child.name}"
                start = min([child.lineno, *(d.lineno for d in child.decorator_list)])
                kind = "class" if is_class else "method" if in_class else "function"
                self.defined[name] = start
                self.short.setdefault(child.name, []).append(name)
                self.out.append((self.path, "symbol", kind, child.name, name, None, start, child.end_lineno, None, None))
                self._edge("contains", scope, name, start, child.end_lineno, DEFINED)
                self._define(child, name, is_class)
            else:
                self._define(child, scope, in_class)

    def _edge(self, kind: str, source: str, target: str, start: int, end: int | None, confidence: float) -> None:
        self.out.append((self.path, "edge", kind, target.rpartition(".")[2], source, target, start, end or start, confidence, None))

    def _resolve(self, name: str, scopes: list[str], aliases: dict[str, str]) -> tuple[str, float]:
        head, _, rest = name.partition(".")
        name = ".".join(x for x in (aliases.get(head, head), rest) if x)
        if name in self.defined:
            return name, DEFINED
        for scope in reversed(scopes):
            if f"{scope}.{name}" in self.defined:
                return f"{scope}.{name}", DEFINED
        if len(own := self.short.get(name, [])) == 1:
            return own[0], DEFINED
        return name, REFERRED

    def _edges(self, node: ast.AST, scopes: list[str], aliases: dict[str, str]) -> None:
        for child in ast.iter_child_nodes(node):
            at = scopes[-1]
            if isinstance(child, ast.Import):
                for a in child.names:
                    aliases[a.asname or a.name.partition(".")[0]] = a.name if a.asname else a.name.partition(".")[0]
                    self._edge("imports", at, *((t := self._resolve(a.name, scopes, {}))[:1]), child.lineno, child.end_lineno, t[1])
            elif isinstance(child, ast.ImportFrom):
                package = self.module if self.path.endswith("__init__.py") else self.module.rpartition(".")[0]
                for _ in range(max(0, child.level - 1)):
                    package = package.rpartition(".")[0]
                base = ".".join(x for x in (package if child.level else "", child.module or "") if x)
                for a in child.names:
                    full = ".".join(x for x in (base, a.name if a.name != "*" else "") if x)
                    aliases[a.asname or a.name] = full
                    target, confidence = self._resolve(full, scopes, {})
                    self._edge("imports", at, target, child.lineno, child.end_lineno, confidence)
            elif isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                for base_ in getattr(child, "bases", ()):
                    if name := dotted(base_):
                        self._edge("inherits", f"{at}.{child.name}", *((t := self._resolve(name, scopes, aliases))[:1]), base_.lineno, base_.end_lineno, t[1])
                self._edges(child, [*scopes, f"{at}.{child.name}"], dict(aliases))
            else:
                if isinstance(child, ast.Call) and (name := dotted(child.func)):
                    self._edge("calls", at, *((t := self._resolve(name, scopes, aliases))[:1]), child.lineno, child.end_lineno, t[1])
                self._edges(child, scopes, aliases)


def facts(files: DataFrame) -> DataFrame:
    """Rows of FACTS for files (path, text): fact is symbol, edge (qualified to target) or diagnostic (a syntax error; such a file is a text only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in FACTS.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int32()] * 2 + [pa.float64(), pa.string()]
        for batch in batches:
            out: list[tuple] = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    out += _Facts(path, ast.parse(text or ""), (text or "").count("\n") + 1).out
                except (SyntaxError, ValueError, RecursionError) as e:
                    out.append((path, "diagnostic", "python_syntax_error", None, None, None, getattr(e, "lineno", None), None, None, type(e).__name__))
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return files.select("path", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, FACTS)
