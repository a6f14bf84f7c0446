"""Symbols, imports and call sites of Python files, by the language's own parser, a batch of files at a time."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "path string, item string, fqn string, target string, start_line int, end_line int, cyclomatic int, cognitive int"
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.IfExp, ast.Match)
_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Lambda)


def complexity(function: ast.AST) -> tuple[int, int]:
    """Cyclomatic: 1 + branches + further operands of and/or; cognitive: each branch counts 1 and its depth. Nested functions are their own."""
    cyclomatic, cognitive = 1, 0
    stack = [(child, 0) for child in ast.iter_child_nodes(function)]
    while stack:
        node, depth = stack.pop()
        if isinstance(node, _SCOPES):
            continue
        if isinstance(node, _BRANCHES):
            cyclomatic += 1
        if isinstance(node, ast.BoolOp):
            cyclomatic += len(node.values) - 1
            cognitive += 1
        deeper = isinstance(node, _NESTING)
        if deeper:
            cognitive += 1 + depth
        stack += [(child, depth + deeper) for child in ast.iter_child_nodes(node)]
    return cyclomatic, cognitive


def items(path: str, text: str | None) -> list[tuple]:
    """Rows of SCHEMA for one file; a file that does not parse gives one row 'broken'."""
    module = path.rsplit("/", 1)[-1].removesuffix(".py")
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return [(path, "broken", module, None, None, None, None, None)]
    out: list[tuple] = []
    stack: list[tuple[ast.AST, str]] = [(tree, module)]
    while stack:
        node, scope = stack.pop()
        for child in ast.iter_child_nodes(node):
            inner = scope
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                inner = f"{scope}::{child.name}"
                out.append((path, "Function", inner, None, child.lineno, child.end_lineno, *complexity(child)))
            elif isinstance(child, ast.ClassDef):
                inner = f"{scope}::{child.name}"
                out.append((path, "Struct", inner, None, child.lineno, child.end_lineno, None, None))
            elif isinstance(child, ast.Import):
                out += [(path, "Import", scope, a.name, child.lineno, child.end_lineno, None, None) for a in child.names]
            elif isinstance(child, ast.ImportFrom):
                out += [(path, "Import", scope, f"{'.' * child.level}{child.module or ''}.{a.name}".lstrip() if child.level else f"{child.module}.{a.name}", child.lineno, child.end_lineno, None, None) for a in child.names]
            elif isinstance(child, ast.Call):
                out.append((path, "CallSite", scope, ast.unparse(child.func), child.lineno, child.end_lineno, None, None))
            stack.append((child, inner))
    return out


def python_items(files: DataFrame) -> DataFrame:
    """The items of all rows of files(path, content)."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for df in batches:
            rows = [r for p, t in zip(df["path"], df["content"]) for r in items(p, t)]
            out = pd.DataFrame(rows, columns=columns)
            for c in columns[4:]:
                out[c] = out[c].astype("Int32")
            yield out

    return files.select("path", "content").mapInPandas(parse, SCHEMA)
