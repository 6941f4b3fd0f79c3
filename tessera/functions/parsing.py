"""Python sources as relations of calls and def-use edges: the one place where parsing needs Python, in Arrow batches."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def _calls(path: str, text: str) -> Iterator[tuple[str, str, str, int]]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return

    def walk(node: ast.AST, scope: str) -> Iterator[tuple[str, str, str, int]]:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                yield from walk(child, f"{scope}.{child.name}".lstrip("."))
                continue
            if isinstance(child, ast.Call):
                yield path, scope, ast.unparse(child.func), child.lineno
            yield from walk(child, scope)

    yield from walk(tree, "")


def _def_use(path: str, text: str) -> Iterator[tuple[str, str, int, int]]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return
    names = sorted((n.lineno, isinstance(n.ctx, ast.Store), n.col_offset, n.id) for n in ast.walk(tree) if isinstance(n, ast.Name))
    last: dict[str, int] = {}
    for line, stores, _, name in names:  # of one line, uses come before the definition
        if stores:
            last[name] = line
        elif name in last:
            yield path, name, last[name], line


def _signatures(path: str, text: str) -> Iterator[tuple[str, str, int, list[str], str | None, list[str]]]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return
    for node in ast.walk(tree):
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            parameters = [a.arg + (f": {ast.unparse(a.annotation)}" if a.annotation else "") for a in node.args.args]
            yield path, node.name, node.lineno, parameters, ast.get_docstring(node), [ast.unparse(d) for d in node.decorator_list]


def _imports(path: str, text: str) -> Iterator[tuple[str, str, str, str | None, str, int, int]]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return
    known: dict[str, str] = {}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for a in node.names:
                yield path, a.name, a.name, a.asname, "aliased" if a.asname else "direct", 0, node.lineno
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                yield path, node.module or "", a.name, a.asname, "wildcard" if a.name == "*" else "relative" if node.level else "from", node.level, node.lineno
        elif isinstance(node, ast.Assign) and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
            known.update({t.id: node.value.value for t in node.targets if isinstance(t, ast.Name)})
    for node in ast.walk(tree):
        if isinstance(node, ast.Call) and ast.unparse(node.func) in ("importlib.import_module", "import_module", "__import__"):
            first = node.args[0] if node.args else None
            target = known.get(first.id) if isinstance(first, ast.Name) else first.value if isinstance(first, ast.Constant) else None
            if isinstance(target, str):
                yield path, target, target, None, "dynamic", 0, node.lineno
            else:
                yield path, "?", "?", None, "unknown", 0, node.lineno


def _symbols(path: str, text: str) -> Iterator[tuple[str, str, str, int, bool]]:
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return
    listed: set[str] | None = None
    found: dict[str, tuple[str, int]] = {}
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            found[node.name] = "function", node.lineno
        elif isinstance(node, ast.ClassDef):
            found[node.name] = "class", node.lineno
        elif isinstance(node, ast.Assign | ast.AnnAssign):
            for t in node.targets if isinstance(node, ast.Assign) else [node.target]:
                if isinstance(t, ast.Name):
                    found[t.id] = "variable", node.lineno
                    if t.id == "__all__" and isinstance(node.value, ast.List | ast.Tuple):
                        listed = {e.value for e in node.value.elts if isinstance(e, ast.Constant)}
    for name, (kind, line) in found.items():
        yield path, name, kind, line, name in listed if listed is not None else not name.startswith("_")


def _relation(files: DataFrame, fn, schema: str, columns: list[str]) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame([row for path, text in zip(f["path"], f["text"], strict=True) for row in fn(path, text)], columns=columns)

    return files.select("path", "text").mapInPandas(run, schema)


def python_calls(files: DataFrame) -> DataFrame:
    """path, caller (scope), callee and line of each call; sources that do not parse give none."""
    return _relation(files, _calls, "path string, caller string, callee string, line int", ["path", "caller", "callee", "line"])


def def_use_edges(files: DataFrame) -> DataFrame:
    """path, name, def_line, use_line of straight-line data dependencies."""
    return _relation(files, _def_use, "path string, name string, def_line int, use_line int", ["path", "name", "def_line", "use_line"])


def signatures(files: DataFrame) -> DataFrame:
    """path, name, line, parameters (with annotations), docstring and decorators of every function."""
    columns = ["path", "name", "line", "parameters", "docstring", "decorators"]
    return _relation(files, _signatures, "path string, name string, line int, parameters array<string>, docstring string, decorators array<string>", columns)


def imports(files: DataFrame) -> DataFrame:
    """path, target, name ('*': all), alias, kind (direct, aliased, from, relative, wildcard, dynamic, unknown), level (dots of a
    relative import) and line of every import, also of those within functions and of calls that import (P28)."""
    columns = ["path", "target", "name", "alias", "kind", "level", "line"]
    return _relation(files, _imports, "path string, target string, name string, alias string, kind string, level int, line int", columns)


def symbols(files: DataFrame) -> DataFrame:
    """path, name, kind, line of the top level of every file, and whether a wildcard import brings it: by __all__, or else all names
    that do not begin with an underscore (T29)."""
    return _relation(files, _symbols, "path string, name string, kind string, line int, public boolean", ["path", "name", "kind", "line", "public"])
