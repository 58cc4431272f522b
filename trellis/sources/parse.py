"""Parsers from source text to symbols, call sites and imports, chosen by language.

Python is read with its own grammar, languages with braces and Ruby by their declarations (see ``brace``); others can be
added to ``PARSERS`` as functions of a text.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.sources import brace

Parsed = tuple[list[tuple], list[tuple], list[tuple]]


def parse_python(text: str) -> Parsed:
    """Symbols ``(name, kind, start, end, signature, doc)``, calls ``(caller, callee, receiver, line, kind)``, imports ``(source, name, line)``.

    A function in the body of a class comes twice, as Method and as Function.
    """
    symbols: list[tuple] = []
    calls: list[tuple] = []
    imports: list[tuple] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return symbols, calls, imports
    lines = text.split("\n")

    def visit(node: ast.AST, caller: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                entry = (child.name, child.lineno, child.end_lineno, lines[child.lineno - 1].strip().rstrip(":"), ast.get_docstring(child))
                for kind in ("Method", "Function") if in_class else ("Function",):
                    symbols.append((entry[0], kind, *entry[1:]))
                visit(child, child.name, False)
            elif isinstance(child, ast.ClassDef):
                symbols.append((child.name, "Class", child.lineno, child.end_lineno, lines[child.lineno - 1].strip().rstrip(":"), ast.get_docstring(child)))
                visit(child, caller, True)
            else:
                if isinstance(child, ast.Call) and caller:
                    f = child.func
                    if isinstance(f, ast.Name):
                        calls.append((caller, f.id, None, child.lineno, "calls"))
                    elif isinstance(f, ast.Attribute):
                        owner = f.value.id if isinstance(f.value, ast.Name) else f.value.attr if isinstance(f.value, ast.Attribute) else ast.unparse(f.value)[:40]
                        calls.append((caller, f.attr, owner, child.lineno, "calls"))
                elif isinstance(child, ast.Import):
                    imports.extend((a.name, (a.asname or a.name).rpartition(".")[2], child.lineno) for a in child.names)
                elif isinstance(child, ast.ImportFrom):
                    imports.extend(("." * child.level + (child.module or ""), a.asname or a.name, child.lineno) for a in child.names)
                visit(child, caller, False)

    visit(tree, None, False)
    return symbols, calls, imports


PARSERS: dict[str, Callable[[str], Parsed]] = {"python": parse_python, **brace.PARSERS}

_SCHEMA = "part string, file string, name string, kind string, line_start long, line_end long, signature string, doc string, content string, caller string, receiver string, source string"


def parse_files(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Symbols, call sites and imports of ``path, language, body``; each file is parsed once and by itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, language, body in zip(batch["path"], batch["language"], batch["body"]):
                parser = PARSERS.get((language or "").lower())
                if parser is None or body is None:
                    continue
                symbols, calls, imports = parser(body)
                lines = body.split("\n")
                rows += [("symbol", path, n, k, a, z, sig, doc, "\n".join(lines[a - 1 : z]), None, None, None) for n, k, a, z, sig, doc in symbols]
                rows += [("call", path, callee, kind, line, line, None, None, None, caller, receiver, None) for caller, callee, receiver, line, kind in calls]
                rows += [("import", path, name, None, line, line, None, None, None, None, None, source) for source, name, line in imports]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(", ")])

    parsed = files.select("path", "language", "body").mapInPandas(run, _SCHEMA)
    return (
        parsed.filter("part = 'symbol'").select("file", "name", "kind", "line_start", "line_end", "signature", "doc", "content"),
        parsed.filter("part = 'call'").select("file", "caller", F.col("name").alias("callee"), "receiver", F.col("line_start").alias("line"), "kind"),
        parsed.filter("part = 'import'").select("file", "source", "name", F.col("line_start").alias("line")),
    )
