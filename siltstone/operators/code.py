"""Code index: symbol and relation tables, queries, references, markers.

Symbols: ``record_id, kind, name, qualified_name, visibility, signature, imports,
doc_comment, markers, is_unsafe, is_test, file_path, start_line, end_line``.
Relations: ``kind, source_record_id, target_record_id, confidence_milli``.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.repository import comment_markers

SYMBOLS = (
    "record_id string, kind string, name string, qualified_name string, visibility string, signature string, imports array<string>, "
    "doc_comment string, markers array<string>, is_unsafe boolean, is_test boolean, file_path string, start_line int, end_line int, calls array<string>, bases array<string>"
)

_RUST = re.compile(r"^\s*(pub(?:\([^)]*\))?\s+)?((?:const\s+|async\s+|unsafe\s+|extern\s+\"[^\"]*\"\s+)*)(fn|struct|enum|trait|mod|impl|type|const|static)\s+(?:<[^>]*>\s*)?([A-Za-z_][A-Za-z0-9_]*)")
_SCRIPT = re.compile(r"^\s*(export\s+(?:default\s+)?)?(?:abstract\s+|async\s+)*(class|function|interface|type|enum|const|let)\s+\*?\s*([A-Za-z_$][\w$]*)(.*)$")
_SCRIPT_IMPORT = re.compile(r"""^\s*import\s+(?:.+?\s+from\s+)?['"]([^'"]+)['"]""")
_METHOD = re.compile(r"^\s+(?:(?:public|private|protected|static|async|override|readonly|get|set)\s+)*\*?([A-Za-z_$][\w$]*)\s*(?:<[^>]*>)?\([^)]*\)\s*(?::\s*[^{;=]+)?\{")
_NO_METHOD = {"if", "for", "while", "switch", "catch", "function", "return", "with"}
_CALL = re.compile(r"\b([A-Za-z_][\w]*)\s*\(")


def _row(path: str, kind: str, name: str, qualified: str, public: bool, signature: str, start: int, end: int, **more) -> dict:
    base = {"record_id": f"{path}#{qualified}@{start}", "kind": kind, "name": name, "qualified_name": qualified, "visibility": "public" if public else "private", "signature": signature}
    rest = {"imports": [], "doc_comment": None, "markers": [], "is_unsafe": False, "is_test": False, "file_path": path, "start_line": start, "end_line": end, "calls": [], "bases": []}
    return base | rest | more


def python_symbols(path: str, text: str) -> list[dict]:
    """Classes, functions, imports, calls and comment markers of a Python module; none if it doesn't parse."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    source, found = text.split("\n"), comment_markers(text, "python")
    imports = sorted({a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names} | {f"{n.module or ''}.{a.name}" for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) for a in n.names})
    module = re.sub(r"(?:/__init__)?\.py$", "", path).replace("/", ".")
    out = [_row(path, "module", module.rsplit(".", 1)[-1], module, True, module, 1, max(1, len(source)), imports=imports, doc_comment=ast.get_docstring(tree))]

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if not isinstance(child, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
                visit(child, prefix)
                continue
            kind = "class" if isinstance(child, ast.ClassDef) else "function"
            qualified = f"{prefix}.{child.name}"
            calls = sorted({c.func.id if isinstance(c.func, ast.Name) else c.func.attr for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(c.func, ast.Name | ast.Attribute)})
            bases = [ast.unparse(b) for b in child.bases] if kind == "class" else []
            marks = [kind for kind, first, _ in found if child.lineno <= first <= child.end_lineno]
            out.append(
                _row(path, kind, child.name, qualified, not child.name.startswith("_"), source[child.lineno - 1].strip(), child.lineno, child.end_lineno)
                | {"doc_comment": ast.get_docstring(child), "markers": marks, "is_test": child.name.startswith("test_"), "calls": calls, "bases": bases}
            )
            visit(child, qualified)

    visit(tree, module)
    return out


def _braced(lines: list[str], start: int) -> int:
    """Last line of the block that opens at or after a line, by counting braces; the line itself if none opens."""
    depth, opened = 0, False
    for i in range(start, len(lines)):
        line = re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", "", lines[i])
        for c in line:
            depth += (c == "{") - (c == "}")
            opened |= c == "{"
        if opened and depth <= 0:
            return i + 1
        if not opened and ";" in line:
            return i + 1
    return len(lines) if opened else start + 1


def rust_symbols(path: str, text: str) -> list[dict]:
    """Items found line by line (no macro expansion, no nested generics: lower fidelity than a syntax tree)."""
    lines, out, doc, attributes = text.split("\n"), [], [], []
    found = comment_markers(text, "rust")
    scope: list[tuple[int, str]] = []
    for i, line in enumerate(lines):
        stripped = line.strip()
        if stripped.startswith("///"):
            doc.append(stripped[3:].strip())
            continue
        if stripped.startswith("#["):
            attributes.append(stripped)
            continue
        while scope and i + 1 > scope[-1][0]:
            scope.pop()
        if m := _RUST.match(line):
            end = _braced(lines, i)
            name = m[4]
            qualified = "::".join([*(n for _, n in scope), name])
            body = lines[i:end]
            marks = [kind for kind, first, _ in found if i < first <= end]
            out.append(
                _row(path, m[3], name, qualified, bool(m[1]), stripped.rstrip("{").strip(), i + 1, end)
                | {"doc_comment": "\n".join(doc) or None, "markers": marks, "is_unsafe": "unsafe" in m[2] or any("unsafe {" in b for b in body)}
                | {"is_test": any("test" in a for a in attributes), "calls": sorted(set(_CALL.findall("\n".join(body[1:])))) if m[3] == "fn" else []}
            )
            if end > i + 1:
                scope.append((end, name))
        if stripped:
            doc, attributes = [], []
    uses = sorted({m[1] for line in lines if (m := re.match(r"^\s*use\s+([\w:]+)", line))})
    return [x | {"imports": uses} for x in out]


def script_symbols(path: str, text: str) -> list[dict]:
    """TypeScript and JavaScript declarations and the methods of classes, line by line."""
    lines, out = text.split("\n"), []
    imports = sorted({m[1] for line in lines if (m := _SCRIPT_IMPORT.match(line))})
    found = comment_markers(text, "typescript")

    def more(first: int, end: int) -> dict:
        return {"imports": imports, "markers": [kind for kind, at, _ in found if first < at <= end], "calls": sorted(set(_CALL.findall("\n".join(lines[first + 1 : end]))))}

    for i, line in enumerate(lines):
        if not (m := _SCRIPT.match(line)):
            continue
        arrow = m[2] in ("const", "let")
        if arrow and "=>" not in line and "function" not in m[4]:
            continue
        end = _braced(lines, i)
        bases = re.findall(r"(?:extends|implements)\s+([\w$]+)", m[4])
        out.append(_row(path, "function" if arrow else m[2], m[3], f"{path}::{m[3]}", bool(m[1]), line.strip().rstrip("{").strip(), i + 1, end, bases=bases, **more(i, end)))
        at = i + 1
        while m[2] == "class" and at < end:
            method = _METHOD.match(lines[at])
            if method and method[1] not in _NO_METHOD:
                close = _braced(lines, at)
                out.append(_row(path, "method", method[1], f"{path}::{m[3]}::{method[1]}", True, lines[at].strip().rstrip("{").strip(), at + 1, close, **more(at, close)))
                at = close
            else:
                at += 1
    return out


def symbols(files: DataFrame) -> DataFrame:
    """Symbols of ``files (path, text)`` by extension, file by file in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split(" ")[0] for f in SYMBOLS.split(", ")]
        for batch in batches:
            rows: list[dict] = []
            for path, text in zip(batch["path"], batch["text"], strict=True):
                kind = path.rsplit(".", 1)[-1].lower()
                if text is not None and kind == "py":
                    rows += python_symbols(path, text)
                elif text is not None and kind == "rs":
                    rows += rust_symbols(path, text)
                elif text is not None and kind in ("ts", "tsx", "js", "jsx", "mjs", "cjs"):
                    rows += script_symbols(path, text)
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text").mapInPandas(run, SYMBOLS)


def relations(table: DataFrame) -> DataFrame:
    """Defines, Calls, Implements and Imports between symbols. A name that isn't unique gives no edge."""
    unique = table.groupBy("name").agg(F.count("*").alias("n"), F.min("record_id").alias("target")).filter("n = 1").select("name", "target")

    def by_name(names: str, kind: str, confidence: int) -> DataFrame:
        wanted = table.select("record_id", F.explode(names).alias("raw")).withColumn("name", F.regexp_extract("raw", r"([A-Za-z_$][\w$]*)$", 1))
        return wanted.join(unique, "name").filter("record_id <> target").select(F.lit(kind).alias("kind"), F.col("record_id").alias("source_record_id"), F.col("target").alias("target_record_id"), F.lit(confidence).alias("confidence_milli"))

    outer = table.select(F.col("record_id").alias("source_record_id"), F.col("qualified_name").alias("outer"), "file_path")
    inner = table.select(F.col("record_id").alias("target_record_id"), "file_path", F.regexp_replace("qualified_name", r"(?:\.|::)[^.:]+$", "").alias("outer"))
    defines = outer.join(inner, ["file_path", "outer"]).filter("source_record_id <> target_record_id")
    defines = defines.select(F.lit("Defines").alias("kind"), "source_record_id", "target_record_id", F.lit(1000).alias("confidence_milli"))
    called = by_name("calls", "Calls", 800)
    tests = called.join(table.filter("is_test").select(F.col("record_id").alias("source_record_id")), "source_record_id", "left_semi").withColumn("kind", F.lit("Tests"))
    return defines.unionByName(called).unionByName(tests).unionByName(by_name("bases", "Implements", 900)).unionByName(by_name("imports", "Imports", 900)).distinct()


def matches(kind: str, value: str | None = None) -> Column:
    """Symbol predicate of a code query; names and patterns are case-sensitive."""
    if kind == "all":
        return F.lit(True)
    if kind == "symbol":
        return F.col("name").contains(value) | F.col("qualified_name").contains(value)
    if kind == "path":
        return F.col("file_path").contains(value)
    if kind == "regex":
        fields = ("name", "qualified_name", "file_path", "signature")
        found = F.exists("imports", lambda x: x.rlike(value))
        for f in fields:
            found = found | F.coalesce(F.col(f).rlike(value), F.lit(False))
        return found
    if kind == "doc":
        return F.coalesce(F.col("doc_comment").contains(value), F.lit(False))
    if kind == "marker":
        return F.col("is_unsafe") | F.array_contains("markers", "unsafe") if value == "unsafe" else F.array_contains("markers", value)
    raise ValueError(f"unknown code query {kind}")


def regex_error(pattern: str) -> str | None:
    """An invalid pattern is an answer, not an exception."""
    try:
        re.compile(pattern)
    except re.error as e:
        return str(e)
    return None


def query(table: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Matches in the order of file, line and qualified name with how many matched in all."""
    found = table.filter(condition)
    order = [F.col("file_path"), F.col("start_line"), F.col("qualified_name"), F.col("record_id")]
    total = found.count()
    return found.orderBy(*order).limit(limit).withColumn("matched", F.lit(total).cast("long")).withColumn("truncated", F.lit(total > limit))


def changed(table: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols of changed ``files (file_path)``."""
    return table.join(files, "file_path", "left_semi")


def references(table: DataFrame, edges: DataFrame, seeds: DataFrame, inbound: bool = True) -> DataFrame:
    """Symbols at the other end of edges into (or out of) ``seeds (record_id)``."""
    near, far = ("target_record_id", "source_record_id") if inbound else ("source_record_id", "target_record_id")
    met = edges.join(seeds.select(F.col("record_id").alias(near)), near, "left_semi")
    return met.join(table.select(F.col("record_id").alias(far), "qualified_name", "file_path", "start_line"), far)


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """For each ``points (key, line)`` the smallest of ``ranges (key, idx, start_line, end_line)`` around it, the
    first on ties. The key is an equi join, so only one file's ranges meet its lines."""
    met = points.join(ranges, "key").filter("line BETWEEN start_line AND end_line")
    order = Window.partitionBy("key", "line").orderBy(F.col("end_line") - F.col("start_line"), "idx")
    return met.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("key", "line", "idx")


def has_marker(markers: Column, is_unsafe: Column, wanted: str) -> Column:
    return F.array_contains(markers, wanted) | (F.lit(wanted == "unsafe") & is_unsafe)


def inside_selection(path: Column, selected: Column) -> Column:
    """Equal, or below at a component boundary."""
    return (path == selected) | path.startswith(F.concat(selected, F.lit("/")))
