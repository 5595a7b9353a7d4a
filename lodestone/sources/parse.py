"""Declarations, imports and calls of single source files.

Python files are parsed with the standard library. For the other languages there is no parser at hand: declarations are
found by patterns at line starts and their ends by matching braces, which covers ordinary layouts only.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lodestone.functions.predicates import ID_PREFIXES
from lodestone.functions.text import brace_end, sites
from lodestone.session import ship, spread

_MODIFIERS = r"(?:(?:export|default|public|private|protected|static|final|abstract|async|inline|extern|virtual|const|unsigned|signed)\s+)*"
DECLARATIONS = {
    "go": (("method", r"^func\s+\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)\s*[\[(]"), ("function", r"^func\s+(?P<name>\w+)\s*[\[(]"), ("struct", r"^\s*(?:type\s+)?(?P<name>\w+)\s+struct\b"), ("interface", r"^\s*(?:type\s+)?(?P<name>\w+)\s+interface\b")),
    "typescript": (("class", rf"^\s*{_MODIFIERS}class\s+(?P<name>\w+)"), ("interface", rf"^\s*{_MODIFIERS}interface\s+(?P<name>\w+)"), ("function", rf"^\s*{_MODIFIERS}function\s*\*?\s*(?P<name>\w+)"), ("function", rf"^\s*{_MODIFIERS}(?:const|let|var)\s+(?P<name>\w+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|\w+)\s*=>"), ("method", rf"^\s+{_MODIFIERS}(?P<name>\w+)\s*\([^)]*\)\s*(?::[^{{]+)?\{{")),
    "java": (("class", rf"^\s*{_MODIFIERS}class\s+(?P<name>\w+)"), ("interface", rf"^\s*{_MODIFIERS}interface\s+(?P<name>\w+)"), ("method", rf"^\s+{_MODIFIERS}[\w<>\[\],.]+\s+(?P<name>\w+)\s*\([^;]*\{{\s*$")),
    "c": (("struct", r"^\s*(?:typedef\s+)?struct\s+(?P<name>\w+)\s*\{"), ("function", rf"^{_MODIFIERS}[\w*]+[\s*]+(?P<name>\w+)\s*\([^;]*$")),
    "cpp": (("class", r"^\s*class\s+(?P<name>\w+)[^;]*$"), ("struct", r"^\s*struct\s+(?P<name>\w+)[^;]*$"), ("method", rf"^{_MODIFIERS}[\w:<>*&]*[\s*&]+(?P<owner>\w+)::(?P<name>~?\w+)\s*\([^;]*$"), ("function", rf"^{_MODIFIERS}[\w:<>*&]+[\s*&]+(?P<name>\w+)\s*\([^;]*$")),
}
IMPORTS = {
    "go": r'^\s*(?:import\s+)?(?:\w+\s+)?"(?P<name>[^"]+)"\s*$',
    "typescript": r"""^\s*import\b.*?["'](?P<name>[^"']+)["']""",
    "java": r"^\s*import\s+(?:static\s+)?(?P<name>[\w.*]+)\s*;",
    "c": r'^\s*#\s*include\s*[<"](?P<name>[^>"]+)[>"]',
    "cpp": r'^\s*#\s*include\s*[<"](?P<name>[^>"]+)[>"]',
}
_NO_NAME = frozenset(("if", "for", "while", "switch", "return", "else", "catch", "do", "sizeof", "new", "delete"))

SCHEMA = "row string, path string, id string, kind string, name string, qualified_name string, language string, start_line long, end_line long, signature string, docstring string, is_exported long, source string, target string, line long, content_hash string, errors string"


def parse(path: str, text: str, language: str) -> list[dict]:
    """Rows of a file: nodes, and contains, imports and calls edges; a repeated symbol counts once and is noted."""
    found, edges, problems = ([], [], []) if language != "python" else _python(text)
    if language in DECLARATIONS:
        found, edges = _patterns(text, language)
    prefix = ID_PREFIXES.get(language, "unknown")
    ids, rows, seen = {}, [], set()
    for d in sorted(found, key=lambda d: d["start_line"]):
        d["id"] = f"{prefix}:{path}::{d['qualified_name']}"
        if d["id"] in seen:
            problems.append(f"repeated {d['qualified_name']}")
            continue
        seen.add(d["id"])
        ids[d["qualified_name"]] = d["id"]
        rows.append({"row": "node", "language": language, **d})
        owner = d["qualified_name"].rpartition(".")[0]
        rows.append({"row": "contains", "source": ids.get(owner, f"file:{path}"), "target": d["id"], "line": d["start_line"]})
    rows += [{"row": "imports", "source": f"file:{path}", "target": f"import:{name}", "line": line} for line, name in edges]
    by_name: dict[str, str] = {}
    spans = [(d["end_line"] - d["start_line"], d) for d in found if d["kind"] in ("function", "method") and "id" in d]
    for _, d in spans:
        by_name.setdefault(d["name"], d["id"])
        by_name[d["qualified_name"]] = d["id"]
    for line, name, lead in sites(text):
        inside = [(size, d["id"]) for size, d in spans if d["start_line"] <= line <= d["end_line"]]
        target = by_name.get(f"{lead}.{name}") or by_name.get(name)
        if inside and target and min(inside)[1] != target:
            rows.append({"row": "calls", "source": min(inside)[1], "target": target, "line": line})
    digest = hashlib.sha256(text.encode()).hexdigest()
    rows.append({"row": "file", "language": language, "content_hash": digest, "errors": "; ".join(problems)})
    return [{"path": path, **r} for r in rows]


def _python(text: str) -> tuple[list[dict], list[tuple[int, str]], list[str]]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [], [], [f"not parsed: {e}"]
    found, imports = [], []

    def walk(node: ast.AST, owner: str, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                is_class = isinstance(child, ast.ClassDef)
                name = f"{owner}.{child.name}" if owner else child.name
                signature = "" if is_class else f"({ast.unparse(child.args)})"
                found.append({"kind": "class" if is_class else "method" if in_class else "function", "name": child.name, "qualified_name": name, "start_line": child.lineno, "end_line": child.end_lineno or child.lineno, "signature": signature, "docstring": ast.get_docstring(child) or "", "is_exported": int(not child.name.startswith("_"))})
                walk(child, name, is_class)
            elif isinstance(child, ast.Import):
                imports.extend((child.lineno, a.name) for a in child.names)
            elif isinstance(child, ast.ImportFrom):
                imports.append((child.lineno, "." * child.level + (child.module or "")))
            else:
                walk(child, owner, in_class)

    walk(tree, "", False)
    return found, imports, []


def _patterns(text: str, language: str) -> tuple[list[dict], list[tuple[int, str]]]:
    found, imports, rows = [], [], text.split("\n")
    containers: list[tuple[int, str]] = []
    imported, patterns = re.compile(IMPORTS[language]).match, [(kind, re.compile(p).match) for kind, p in DECLARATIONS[language]]
    for no, line in enumerate(rows, 1):
        if m := imported(line):
            imports.append((no, m["name"]))
        if not line.strip():
            continue
        for kind, declared in patterns:
            m = declared(line)
            if not m or m["name"] in _NO_NAME:
                continue
            end = brace_end(rows, no)
            containers = [c for c in containers if c[0] >= no]
            owner = m.groupdict().get("owner") or (containers[-1][1] if containers and kind in ("method", "class", "interface") else "")
            name = f"{owner}.{m['name']}" if owner else m["name"]
            above = []
            k = no - 2
            while k >= 0 and rows[k].strip().startswith("//"):
                above.insert(0, rows[k].strip().lstrip("/ "))
                k -= 1
            public = m["name"][:1].isupper() if language == "go" else "private" not in line
            found.append({"kind": kind, "name": m["name"], "qualified_name": name, "start_line": no, "end_line": end, "signature": line.strip().rstrip("{").strip(), "docstring": "\n".join(above), "is_exported": int(public)})
            if kind in ("class", "interface", "struct"):
                containers.append((end, name))
            break
    return found, imports


def parse_files(sources: DataFrame) -> DataFrame:
    """Rows of SCHEMA for sources (path, text, language), each file on its own."""
    ship(sources.sparkSession)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [r for path, text, lang in zip(frame["path"], frame["text"], frame["language"], strict=True) for r in parse(path, text or "", lang)]
            yield pd.DataFrame({n: [r.get(n) for r in rows] for n in names}, columns=names, dtype=object)

    return spread(sources.select("path", "text", "language"), "path").mapInPandas(run, SCHEMA)


def nodes_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("row = 'node'").selectExpr("id", "kind", "name", "qualified_name", "path as file_path", "language", "start_line", "end_line", "signature", "docstring", "is_exported")


def edges_of(parsed: DataFrame) -> DataFrame:
    return parsed.where("row in ('contains', 'imports', 'calls')").selectExpr("source", "target", "row as kind", "'tree-sitter' as provenance", "line")
