"""Python sources to entities: each file is parsed once, into one row of nested arrays; tables are projections of it."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CLASS = "struct<name:string,docstring:string,code:string,start_line:int,end_line:int,bases:array<string>>"
_FUNCTION = "struct<name:string,class_name:string,is_method:boolean,docstring:string,code:string,start_line:int,end_line:int,parameters:array<string>,calls:array<string>>"
_ATTRIBUTE = "struct<name:string,class_name:string,type_hint:string>"
_VARIABLE = "struct<name:string,scope:string,function_name:string,class_name:string,value:string,is_constant:boolean>"
_BLOCK = "struct<ord:int,parent_ord:int,depth:int,path:array<string>,type:string,identifier:string,start_line:int,end_line:int,tokens:int>"
SCHEMA = f"file string, imports array<string>, classes array<{_CLASS}>, functions array<{_FUNCTION}>, attributes array<{_ATTRIBUTE}>, variables array<{_VARIABLE}>, blocks array<{_BLOCK}>, error string"


def dotted(node: ast.AST) -> str | None:
    """a.b.c of names and attributes; None for other expressions."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (head := dotted(node.value)):
        return f"{head}.{node.attr}"
    return None


def imported(tree: ast.AST) -> list[str]:
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
    return out


def _code(lines: list[str], node: ast.AST) -> str:
    return "\n".join(lines[node.lineno - 1 : node.end_lineno])


def _function(node: ast.FunctionDef, lines: list[str], owner: str | None) -> dict:
    args = node.args
    called = [n for x in ast.walk(node) if isinstance(x, ast.Call) and (n := dotted(x.func))]
    return {
        "name": node.name, "class_name": owner, "is_method": owner is not None, "docstring": ast.get_docstring(node), "code": _code(lines, node),
        "start_line": node.lineno, "end_line": node.end_lineno, "parameters": [a.arg for a in [*args.posonlyargs, *args.args]], "calls": called,
    }


def _variables(body: list[ast.stmt], scope: str, function: str | None, owner: str | None) -> list[dict]:
    out = []
    for node in body:
        if isinstance(node, ast.Assign):
            for target in node.targets:
                for name in target.elts if isinstance(target, ast.Tuple) else [target]:
                    if isinstance(name, ast.Name):
                        constant = name.id.isupper() and "_" in name.id
                        out.append({"name": name.id, "scope": scope, "function_name": function, "class_name": owner, "value": ast.unparse(node.value), "is_constant": constant})
        elif isinstance(node, ast.For) and isinstance(node.target, ast.Name):
            out.append({"name": node.target.id, "scope": scope, "function_name": function, "class_name": owner, "value": None, "is_constant": False})
        for inner in ("body", "orelse", "finalbody"):
            if not isinstance(node, ast.FunctionDef | ast.ClassDef | ast.AsyncFunctionDef):
                out += _variables(getattr(node, inner, []), scope, function, owner)
    return out


def _blocks(tree: ast.Module, lines: list[str]) -> list[dict]:
    """Structure blocks of a file, in order, with `__init__` as a constructor."""
    out: list[dict] = []

    def add(node: ast.AST, kind: str, name: str | None, parent: int | None, path: list[str], first: int, last: int) -> None:
        at = len(out)
        here = [*path, name] if name else path
        out.append({"ord": at, "parent_ord": parent, "depth": len(here), "path": here, "type": kind, "identifier": name, "start_line": first, "end_line": last, "tokens": sum(len(x.split()) for x in lines[first - 1 : last])})
        for child in getattr(node, "body", []):
            first_line = min([child.lineno, *(d.lineno for d in getattr(child, "decorator_list", []))])
            if isinstance(child, ast.ClassDef):
                add(child, "class", child.name, at, here, first_line, child.end_lineno)
            elif isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                add(child, "constructor" if child.name == "__init__" else "function", child.name, at, here, first_line, child.end_lineno)
            elif not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "import" if isinstance(child, ast.Import | ast.ImportFrom) else "assignment" if isinstance(child, ast.Assign | ast.AnnAssign) else "code"
                out.append({"ord": len(out), "parent_ord": at, "depth": len(here) + 1, "path": here, "type": kind, "identifier": None, "start_line": child.lineno, "end_line": child.end_lineno, "tokens": sum(len(x.split()) for x in lines[child.lineno - 1 : child.end_lineno])})

    add(tree, "module", None, None, [], 1, max(1, len(lines)))
    return out


def parsed(path: str, content: bytes) -> dict:
    """One file's entities: top-level classes and functions and direct methods; annotated assignments, async and nested
    definitions aren't extracted. What can't be read or parsed has an error instead."""
    empty = {"file": path, "imports": [], "classes": [], "functions": [], "attributes": [], "variables": [], "blocks": [], "error": None}
    try:
        text = bytes(content or b"").decode("utf-8")
        tree = ast.parse(text)
    except (SyntaxError, UnicodeDecodeError, ValueError, RecursionError) as e:
        return empty | {"error": f"{type(e).__name__}: {e}"[:500]}
    lines = text.split("\n")
    out = empty | {"imports": imported(tree), "blocks": _blocks(tree, lines), "variables": _variables(tree.body, "global", None, None)}
    classes, functions, attributes = [], [], []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef):
            functions.append(_function(node, lines, None))
            out["variables"] += _variables(node.body, "local", node.name, None)
        elif isinstance(node, ast.ClassDef):
            bases = [n for b in node.bases if isinstance(b, ast.Name | ast.Attribute) and (n := dotted(b))]
            classes.append({"name": node.name, "docstring": ast.get_docstring(node), "code": _code(lines, node), "start_line": node.lineno, "end_line": node.end_lineno, "bases": bases})
            out["variables"] += _variables([n for n in node.body if isinstance(n, ast.Assign)], "class", None, node.name)
            for inner in node.body:
                if isinstance(inner, ast.FunctionDef):
                    functions.append(_function(inner, lines, node.name))
                    out["variables"] += _variables(inner.body, "local", inner.name, node.name)
                elif isinstance(inner, ast.Assign):
                    attributes += [{"name": t.id, "class_name": node.name, "type_hint": None} for t in inner.targets if isinstance(t, ast.Name)]
    return out | {"classes": classes, "functions": functions, "attributes": attributes}


def files(sources: DataFrame) -> DataFrame:
    """A row of entities for each (file, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [parsed(p, c) for p, c in zip(frame["file"], frame["content"])]
            yield pd.DataFrame(rows, columns=["file", "imports", "classes", "functions", "attributes", "variables", "blocks", "error"])

    return sources.select("file", F.col("content").cast("binary").alias("content")).mapInPandas(run, SCHEMA)


def table(parsed_files: DataFrame, name: str) -> DataFrame:
    """classes, functions, attributes, variables or blocks as rows, with file and pos."""
    rows = parsed_files.select("file", F.posexplode(name).alias("_p", "x")).select("file", F.col("_p").cast("long").alias("pos"), "x.*")
    return rows


def file_nodes(parsed_files: DataFrame) -> DataFrame:
    """file, module (dotted folder), define_class, imports."""
    folder = F.replace(F.regexp_replace("file", "/?[^/]*$", ""), F.lit("/"), F.lit("."))
    return parsed_files.select("file", folder.alias("module"), F.transform("classes", lambda c: c["name"]).alias("define_class"), "imports", "error")


def errors(parsed_files: DataFrame) -> DataFrame:
    return parsed_files.where("error is not null").select("file", "error")
