"""Symbols of Python sources, entities and relations by rule, marked blocks, tree operations, migrations."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds of entity.
ENTITY_KINDS = ["Person", "Organization", "Project", "Concept", "Task", "Decision", "Event", "Location"]
#: Words that tell a phrase's kind; a substitute for a model, which can be given instead.
CUES = [("Organization", "(?i)\\b(inc|corp|ltd|llc|gmbh|company|bank|university)\\b"), ("Project", "(?i)\\bproject\\b"), ("Task", "(?i)\\b(task|todo|fix)\\b"), ("Decision", "(?i)\\b(decision|decided)\\b"), ("Event", "(?i)\\b(meeting|conference|launch)\\b"), ("Location", "(?i)\\b(city|street|river|county)\\b")]

SYMBOLS = "filepath string, name string, kind string, start int, end int, refs array<struct<name:string,kind:string,line:int>>"


def python_symbols(source: str, module: str) -> list[tuple]:
    """GRF-32 for Python: (qualified name, kind, first line, last line, references) of each definition; a function in a
    class is a method. Sources that don't parse have none."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []

    def name_of(e: ast.expr) -> str | None:
        if isinstance(e, ast.Attribute):
            return f"{base}.{e.attr}" if (base := name_of(e.value)) else e.attr
        return e.id if isinstance(e, ast.Name) else None

    def calls(body: list[ast.stmt]) -> Iterator[tuple[str, str, int]]:
        todo: list[ast.AST] = list(body)
        while todo:
            e = todo.pop()
            if isinstance(e, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(e, ast.Call) and (n := name_of(e.func)):
                yield n, "calls", e.lineno
            todo += ast.iter_child_nodes(e)

    def visit(body: list[ast.stmt], chain: str, in_class: bool) -> None:
        for e in body:
            if isinstance(e, ast.ClassDef):
                refs = [(n, "inherits", e.lineno) for b in e.bases if (n := name_of(b))]
                out.append((f"{chain}.{e.name}", "class", e.lineno, e.end_lineno, refs))
                visit(e.body, f"{chain}.{e.name}", True)
            elif isinstance(e, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append((f"{chain}.{e.name}", "method" if in_class else "function", e.lineno, e.end_lineno, sorted(calls(e.body), key=lambda r: (r[2], r[0]))))
                visit(e.body, f"{chain}.{e.name}", False)

    imports = [(a.name, "imports", e.lineno) for e in ast.walk(tree) if isinstance(e, ast.Import) for a in e.names]
    imports += [(e.module or "", "imports", e.lineno) for e in ast.walk(tree) if isinstance(e, ast.ImportFrom)]
    out.append((module, "module", 1, source.count("\n") + 1, imports + sorted(calls([s for s in tree.body]), key=lambda r: (r[2], r[0]))))
    visit(tree.body, module, False)
    return out


def symbols(files: DataFrame, text: str = "text") -> DataFrame:
    """GRF-32 over files (filepath, text). Other languages need a parser of their own, by the same columns."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, source in zip(pdf.filepath, pdf[text], strict=True):
                module = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                rows += [(path, n, k, a, b, [{"name": r[0], "kind": r[1], "line": r[2]} for r in refs]) for n, k, a, b, refs in python_symbols(source or "", module)]
            yield pd.DataFrame(rows, columns=["filepath", "name", "kind", "start", "end", "refs"])

    return files.select("filepath", text).mapInPandas(run, SYMBOLS)


def rule_entities(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """LLM-01 by rule: (key, name, kind) of phrases of capitalised words."""
    found = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), F.lit(1)))
    own = df.select(key, F.explode(found).alias("name"))
    kind = None
    for k, cue in CUES:
        kind = F.when(F.col("name").rlike(cue), k) if kind is None else kind.when(F.col("name").rlike(cue), k)
    return own.withColumn("kind", kind.otherwise("Concept"))


def rule_relations(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """LLM-02 by rule: (key, source, target, relation, confidence): neighbouring phrases of a line."""
    lines = df.select(key, F.explode(F.split(text, "\n")).alias("line"))
    found = F.regexp_extract_all(F.col("line"), F.lit(r"(\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)+)"), F.lit(1))
    pairs = lines.select(key, found.alias("f")).where(F.size("f") > 1).select(key, F.explode(F.arrays_zip(F.slice("f", F.lit(1), F.size("f") - 1).alias("source"), F.slice("f", F.lit(2), F.size("f") - 1).alias("target"))).alias("p"))
    return pairs.select(key, "p.source", "p.target").where("source <> target").distinct().select("*", F.lit("related_to").alias("relation"), F.lit("INFERRED").alias("confidence"))


def compressible(enabled: bool, spreadsheet: Column, verbatim: Column, text: Column, least: int = 4096) -> Column:
    """LLM-04: whether an excerpt may be compressed; the result is used only if it is shorter."""
    return F.lit(enabled) & ~spreadsheet & ~verbatim & (F.octet_length(text) >= least)


def rewritten(query: str, rewriter=None) -> str:
    """LLM-03: a rewritten query, or the query itself on any error or an empty answer."""
    if rewriter is None:
        return query
    try:
        return rewriter(query).strip() or query
    except Exception:  # noqa: BLE001  a service may fail in any way; the query still runs
        return query


def marked_block(text: Column, body: str | None, begin: str = "<!-- corpus:begin -->", end: str = "<!-- corpus:end -->") -> Column:
    """DML-11: the text with its marked block replaced, put at the end if there is none, or taken out."""
    import re

    pattern = "(?s)\\n?" + re.escape(begin) + ".*?" + re.escape(end) + "\\n?"
    bare = F.regexp_replace(text, pattern, "")
    return bare if body is None else F.concat(bare, F.lit(f"\n{begin}\n{body}\n{end}\n"))


def migrated(df: DataFrame, schema: T.StructType) -> DataFrame:
    """DML-09: additive migration: columns the schema has and the table lacks are null."""
    return df.select(*df.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in schema if f.name not in df.columns))


TREE_OPS = "tree string, seq long, op string, path string, error string"


def tree_errors(rows: list[tuple]) -> tuple[list[str | None], dict[str, list]]:
    """DML-06: operations (op, path, target) on a tree in order: each one's error code or null, and what the tree holds
    at the end: path to [inode, kind]."""
    nodes: dict[str, list] = {"/": [1, "dir"]}
    links: dict[int, int] = {1: 2}
    number, out = 1, []

    def up(p: str) -> str:
        return p.rsplit("/", 1)[0] or "/"

    def below(p: str) -> list[str]:
        return [n for n in nodes if n != p and n.startswith(p.rstrip("/") + "/")]

    def missing(p: str) -> str | None:
        parent = nodes.get(up(p))
        return "ENOENT" if parent is None else "ENOTDIR" if parent[1] != "dir" else None

    for op, path, target in rows:
        error = missing(path) if path != "/" else None
        if not error and op in ("create", "mkdir", "symlink"):
            error = "EEXIST" if path in nodes else None
            if not error:
                number += 1
                nodes[path] = [number, {"create": "file", "mkdir": "dir", "symlink": "link"}[op]]
                links[number] = 2 if op == "mkdir" else 1
        elif not error and path not in nodes:
            error = "ENOENT"
        elif not error and op == "rmdir":
            error = "ENOTDIR" if nodes[path][1] != "dir" else "ENOTEMPTY" if below(path) else "EBUSY" if path == "/" else None
            if not error:
                del nodes[path]
        elif not error and op == "unlink":
            error = "EISDIR" if nodes[path][1] == "dir" else None
            if not error:
                links[nodes.pop(path)[0]] -= 1
        elif not error and op == "link":
            error = missing(target) or ("EEXIST" if target in nodes else "EPERM" if nodes[path][1] == "dir" else None)
            if not error:
                nodes[target] = nodes[path]
                links[nodes[path][0]] += 1
        elif not error and op == "rename":
            there = nodes.get(target)
            if err := missing(target):
                error = err
            elif path == target:
                error = None
            elif target.startswith(path + "/"):
                error = "EINVAL"
            elif there and there[1] == "dir" and nodes[path][1] != "dir":
                error = "EISDIR"
            elif there and there[1] != "dir" and nodes[path][1] == "dir":
                error = "ENOTDIR"
            elif there and below(target):
                error = "ENOTEMPTY"
            else:
                moved = {target + n[len(path) :]: nodes.pop(n) for n in [path, *below(path)]}
                nodes.update(moved)
        out.append(error)
    return out, nodes


def applied(ops: DataFrame) -> DataFrame:
    """DML-06 for each tree of ops (tree, seq, op, path, target): the operations with their errors. A tree's operations
    depend on one another, so a tree is one group."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        errors, _ = tree_errors([*zip(pdf.op, pdf.path, pdf.target, strict=True)])
        return pdf.assign(error=errors)[["tree", "seq", "op", "path", "error"]]

    return ops.groupBy("tree").applyInPandas(run, TREE_OPS)


def counted(df: DataFrame, name: str) -> DataFrame:
    """RNK-17: rows of a stage, reported to listeners while the plan runs."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))
