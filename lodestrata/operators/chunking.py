"""Cutting source files into chunks; Python by its syntax tree, other languages not yet."""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = (
    "chunk_type string, name string, parent_name string, start_line int, end_line int, content string, language string, is_async boolean, "
    "extra_metadata struct<decorators:array<string>,is_classmethod:boolean,is_staticmethod:boolean,is_property:boolean>"
)


@dataclass
class Item:
    """A statement or a comment of its own at one level: lines from 1, byte columns, and its node."""

    first: tuple[int, int]
    last: tuple[int, int]
    node: ast.AST | None = None
    body: list = field(default_factory=list)


class Source:
    def __init__(self, text: str) -> None:
        self.text = re.sub("\r\n?", "\n", text)
        self.lines = [x.encode() for x in self.text.split("\n")]

    def cut(self, a: tuple[int, int], b: tuple[int, int]) -> str:
        rows = self.lines[a[0] - 1 : b[0]]
        if not rows:
            return ""
        if len(rows) == 1:
            return rows[0][a[1] : b[1]].decode("utf-8", "replace")
        return b"\n".join([rows[0][a[1] :], *rows[1:-1], rows[-1][: b[1]]]).decode("utf-8", "replace")

    def comments(self) -> list[Item]:
        found = []
        try:
            for t in tokenize.generate_tokens(io.StringIO(self.text).readline):
                if t.type == tokenize.COMMENT:
                    at = lambda p: (p[0], len(self.text.split("\n")[p[0] - 1][: p[1]].encode()))  # noqa: B023, E731
                    found.append(Item(at(t.start), at(t.end)))
        except (tokenize.TokenError, SyntaxError):
            pass
        return found


DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def _item(node: ast.stmt, src: Source) -> Item:
    first = (node.lineno, node.col_offset)
    for d in getattr(node, "decorator_list", []):
        line = d.lineno
        col = src.lines[line - 1].rfind(b"@", 0, d.col_offset + 1)
        while col < 0 and line > 1:  # the @ of a decorator whose name stands on a later line
            line -= 1
            col = src.lines[line - 1].rfind(b"@")
        first = min(first, (line, col))
    return Item(first, (node.end_lineno, node.end_col_offset), node)


def _meta(node: ast.AST | None, src: Source) -> dict | None:
    names = [src.cut((d.lineno, d.col_offset), (d.end_lineno, d.end_col_offset)).strip() for d in getattr(node, "decorator_list", [])]
    if not names:
        return None
    base = {n.split("(", 1)[0].strip() for n in names}
    return {"decorators": names} | {f"is_{k}": True if k in base else None for k in ("classmethod", "staticmethod", "property")}


def _row(kind: str, first, last, content: str, node=None, parent: str | None = None, src: Source | None = None) -> dict:
    return {"chunk_type": kind, "name": getattr(node, "name", None) if isinstance(node, (*DEF, ast.ClassDef)) else None, "parent_name": parent,
        "start_line": first, "end_line": max(first, last), "content": content, "language": "Python", "is_async": isinstance(node, ast.AsyncFunctionDef),
        "extra_metadata": _meta(node, src) if src else None}


def chunk_python(text: str) -> list[dict]:
    """Chunks of one module: docstring, preamble, functions, classes with their methods, and other statements.

    Comments of their own at the top level count as statements. A text that doesn't parse is cut at its lines that
    begin a definition at the margin; what isn't text at all gives no chunk, and nothing raises.
    """
    src = Source(text)
    try:
        tree = ast.parse(src.text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_margin(src)
    items = [_item(n, src) for n in tree.body]
    spans = [(i.first, i.last) for i in items]
    top = sorted(items + [c for c in src.comments() if not any(a <= c.first <= b for a, b in spans) and not src.lines[c.first[0] - 1][: c.first[1]].strip()], key=lambda i: i.first)
    out: list[dict] = []
    if top and isinstance(top[0].node, ast.Expr) and isinstance(top[0].node.value, ast.Constant) and isinstance(top[0].node.value.value, str):
        doc = top.pop(0)
        out.append(_row("module_docstring", doc.first[0], doc.last[0], src.cut(doc.first, doc.last)))
    body = next((k for k, i in enumerate(top) if isinstance(i.node, (*DEF, ast.ClassDef))), len(top))
    if body:
        out.append(_row("module_preamble", top[0].first[0], top[body - 1].last[0], src.cut(top[0].first, top[body - 1].last)))
    for i in top[body:]:
        if isinstance(i.node, DEF):
            out.append(_row("function", i.first[0], i.last[0], src.cut(i.first, i.last), i.node, None, src))
        elif isinstance(i.node, ast.ClassDef):
            inner = [_item(n, src) for n in i.node.body]
            methods = [m for m in inner if isinstance(m.node, DEF)]
            if methods:
                end = methods[0].first
                out.append(_row("class", i.first[0], end[0] - 1, src.cut(i.first, end).rstrip(), i.node, None, src))
                out += [_row("method", m.first[0], m.last[0], src.cut(m.first, m.last), m.node, i.node.name, src) for m in methods]
            else:
                out.append(_row("class", i.first[0], i.last[0], src.cut(i.first, i.last), i.node, None, src))
        else:
            content = src.cut(i.first, i.last)
            if content.strip() not in ("", "pass", "..."):
                out.append(_row("top_level_block", i.first[0], i.last[0], content))
    return out


def _by_margin(src: Source) -> list[dict]:
    """For a module that doesn't parse: a chunk for each definition at the margin that does on its own."""
    heads = [k for k, x in enumerate(src.lines, 1) if re.match(rb"(async\s+def|def|class)\s+\w+", x)]
    out = []
    for a, b in zip(heads, [*heads[1:], len(src.lines) + 1]):
        block = src.cut((a, 0), (b - 1, len(src.lines[b - 2]))).rstrip()
        try:
            node = ast.parse(block).body[0]
        except (SyntaxError, ValueError, IndexError):
            continue
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        out.append(_row(kind, a, a + node.end_lineno - 1, block, node))
    return out


def _unsupported(language: str) -> Callable[[str], list[dict]]:
    def chunk(text: str) -> list[dict]:
        raise NotImplementedError(f"no chunker for {language}")

    return chunk


CHUNKERS: dict[str, Callable[[str], list[dict]]] = {"python": chunk_python} | {x: _unsupported(x) for x in ("typescript", "javascript", "go", "rust")}


def chunker_for(language: str | None) -> Callable[[str], list[dict]] | None:
    return CHUNKERS.get((language or "").lower())


def chunk_files(files: DataFrame) -> DataFrame:
    """repo_id, file_id and the chunks of files (repo_id, file_id, language, text). A file that fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                try:
                    rows += [{"repo_id": r.repo_id, "file_id": r.file_id} | c for c in chunker_for(r.language)(r.text or "")]
                except Exception:  # noqa: BLE001, S112  one file never stops a scan
                    continue
            yield pd.DataFrame(rows, columns=["repo_id", "file_id", "chunk_type", "name", "parent_name", "start_line", "end_line", "content", "language", "is_async", "extra_metadata"])

    known = files.where(F.lower("language").isin(*CHUNKERS)).select("repo_id", "file_id", "language", "text")
    out = known.mapInPandas(run, f"repo_id long, file_id long, {CHUNK}")
    # ids from natural keys: the same on every run
    return out.withColumn("chunk_id", F.xxhash64("repo_id", "file_id", "start_line", "end_line", "chunk_type", "name", "parent_name"))
