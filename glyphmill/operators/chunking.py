"""Chunking: source text into line-addressed chunks."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glyphmill.session import ship

CHUNK, SHORT, DEEP = 750, 50, 500
LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
LINE_BYTES = re.compile(LINE.pattern.encode())
Span = tuple[int, int]


def pack(spans: list[Span], most: int = CHUNK) -> list[Span]:
    """Join neighbours while their own lengths add up to at most ``most``; gaps between them don't count."""
    out: list[list[int]] = []
    held = 0
    for a, b in spans:
        n = max(0, b - a)
        if out and held + n <= most:
            out[-1][1] = b
            held += n
        else:
            out.append([a, b])
            held = n
    return [(a, b) for a, b in out]


def line_spans(text: str, most: int = CHUNK) -> list[Span]:
    """Whole lines packed; a line that is too long stays whole. Blank text has none."""
    return pack([m.span() for m in LINE.finditer(text)], most) if text.strip() else []


class Node:
    """A node of a syntax tree: its bytes and its children."""

    def __init__(self, start: int, end: int, children: list[Node] | None = None):
        self.start, self.end, self.children = start, end, children or []


def node_spans(node: Node, most: int = CHUNK, depth: int = 0) -> list[Span]:
    """Runs of children that fit, and what a child that doesn't fit falls into."""
    if not node.children or depth > DEEP or node.end - node.start < SHORT:
        return [(node.start, node.end)]
    out: list[Span] = []
    run: list[int] | None = None
    for child in node.children:
        n = max(0, child.end - child.start)
        if run and run[2] + n <= most:
            run[1], run[2] = child.end, run[2] + n
            continue
        if run:
            out.append((run[0], run[1]))
            run = None
        if n > most:
            out += node_spans(child, most, depth + 1)
        else:
            run = [child.start, child.end, n]
    if run:
        out.append((run[0], run[1]))
    return out


def filled(spans: list[Span], data: bytes) -> list[Span]:
    """The spans, with all text between them but white space: the rest of a span's line goes with it, each other line is a span."""
    out: list[Span] = []
    at = 0
    for a, b in [*spans, (len(data), len(data))]:
        for m in LINE_BYTES.finditer(data, at, max(at, a)):
            line = m.group()
            if not line.strip():
                continue
            end = m.start() + len(line.rstrip())
            if out and m.start() == at:
                out[-1] = (out[-1][0], end)
            else:
                out.append((m.end() - len(line.lstrip()), end))
        if b > a:
            out.append((a, b))
        at = max(at, b)
    return out


def python_tree(text: str) -> Node | None:
    """The statements of Python source as a tree over its bytes; None if it can't be parsed."""
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    data = text.encode()
    starts = [0]
    for line in re.findall(rb"[^\r\n]*(?:\r\n|\n|\r)", data):
        starts.append(starts[-1] + len(line))

    def build(n: ast.AST, depth: int = 0) -> Node:
        lines = [d.lineno for d in getattr(n, "decorator_list", [])] + [n.lineno]
        a, b = starts[min(lines) - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset
        kids = [build(c, depth + 1) for c in ast.iter_child_nodes(n) if isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case)) and hasattr(c, "lineno")] if depth < DEEP else []
        if kids and kids[0].start > a:  # what comes before the body: the signature
            kids = [Node(a, kids[0].start), *kids]
        return Node(a, b, kids)

    return Node(0, len(data), [build(c) for c in tree.body])


#: Parsers by language; more can be put in. Each gives a tree over bytes, or None.
PARSERS: dict[str, Callable[[str], Node | None]] = {"python": python_tree}


def is_supported(language: str | None) -> bool:
    return language in PARSERS


def tree_spans(text: str, language: str, most: int = CHUNK) -> list[Span] | None:
    """Spans of characters by syntax, with comments and all else between statements; None without a parser or a tree."""
    if not text.strip():
        return []
    tree = PARSERS[language](text) if language in PARSERS else None
    if tree is None:
        return None
    data = text.encode()
    char = lambda b: len(data[: min(max(b, 0), len(data))].decode("utf-8", "ignore"))
    return [(char(a), char(b)) for a, b in pack(filled(node_spans(tree, most), data), most)]


def chunk_source(text: str, path: str, language: str | None, most: int = CHUNK) -> Iterator[tuple[str, str, int, int, str | None]]:
    """(content, path, first line, last line, language) of each chunk; lines go from 1 and end with line feeds."""
    if not text.strip():
        return
    spans = tree_spans(text, language, most) if is_supported(language) else None
    at, line = 0, 1
    for a, b in line_spans(text, most) if spans is None else spans:
        last = max(b - 1, a)
        line += text.count("\n", at, a) if a > at else 0
        at = max(at, a)
        first = line
        line += text.count("\n", at, last) if last > at else 0
        at = max(at, last)
        yield text[a : last + 1], path, first, line, language


def chunk_files(files: DataFrame, most: int = CHUNK, syntax: bool = True) -> DataFrame:
    """``(file_path, ord, content, start_line, end_line, language)`` of ``(file_path, text, language)``.

    Arrow batches; a file is chunked where it is read. Blank files give no chunks.
    """
    ship(files.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                rows = []
                for path, text, lang in zip(*(c.to_pylist() for c in b.slice(at, 256).columns)):
                    for k, (content, _, a, z, _) in enumerate(chunk_source(text or "", path, lang if syntax else None, most)):
                        rows.append((path, k, content, a, z, lang))
                if rows:
                    kinds = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], ["file_path", "ord", "content", "start_line", "end_line", "language"])

    return files.select("file_path", "text", "language").mapInArrow(run, "file_path string, ord int, content string, start_line long, end_line long, language string")
