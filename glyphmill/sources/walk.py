"""Walking folders of source files, with ignore files, and reading them as a data source."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from glyphmill.session import ship
from glyphmill.sources.languages import detect, extensions_for

MOST_BYTES = 1_000_000
IGNORE_FILES = (".gitignore", ".glyphmillignore")
#: Folders that hold no sources of their own.
IGNORED = tuple(sorted(f"{d}/" for d in (
    "__pycache__", "node_modules", "build", "dist", "venv", ".venv", ".tox", ".eggs", ".next", ".cache", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".git", ".hg", ".svn", ".glyphmill",
)))


class Pattern(NamedTuple):
    """A line of an ignore file."""

    regex: re.Pattern
    negated: bool
    folders: bool
    has_ext: bool

    def matches(self, path: str, is_dir: bool) -> bool:
        return (is_dir or not self.folders) and self.regex.search(path) is not None


def suffix(name: str) -> str:
    """The last extension of a path's name, with its dot; none if it only begins with a dot."""
    base = re.split(r"[/\\]", name)[-1]
    at = base.rfind(".")
    return base[at:] if at > 0 else ""


def _bracket(p: str, i: int) -> tuple[str, int]:
    """A character class that begins at i, and where it ends; a lone [ stands for itself."""
    j = i + 1
    if j < len(p) and p[j] in "!^":
        j += 1
    if j < len(p) and p[j] == "]":
        j += 1
    while j < len(p) and p[j] != "]":
        j += 2 if p[j] == "\\" else 1
    if j >= len(p):
        return r"\[", i + 1
    body = p[i + 1 : j]
    no = body[:1] in ("!", "^")
    return "[" + ("^/" if no else "") + body[no:].replace("[", r"\[") + "]", j + 1


@lru_cache(4096)
def compile_line(line: str) -> Pattern | None:
    """One line by the rules of git; None for blanks and comments."""
    text = line.removesuffix("\r")
    if not text.strip() or text.strip().startswith("#"):
        return None
    text = re.sub(r"(?<!\\)\s+\Z", "", text).lstrip() if text.lstrip().startswith("!") else re.sub(r"(?<!\\)\s+\Z", "", text)
    negated = text.startswith("!")
    p = text[negated:]
    if not p:
        return None
    folders = p.endswith("/")
    has_ext = suffix(p.rstrip("/")) != ""
    p = p.rstrip("/") if folders else p
    anchored = "/" in p
    p = p.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i) and (i == 0 or p[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif p[i:] == "**" and (i == 0 or p[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            out += "[^/]*"
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[":
            part, i = _bracket(p, i)
            out += part
        elif p[i] == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(p[i]), i + 1
    try:
        return Pattern(re.compile(rf"\A{'' if anchored else '(?:.*/)?'}{out}\Z", re.S), negated, folders, has_ext)
    except re.error:
        return None


class Spec(NamedTuple):
    """The ignore lines of one folder."""

    base: str
    patterns: tuple[Pattern, ...]

    @classmethod
    def of(cls, base: str, lines: list[str]) -> Spec:
        return cls(base, tuple(p for p in map(compile_line, lines) if p))


def load_spec(folder: str, names: tuple[str, ...] = IGNORE_FILES) -> Spec | None:
    """A folder's ignore files as one; those that can't be read as UTF-8 don't count."""
    lines: list[str] = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", newline="") as f:
                lines += f.read().split("\n")
        except (OSError, UnicodeDecodeError):
            continue
    return Spec.of(folder, lines) if lines else None


def ignored(path: str, is_dir: bool, specs: list[Spec]) -> tuple[bool, bool]:
    """(ignored, found): the last spec that says something decides, and within it the last line.

    A file is found if a negated line with an extension took it back: then its own extension need not be asked for.
    """
    out, found = False, False
    for spec in specs:
        rel = os.path.relpath(path, spec.base).replace(os.sep, "/")
        if rel == "." or rel.startswith("../"):
            continue
        last = next((p for p in reversed(spec.patterns) if p.matches(rel, is_dir)), None)
        if last is not None:
            out = not last.negated
            found = last.negated and last.has_ext
    return out, found


def walk(root: str, extensions: list[str], extra: tuple[str, ...] = (), names: tuple[str, ...] = IGNORE_FILES) -> Iterator[tuple[str, bool]]:
    """(path, found) of the files below root, depth first by name; symbolic links aren't followed."""
    wanted = {e.lower() for e in extensions}

    def below(folder: str, specs: list[Spec]) -> Iterator[tuple[str, bool]]:
        own = load_spec(folder, names)
        specs = [*specs, own] if own else specs
        try:
            entries = sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name))
        except OSError:
            return
        for e in entries:
            if e.is_symlink():
                continue
            is_dir = e.is_dir(follow_symlinks=False)
            out, found = ignored(e.path, is_dir, specs)
            if out:
                continue
            if is_dir:
                yield from below(e.path, specs)
            elif e.is_file(follow_symlinks=False) and (found or suffix(e.name).lower() in wanted):
                yield e.path, found

    yield from below(root, [Spec.of(root, [*IGNORED, *extra])])


class Files(InputPartition):
    def __init__(self, root: str, paths: list[tuple[int, str, bool]]):
        self.root, self.paths = root, paths


class SourceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.content = tuple(options.get("content", "code").split(","))
        self.per = int(options.get("files", "256"))
        self.most = int(options.get("bytes", str(MOST_BYTES)))
        self.names = tuple(options.get("ignore", ",".join(IGNORE_FILES)).split(","))

    def partitions(self) -> list[Files]:
        found = [(n, p, f) for n, (p, f) in enumerate(walk(self.root, extensions_for(self.content), names=self.names))]
        return [Files(self.root, found[at : at + self.per]) for at in range(0, len(found), self.per)] or [Files(self.root, [])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for n, path, found in partition.paths:
            try:
                size = os.path.getsize(path)
                if size > self.most:
                    continue
                with open(path, "rb") as f:
                    data = f.read()
            except OSError:
                continue
            yield n, os.path.relpath(path, partition.root).replace(os.sep, "/"), bytearray(data), size, found


class SourceTree(DataSource):
    """``spark.read.format("source_tree").option("content", "code,docs").load(folder)``.

    The driver walks; executors read. Unlike ``binaryFile`` it has files whose names begin
    with a dot or an underscore. Options: content, files (per partition), bytes (the largest file), ignore.
    """

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "ord long, path string, bytes binary, length long, found boolean"

    def reader(self, schema) -> SourceReader:
        return SourceReader(self.options)


def files(spark: SparkSession, root: str, content: tuple[str, ...] = ("code",), **options: str) -> DataFrame:
    """``(ord, path, bytes, length, found)`` of a folder; ``ord`` is the order of the walk."""
    ship(spark)
    spark.dataSource.register(SourceTree)
    return spark.read.format("source_tree").options(content=",".join(content), **options).load(root)


def decoded(rows: DataFrame) -> DataFrame:
    """``(ord, file_path, text, language)``; bytes that aren't UTF-8 become replacement characters."""

    @F.pandas_udf("string")
    def decode(b: pd.Series) -> pd.Series:
        return b.map(lambda x: bytes(x).decode("utf-8", "replace"))

    return detect(rows.select("ord", F.col("path").alias("file_path"), decode("bytes").alias("text")))
