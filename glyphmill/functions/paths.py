"""Parts of file paths and what they say about a file, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STRONG, MODERATE, MILD = 0.3, 0.5, 0.7

#: Per language: name prefixes, name suffixes, and extensions of test files.
_TESTS = (
    (("test_",), ("_test",), ("py", "cpp", "c", "dart", "lua")),
    ((), ("_test",), ("go", "rb")),
    ((), ("_spec",), ("rb", "lua")),
    ((), ("Test", "Tests"), ("java", "kt", "swift", "cs")),
    ((), ("Test",), ("php", "scala")),
    ((), ("Spec",), ("kt", "swift", "scala")),
    ((), ("Suite",), ("scala",)),
    ((), (r"\.test", r"\.spec"), ("js", "jsx", "ts", "tsx")),
)


def _test_file() -> str:
    alternatives = []
    for before, after, ext in _TESTS:
        tail = rf"\.(?:{'|'.join(ext)})"
        alternatives += [f"{b}[^/]*{tail}" for b in before] + [f"[^/]*{a}{tail}" for a in after]
    return r"(?:^|/)(?:" + "|".join(alternatives) + r"|test_helper[^/]*\.\w+)"


TEST_FILE = _test_file()
TEST_DIR = "(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|{end})"
LEGACY_DIR = "(?:^|/)(?:_?compat|legacy)(?:/|{end})"
EXAMPLE_DIR = "(?:^|/)(?:_?examples?|docs?_src)(?:/|{end})"


def base(path: Column) -> Column:
    """The last part of a path, with either slash."""
    return F.regexp_extract(path, r"([^/\\]*)\z", 1)


def stem(path: Column) -> Column:
    """The file name without its last extension; a name that only begins with a dot stays whole."""
    b = base(path)
    return F.when(b.rlike(r"^.+\.[^.]*\z"), F.regexp_extract(b, r"^(.+)\.[^.]*\z", 1)).otherwise(b)


def parent(path: Column) -> Column:
    """The name of the folder that holds the file; empty without one."""
    clean = F.regexp_replace(path, r"[/\\]+\z", "")
    return F.regexp_extract(clean, r"([^/\\]*)[/\\][^/\\]*\z", 1)


def extension(path: Column) -> Column:
    """The last extension with its dot, in lower case; null without one."""
    e = F.regexp_extract(base(path), r"^.+(\.[^.]*)\z", 1)
    return F.when(e != "", F.lower(e))


def location(path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s:%d-%d", path, start, end)


def penalty(path: Column) -> Column:
    """How much a path speaks against its chunks: the product of all rules that apply."""
    p = F.translate(path, "\\", "/")
    when = lambda hit, factor: F.when(hit, factor).otherwise(1.0)
    name = F.regexp_extract(path, r"([^/]*)\z", 1)  # only / parts it here
    return (
        when(p.rlike(TEST_FILE + r"\z") | p.rlike(TEST_DIR.format(end=r"\z")), STRONG)
        * when(name.isin("__init__.py", "package-info.java"), MODERATE)
        * when(p.rlike(LEGACY_DIR.format(end=r"\z")), STRONG)
        * when(p.rlike(EXAMPLE_DIR.format(end=r"\z")), STRONG)
        * when(p.rlike(r"\.d\.ts\z"), MILD)
    )


def enrich(content: Column, path: Column) -> Column:
    """A chunk's text for the inverted index: the stem twice and the last three folders after it."""
    p = F.translate(path, "\\", "/")
    dirs = F.filter(F.split(F.regexp_replace(p, r"[^/]*\z", ""), "/"), lambda x: (x != "") & (x != "."))
    last = F.slice(dirs, F.greatest(F.size(dirs) - 2, F.lit(1)), 3)
    s = stem(p)
    return F.concat(F.coalesce(content, F.lit("")), F.lit(" "), s, F.lit(" "), s, F.lit(" "), F.array_join(last, " "))


def identifiers(path: Column) -> Column:
    """The distinct identifier parts of a file's stem and its folder's name."""
    from .tokens import split_identifier

    folder = parent(path)
    more = F.when(folder.isin("", ".", "..", "/"), F.array().cast("array<string>")).otherwise(split_identifier(folder))
    return F.array_distinct(F.concat(split_identifier(stem(path)), more))
