"""Usage records and the report on what searches save over reading whole files."""

from __future__ import annotations

import json
import math
import os
import sys
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.text import utc_day, utf16_length

SCHEMA = "ts double, call string, results long, snippet_chars long, file_chars long"
BUCKETS = ("Today", "Last 7 days", "All time")
CALLS = ("search", "find_related")


def home() -> str:
    return os.path.join(os.environ.get("HOME") or os.environ.get("USERPROFILE") or ".", ".glyphmill")


def default_file() -> str:
    return os.path.join(home(), "savings.jsonl")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON-lines file or folder. Malformed lines and those without a number as time are left out; no file, no rows."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA + ", bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)
    full = F.col("bad").isNull() & ~F.isnan("ts")
    for c in ("ts", "call", "results", "snippet_chars", "file_chars"):
        full &= F.col(c).isNotNull()
    return rows.filter(full).drop("bad")


def bucket(day: Column, now: float) -> dict[str, Column]:
    """Which buckets a day belongs to. They overlap; the week is the days after the one a week ago."""
    return {"Today": day == utc_day(F.lit(now)), "Last 7 days": day > utc_day(F.lit(now - 7 * 86400.0)), "All time": F.lit(True)}


def summary(records: DataFrame, now: float) -> DataFrame:
    """``(bucket, calls, snippet_chars, file_chars, saved_chars)``, a row for every bucket.

    One pass: all buckets are conditional sums of one aggregation. A record saves
    what the files have beyond the snippets, 0 at least.
    """
    saved = F.greatest(F.col("file_chars") - F.col("snippet_chars"), F.lit(0))
    rows = records.select(utc_day(F.col("ts")).alias("day"), "snippet_chars", "file_chars", saved.alias("saved_chars"))
    sums = []
    for name, hit in bucket(F.col("day"), now).items():
        total = lambda c: F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).alias(c)  # noqa: B023, E731
        sums.append(F.struct(F.lit(name).alias("bucket"), F.count_if(hit).alias("calls"), total("snippet_chars"), total("file_chars"), total("saved_chars")))
    return rows.agg(F.array(*sums).alias("b")).select(F.inline("b"))


def by_call(records: DataFrame) -> DataFrame:
    """``(call, calls)``; whatever the call is named."""
    return records.groupBy("call").agg(F.count("*").alias("calls"))


def derived(summed: DataFrame) -> DataFrame:
    """The summary with ``saved_tokens`` (4 characters each) and the rounded ``pct`` of the files' characters."""
    pct = F.when(F.col("file_chars") > 0, F.round(F.col("saved_chars") / F.col("file_chars") * 100)).otherwise(0)
    return summed.withColumn("saved_tokens", F.floor(F.col("saved_chars") / 4)).withColumn("pct", pct.cast("long"))


def record(results: DataFrame, sizes: DataFrame, call: str, now: float | None = None) -> DataFrame:
    """One record of a search's results ``(content, file_path)`` and the sizes ``(file_path, chars)`` of files.

    Snippets count in UTF-16 units; every file counts once, unknown ones with 0.
    """
    snippets = results.agg(F.count("*").alias("results"), F.coalesce(F.sum(utf16_length(F.col("content"))), F.lit(0)).alias("snippet_chars"))
    files = results.select("file_path").distinct().join(sizes, "file_path", "left").agg(F.coalesce(F.sum("chars"), F.lit(0)).cast("long").alias("file_chars"))
    ts = time.time() if now is None else now
    return snippets.crossJoin(files).select(F.lit(float(ts)).alias("ts"), F.lit(call).alias("call"), "results", "snippet_chars", "file_chars")


def append(records: DataFrame, path: str) -> None:
    """Add records to a JSON-lines file of this machine; failures don't matter to the search."""
    try:
        os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
        with open(path, "a", encoding="utf-8") as f:
            for r in records.collect():
                f.write(json.dumps(r.asDict()) + "\n")
    except OSError:
        pass


def clear(path: str) -> bool:
    """Delete the records; whether there were any."""
    try:
        os.remove(path)
        return True
    except OSError:
        return False


def use_color() -> bool:
    return "NO_COLOR" not in os.environ and os.environ.get("TERM") != "dumb" and sys.stdout.isatty()


def half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def short(n: int, sign: str = "") -> str:
    return f"{sign}{n / 1e6:.1f}M" if sign and n >= 1_000_000 else f"{sign}{n / 1000:.1f}k" if n >= 1000 else f"{sign}{n}"


def report(spark: SparkSession, path: str, now: float | None = None, verbose: bool = False, color: bool | None = None) -> str:
    """The savings as text, for people."""
    if "://" not in path and not os.path.exists(path):
        return "There is nothing to report before the first search."
    on = use_color() if color is None else color
    paint = lambda code, s: f"\x1b[{code}m{s}\x1b[0m" if on else s
    rate = lambda p: paint("32" if p >= 80 else "33" if p >= 50 else "31", f"{p}%")
    bar = lambda n, of: paint("32", "█" * n) + paint("38;5;244", "░" * (of - n))
    rows = read(spark, path)
    stats = {r.bucket: r for r in derived(summary(rows, time.time() if now is None else now)).collect()}
    heavy, light = (f"  {paint('38;5;244', c * 72)}" for c in "═─")
    top = stats["All time"]
    out = ["", f"  {paint('1;36', 'Token savings')}", heavy, ""]
    out.append(f"  {paint('1', 'Total saved:')}  {paint('1;33', short(top.saved_tokens, '~') + ' tokens')}  ({rate(top.pct)})")
    out.append(f"  {paint('1', 'Total calls:')}  {paint('1;33', short(top.calls))}")
    out.append(f"  {paint('1', 'Efficiency:')}  {bar(min(24, half_up(top.pct / 100 * 24)), 24)}  {rate(top.pct)}")
    out += ["", f"  {paint('1', 'By period')}", light, f"  {'Period':<14}  {'Calls':>8}  {'Saved':>14}  Ratio", light]
    for name in BUCKETS:
        r = stats[name]
        saved = f"{short(r.saved_tokens, '~')} tokens"
        cells = f"  {paint('1', f'{name:<14}')}  {paint('1;33', f'{short(r.calls):>8}')}  {paint('1;33', f'{saved:>14}')}"
        if r.file_chars > 0:
            out.append(f"{cells}  {bar(min(24, half_up(r.saved_chars / r.file_chars * 24)), 24)}  {rate(r.pct)}")
        else:
            out.append(f"{cells}  {bar(0, 24)}  {paint('38;5;244', '–')}")
    calls = sorted(by_call(rows).collect(), key=lambda r: (-r.calls, r.call)) if verbose else []
    if calls:
        total = sum(r.calls for r in calls)
        out += ["", f"  {paint('1', 'By call')}", light, f"  {'#':<4}  {'Call type':<16}  {'Calls':>8}  Share", light]
        for i, r in enumerate(calls, 1):
            share = r.calls / total
            out.append(f"  {paint('38;5;244', f'{i}.'.ljust(4))}  {r.call:<16}  {paint('1;33', f'{short(r.calls):>8}')}  {bar(max(1, min(16, half_up(share * 16))), 16)}  {paint('38;5;244', f'{half_up(share * 100)}%'.rjust(4))}")
    return "\n".join([*out, heavy, ""])
