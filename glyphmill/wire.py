"""Chunks and results as JSON, in the names of the wire format, and back with every field looked at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.paths import location

#: The wire's names of a chunk's columns, in order.
CAMEL = {"content": "content", "file_path": "filePath", "start_line": "startLine", "end_line": "endLine", "language": "language"}
LINES = 1 << 32


def chunk_struct() -> Column:
    """A chunk's columns under the wire's names, with its location; a language that is null stays in."""
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    return F.struct(*(F.col(c).alias(n) for c, n in CAMEL.items()), place.alias("location"))


def chunk_json() -> Column:
    """A chunk as a JSON object."""
    return F.to_json(chunk_struct(), {"ignoreNullFields": "false"})


def result_json(score: Column) -> Column:
    """A result as a JSON object of its chunk and score."""
    return F.to_json(F.struct(chunk_struct().alias("chunk"), score.alias("score")), {"ignoreNullFields": "false"})


def payloads(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(query_id, payload)``: all results of each query ``(query_id, text)`` as one object, best first.

    ``results`` have a chunk's columns, ``rank`` and ``score``; a query without results has an empty list.
    """
    place = location(F.col("file_path"), F.col("start_line"), F.col("end_line"))
    one = F.struct(F.struct(*CAMEL, place.alias("location")).alias("chunk"), "score")
    lists = results.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("r")))), lambda x: x["r"]).alias("results"))
    full = queries.select("query_id", F.col("text").alias("query")).join(lists, "query_id", "left")
    none = F.expr("cast(array() as " + dict(lists.dtypes)["results"] + ")")
    return full.select("query_id", F.to_json(F.struct("query", F.coalesce("results", none).alias("results")), {"ignoreNullFields": "false"}).alias("payload"))


def parsed(rows: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """``keep``, the columns of a chunk, and ``error``, from the JSON texts of a column.

    ``error`` names the first thing that is wrong (then the chunk's columns are null), else it is null. A location is never
    trusted; a missing language is null. Lines are whole numbers of 32 bits; unknown fields don't matter.
    """
    v = F.try_parse_json(F.col(json_col))
    kind = lambda name: F.coalesce(F.schema_of_variant(F.try_variant_get("__v", f"$.{name}", "variant")), F.lit("none"))
    # a field that is there but null is of type void
    text = lambda name: F.when(kind(name) != "STRING", F.lit(f"{name} is no string"))
    line = lambda name: F.when((kind(name) != "BIGINT") | ~F.coalesce(F.try_variant_get("__v", f"$.{name}", "bigint").between(0, LINES - 1), F.lit(False)), F.lit(f"{name} is no line"))
    whole = F.when(F.col("__v").isNull() | ~F.coalesce(F.schema_of_variant("__v"), F.lit("")).startswith("OBJECT"), F.lit("no object"))
    lang = F.when(~kind("language").isin("STRING", "VOID", "none"), F.lit("language is no string"))
    error = F.coalesce(whole, text("content"), text("filePath"), line("startLine"), line("endLine"), lang)
    base = rows.select(*keep, v.alias("__v")).withColumn("error", error)
    ok = F.col("error").isNull()
    get = lambda name, t: F.when(ok, F.try_variant_get("__v", f"$.{name}", t))
    return base.select(*keep, *(get(n, "bigint" if c.endswith("_line") else "string").alias(c) for c, n in CAMEL.items()), "error")


def checked(rows: DataFrame, json_col: str, *keep: str) -> DataFrame:
    """:func:`parsed` chunks; the first one that is wrong is an error when rows are read."""
    out = parsed(rows, json_col, *keep)
    return out.withColumn("content", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("Invalid chunk: "), "error"))).otherwise(F.col("content"))).drop("error")
