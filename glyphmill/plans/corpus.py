"""Chunks and queries over the tables of a data folder, for queries that need a corpus.

A document is a chunk. Its id decides the file it is part of, so that files of
all kinds of paths hold up to four chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import table

STEMS = ("handler_stack", "parse_config", "config_parser", "client", "cache_layer", "state_manager", "session", "router")
PATHS = ("src/g%d/%s.py", "tests/g%d/test_%s.py", "examples/g%d/%s.ts", "legacy/g%d/%s.go", "docs_src/g%d/%s.rb", "src/g%d/%s.d.ts", "pkg/g%d/__init__.py", "examples/g%d/%s_test.go")
LANGUAGES = ("python", "python", "typescript", "go", "ruby", "typescript", "python", "go")
#: Symbol and free-text queries beside the passages of ``benchmark``: (id, text, alpha).
ASKED = (
    (100001, "HandlerStack", None), (100002, "parse_config", None), (100003, "where does the HandlerStack keep state", None), (100004, "find the cache layer client", None),
    (100005, "config::parse_config", None), (100006, "session router", 1.0), (100007, "HandlerStack", 0.0), (100008, "  ", None),
)


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    """``(chunk_id, content, file_path, start_line, end_line, language)``."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    c, g, i = F.pmod("doc_id", F.lit(8)), F.floor(F.col("doc_id") / 32), F.pmod(F.floor(F.col("doc_id") / 8), F.lit(4))
    stem = F.element_at(F.array(*map(F.lit, STEMS)), (F.pmod(g, F.lit(8)) + 1).cast("int"))
    path = F.element_at(F.array(*(F.format_string(p, g, stem) if "%s" in p else F.format_string(p, g) for p in PATHS)), (c + 1).cast("int"))
    head = F.when(F.pmod("doc_id", F.lit(11)) == 3, "class HandlerStack\n").when(F.pmod("doc_id", F.lit(11)) == 5, "def parse_config(x)\n").otherwise("")
    lang = F.element_at(F.array(*map(F.lit, LANGUAGES)), (c + 1).cast("int"))
    return d.select(F.col("doc_id").alias("chunk_id"), F.concat(head, F.col("text")).alias("content"), path.alias("file_path"), (1 + 40 * i).cast("long").alias("start_line"), (40 + 40 * i).cast("long").alias("end_line"), lang.alias("language"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """``(chunk_id, v)``."""
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("v"))


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """``(query_id, text, alpha, v)``: the benchmark's passages and ASKED, with vectors from the table."""
    own = spark.createDataFrame(list(ASKED), "query_id long, text string, alpha double").coalesce(1)  # eight rows
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text", F.lit(None).cast("double").alias("alpha")).unionByName(own)
    return q.join(vectors(spark, sf).select(F.col("chunk_id").alias("vid"), "v"), F.pmod("query_id", F.lit(500)) == F.col("vid"), "left").drop("vid")


def _case(values, key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_STEM = "(" + _case([f"'{s}'" for s in STEMS], "(doc_id // 32) % 8") + ")"
_PATH = _case(["'" + p.replace("%d", "' || (doc_id // 32) || '").replace("%s", f"' || {_STEM} || '") + "'" for p in PATHS], "doc_id % 8")
CHUNKS = f"""chunks AS (SELECT doc_id AS chunk_id, CASE doc_id % 11 WHEN 3 THEN 'class HandlerStack' || chr(10) WHEN 5 THEN 'def parse_config(x)' || chr(10) ELSE '' END || text AS content,
 {_PATH} AS file_path, 1 + 40 * ((doc_id // 8) % 4) AS start_line, 40 + 40 * ((doc_id // 8) % 4) AS end_line, {_case([f"'{x}'" for x in LANGUAGES], "doc_id % 8")} AS language FROM documents)"""
_ASKED = ", ".join(f"({i}, '{t}', {'NULL' if a is None else a})" for i, t, a in ASKED)
QUERIES = f"""asked AS (SELECT item_id AS query_id, text, CAST(NULL AS DOUBLE) AS alpha FROM benchmark UNION ALL SELECT * FROM (VALUES {_ASKED}) AS t(query_id, text, alpha))"""
