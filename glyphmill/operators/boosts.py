"""Boosts of candidates: files with several hits, definitions of symbols, and names of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphmill.functions.paths import identifiers, stem
from glyphmill.operators.lookup import passes
from glyphmill.session import stash

COHERENCE, DEFINITION, EMBEDDED, STEM = 0.2, 3.0, 0.5, 1.0
STEM_MIN, RATIO_MIN = 4, 0.10

#: Words that introduce a definition, by how languages use them.
KEYWORDS = sorted(
    ["abstract class", "data class", "class", "interface", "trait", "protocol", "object", "record", "struct", "enum", "type", "typedef"]
    + ["def", "fn", "fun", "func", "function"]
    + ["defmodule", "module", "namespace", "package"]
)
SQL_KEYWORDS = [f"CREATE {x}" for x in ("FUNCTION", "PROCEDURE", "TABLE", "VIEW")]
STOPWORDS = sorted(set("who what when where which why how a an the this is are was be do does has have by as at in on of or to and if it for from not with".split()) - {"this"})

SYMBOL = r"^(?:[A-Za-z_][0-9A-Za-z_]*(?:(?:::|\\|->|\.)[A-Za-z_][0-9A-Za-z_]*)+|_[0-9A-Za-z_]*|[A-Za-z][a-z0-9]*[_A-Z][0-9A-Za-z_]*|[A-Z][0-9A-Za-z]*)\z"
IN_TEXT = r"\b(?:[A-Z][a-z][a-z0-9]*[A-Z][A-Za-z0-9]*|[a-z][a-z0-9]*[A-Z][A-Za-z0-9]+)\b"
WORD = "[A-Za-z_][A-Za-z0-9_]*"

HEAD = r"(?:^|(?<=\s))(?:{words})\s+(?:[A-Za-z_]\w*(?:\.|::))*"
TAIL = r"(?:\s|[<({:\[;]|$)"


def trimmed(query: Column) -> Column:
    return F.regexp_replace(query, r"^(?U)\s+|(?U)\s+\z", "")


def is_symbol(query: Column) -> Column:
    """Whether a query is a bare or qualified identifier."""
    return trimmed(query).rlike(SYMBOL)


def symbol_name(query: Column) -> Column:
    """The last part of a qualified name; the first separator of ::, \\, ->, . that occurs decides."""
    out = trimmed(query)
    for sep in (".", "->", "\\", "::"):
        out = F.when(query.contains(sep), F.substring_index(query, sep, -1)).otherwise(out)
    return out


def escaped(name: Column) -> Column:
    return F.regexp_replace(name, r"([.*+?^${}()|\[\]\\])", r"\\$1")


def defines(content: Column, name: Column) -> Column:
    """Whether a text has a definition of the name: a keyword, an optional qualifier, then the name."""
    n = escaped(name)
    code = F.concat(F.lit("(?Udm)" + HEAD.format(words="|".join(KEYWORDS))), n, F.lit(TAIL))
    ddl = F.concat(F.lit("(?Uidm)" + HEAD.format(words="|".join(SQL_KEYWORDS))), n, F.lit(TAIL))
    # what a match must hold is looked for first: few texts get to the patterns, which differ from row to row
    return (content.contains(name) & F.regexp_like(content, code)) | (F.lower(content).contains("create") & F.regexp_like(content, ddl))


def bare(s: Column) -> Column:
    return F.replace(s, F.lit("_"), F.lit(""))


def stem_forms(stem_low: Column) -> Column:
    """The spellings under which a file stem answers to a name: as it is, without _, without final s."""
    return F.array_distinct(F.array(stem_low, bare(stem_low), F.rtrim(stem_low, F.lit("s")), F.rtrim(bare(stem_low), F.lit("s"))))


def query_spec(queries: DataFrame) -> DataFrame:
    """The queries with all that boosts need to know of their texts.

    ``symbol``; ``alpha`` (0.3 for symbols, else 0.5, where it is null); ``names`` whose
    definitions count; ``scale`` of those; ``look`` for stems of files that aren't
    candidates; ``words`` for matching with file names.
    """
    text = F.col("text")
    embedded = F.array_distinct(F.regexp_extract_all(text, F.lit(IN_TEXT), F.lit(0)))
    name, whole = symbol_name(text), trimmed(text)
    words = F.array_distinct(F.transform(F.filter(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(STOPWORDS)), F.lower))
    none = F.array().cast("array<string>")
    return queries.withColumn("symbol", is_symbol(text)).select(
        "*",
        F.coalesce(F.col("alpha"), F.when(F.col("symbol"), 0.3).otherwise(0.5)).alias("__alpha"),
        F.when(F.col("symbol"), F.array_distinct(F.array(name, whole))).otherwise(embedded).alias("names"),
        F.when(F.col("symbol"), DEFINITION).otherwise(DEFINITION * EMBEDDED).alias("scale"),
        F.when(F.col("symbol"), F.array(F.lower(name))).otherwise(F.transform(embedded, F.lower)).alias("look"),
        F.when(F.col("symbol"), none).otherwise(words).alias("words"),
    ).drop("alpha").withColumnRenamed("__alpha", "alpha")


def file_coherence(cand: DataFrame) -> DataFrame:
    """The best chunk of every file gains by the file's share of the largest sum of scores."""
    by_query = Window.partitionBy("query_id")
    by_file = Window.partitionBy("query_id", "file_path")
    # folded in order, so that sums don't depend on where rows come from
    parts = F.array_sort(F.collect_list(F.struct("ord", "score")).over(by_file))
    rows = cand.withColumn("file_sum", F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["score"])).withColumn("best", F.row_number().over(by_file.orderBy(F.desc("score"), "ord")))
    rows = rows.withColumn("top", F.max("score").over(by_query)).withColumn("top_sum", F.max("file_sum").over(by_query))
    gain = COHERENCE * F.col("top") * F.col("file_sum") / F.col("top_sum")
    return rows.withColumn("score", F.when((F.col("best") == 1) & (F.col("top") != 0) & (F.col("top_sum") > 0), F.col("score") + gain).otherwise(F.col("score"))).select(*cand.columns)


def tier(hit: Column, stem_low: Column, names: Column, unit: Column) -> Column:
    """What defining one of the names is worth: the unit, and half more in a file named like one."""
    forms = stem_forms(stem_low)
    named = F.exists(names, lambda n: F.array_contains(forms, F.lower(n)))
    return F.when(hit, F.when(named, unit * 1.5).otherwise(unit)).otherwise(0.0)


def keyword_matches(words: Column, parts: Column) -> Column:
    """How many words are a part of the name, or share a beginning of 3 bytes or more with one."""
    def near(w: Column, p: Column) -> Column:
        return (w == p) | ((F.least(F.octet_length(w), F.octet_length(p)) >= 3) & (w.startswith(p) | p.startswith(w)))

    return F.size(F.filter(words, lambda w: F.exists(parts, lambda p: near(w, p))))


def word_share(rows: DataFrame) -> DataFrame:
    """The rows with ``ratio``, the share of their ``words`` that ``file_path`` answers; 0 without words.

    An exploded value is worked out once: the path's parts not for each word again, the share not for each use.
    """
    parts = rows.select("*", F.explode(F.array(identifiers(F.col("file_path")))).alias("parts"))
    share = F.when(F.size("words") > 0, keyword_matches(F.col("words"), F.col("parts")) / F.size("words")).otherwise(0.0)
    return parts.select("*", F.explode(F.array(share)).alias("ratio")).drop("parts")


def definers(pairs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(of_chunk, name)`` of the different ``(chunk_id, name)`` whose chunk defines the name, each looked at once.

    The patterns run where contents are: pairs go to the chunks, not contents to the pairs.
    """
    text = chunks.select(F.col("chunk_id").alias("of_chunk"), "content")
    full = text.join(pairs.select("chunk_id", "name").distinct(), F.col("of_chunk") == F.col("chunk_id"))
    # an exploded value can't be pulled into a filter, and so isn't worked out twice
    return full.select("of_chunk", "name", F.explode(F.array(defines(F.col("content"), F.col("name")))).alias("hit")).filter("hit").select("of_chunk", "name")


def query_boost(cand: DataFrame, spec: DataFrame, chunks: DataFrame, filtered: bool = False) -> DataFrame:
    """Candidates after the boosts for their query, and chunks that its names bring in.

    A symbol query lifts chunks that define it. Others lift chunks of files named like
    their words, and chunks that define a symbol that they mention. Chunks of a fitting file that define
    a name come in although no ranking has them; with ``filtered`` the queries' filters restrict these.
    """
    q = spec.select("query_id", "names", "scale", "look", "words", "symbol")
    low = F.lower(stem(F.col("file_path")))
    # what names could bring in: files are found by the spellings of their stems, not by a scan for each query
    long_ = lambda s: F.octet_length(s) >= STEM_MIN
    prefixes = lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda n: F.substring(s, F.lit(1), n))
    keys = F.when(F.col("symbol"), F.col("look")).otherwise(F.array_distinct(F.flatten(F.transform("look", lambda s: F.filter(prefixes(s), lambda p: (p == s) | long_(p))))))
    want = q.filter(F.size("look") > 0).select("query_id", "symbol", F.explode(keys).alias("key"))
    spelt = F.when(F.lit(True), stem_forms(low))
    stems = chunks.select("chunk_id", "file_path", *(["language"] if filtered else []), F.explode(spelt).alias("key"), F.array(low, bare(low)).alias("plain"))
    fits = F.col("symbol") | F.array_contains("plain", F.col("key"))
    found = stems.join(want, "key").filter(fits)
    if filtered:
        own = spec.select(F.col("query_id").alias("of_query"), "filter_languages", "filter_paths")
        found = found.join(own, F.col("query_id") == F.col("of_query")).filter(passes(F.col("language"), F.col("file_path"), F.col("filter_languages"), F.col("filter_paths")))
    found = found.select("query_id", "chunk_id", "file_path").distinct()
    # after all candidates, in the order of chunks
    found = found.withColumn("score", F.lit(None).cast("double")).withColumn("ord", F.col("chunk_id") + (1 << 40)).withColumn("new", F.lit(True))
    rows = stash(cand.select("query_id", "chunk_id", "file_path", "score", "ord").withColumn("new", F.lit(False)).unionByName(found), "candidates")
    # which of them define a name of their query
    named = rows.join(q.filter(F.size("names") > 0).select("query_id", F.explode("names").alias("name")), "query_id").select("query_id", "chunk_id", "name")
    known = definers(named, chunks)
    hits = named.join(known.withColumnRenamed("name", "defined"), (F.col("chunk_id") == F.col("of_chunk")) & (F.col("name") == F.col("defined"))).select(F.col("query_id").alias("hq"), F.col("chunk_id").alias("hc")).distinct().withColumn("hit", F.lit(True))
    # windows tell the best score of a query, and which chunks are new to it
    by_query, by_pair = Window.partitionBy("query_id"), Window.partitionBy("query_id", "chunk_id")
    rows = rows.withColumn("known", ~F.min("new").over(by_pair)).filter(~(F.col("new") & F.col("known")))
    rows = rows.withColumn("top", F.max("score").over(by_query)).filter("top is not null").join(q, "query_id")
    rows = rows.join(hits, (F.col("query_id") == F.col("hq")) & (F.col("chunk_id") == F.col("hc")), "left")
    rows = word_share(rows)
    like = F.when(F.col("ratio") >= RATIO_MIN, F.col("top") * STEM * F.col("ratio")).otherwise(0.0)
    worth = tier(F.coalesce("hit", F.lit(False)), low, F.col("names"), F.col("top") * F.col("scale"))
    rows = rows.withColumn("worth", worth).filter("not new or worth <> 0")
    score = F.when(F.col("new"), F.col("worth")).otherwise(F.col("score") + like + F.col("worth"))
    return rows.select("query_id", "chunk_id", "file_path", score.alias("score"), "ord")
