"""The operators' queries over their whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.session import table


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf, "documents"))


def op2_lz_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's class of similar fingerprints."""
    from .fingerprints import similar_classes

    return similar_classes(table(spark, sf, "documents"))


def op3_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from .decontaminate import contamination

    return contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """The runs of lines that are deleted."""
    from .line_dedup import repeated_runs

    return repeated_runs(table(spark, sf, "documents"))


def op5_quality(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the classifier keeps, with their scores."""
    from .quality import KEEP, score_quality, train

    docs = table(spark, sf, "documents")
    return score_quality(docs, train(docs, table(spark, sf, "labels"))).filter(F.col("score") >= KEEP)


def op6_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's class of similar n-gram sets."""
    from .ngram_join import similar_classes

    return similar_classes(table(spark, sf, "documents"))


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that the classifier calls toxic, with their scores."""
    from .toxicity import score_toxicity, train

    docs = table(spark, sf, "documents")
    model = train(docs, table(spark, sf, "labels"))
    return score_toxicity(docs, model).filter(F.col("score") >= 0.5)


def op8_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    from .repeats import repeated_passages

    return repeated_passages(table(spark, sf, "documents"))


def op9_warc_derivatives(spark: SparkSession, sf: str) -> DataFrame:
    from .warc import page_derivatives

    return page_derivatives(table(spark, sf, "pages"))


def op10_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(table(spark, sf, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import line_dedup, ngram_join, repeats

    return {"op4_line_dedup": line_dedup.SQL, "op6_ngram_join": ngram_join.SQL, "op8_repeated_passages": repeats.SQL}
