"""A corpus from raw documents to a weighted mix, in stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all documents that the one
before it kept; between stages they are written to the shared work folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glyphmill.llm import decontaminate, line_dedup, mixing, ngram_join, quality
from glyphmill.llm.common import stash
from glyphmill.session import table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels, keeps.

    Null and empty texts are scored as texts without words; null ids, repeated rows and long texts are scored like others.
    Without labels of both kinds all stay; an empty table stays empty.
    """
    return quality.keep_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of lines that an earlier place has.

    Documents of which no line is left go. Null ids, null and empty texts stay as they are; of repeated rows, all
    are cut alike; of equal ids with different texts the order of the texts' hashes decides; an empty table stays empty.
    """
    return line_dedup.dedup_lines(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least id.

    Null ids and texts without words stay; repeated rows are one document and stay or go together; an empty table stays empty.
    """
    return ngram_join.drop_similar(docs)


def no_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage.

    Every row is judged by its text, also with a null id; null and empty texts stay; an empty table stays empty, and an empty benchmark keeps all.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the copies that bring their sources to the target weights; those with 0 copies go.

    Null ids stay, once each; a null source is a source of its own; null and empty texts have no mass but their source's rate; repeated rows
    are one document with one decision; an empty table stays empty.
    """
    return mixing.mix_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", cut_lines),
    ("n-gram jaccard join", one_of_each),
    ("benchmark decontamination", no_benchmarks),
    ("source mixing", mixed),
]

#: SQL can't express the classifier, the tiling or the random rounding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents of a data folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        if k:
            docs = stash(docs, "stage")
        docs = stage(spark, docs, sf_dir)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
