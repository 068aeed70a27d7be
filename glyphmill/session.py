"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent


def build(app: str = "glyphmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` wins over them."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**defaults, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package, once for each context.

    The sources go out through ``addPyFile``, so that executors need no copy of
    the repository.
    """
    sc = spark.sparkContext
    if getattr(sc, "_glyphmill_shipped", False):
        return
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for p in sorted(ROOT.rglob("*")):
            if p.suffix in (".py", ".json") and "__pycache__" not in p.parts:
                z.write(p, str(p.relative_to(ROOT.parent)))
    fd, path = tempfile.mkstemp(prefix="glyphmill-", suffix=".zip")
    with os.fdopen(fd, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)
    sc._glyphmill_shipped = True


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where a scan has fewer pieces than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def work_dir(spark: SparkSession) -> str:
    """The shared folder for work tables: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster has none
    that all machines see, so there it is an error.
    """
    got = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if got:
        return got.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="glyphmill-work-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), there


def work_folder(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one, that goes when the driver ends."""
    path = f"{work_dir(spark)}/glyphmill/{label}-{uuid.uuid4().hex}"
    fs, there = _file_system(spark, path)
    fs.mkdirs(there)
    fs.deleteOnExit(there)
    return path


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a work table and read it back: cuts lineage and survives lost executors.

    The table goes when the driver ends, or at once by :func:`discard`.
    """
    path = work_folder(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._glyphmill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete work tables that nothing reads any more."""
    for t in tables:
        fs, there = _file_system(t.sparkSession, t._glyphmill_path)
        fs.delete(there, True)
