"""Indexes of source folders and repositories: building, searching, storing and reusing them."""

from __future__ import annotations

import hashlib
import json
import os
import re
import shutil
import stat
import tempfile
from collections import OrderedDict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from glyphmill import telemetry
from glyphmill.functions import paths
from glyphmill.functions.text import utf16_length
from glyphmill.operators import bm25, chunking, dense, lookup
from glyphmill.plans import search
from glyphmill.plans.search import TOP_K
from glyphmill.session import ship, stash, work_folder
from glyphmill.sources import git, walk
from glyphmill.sources.languages import CONTENT

VERSION = 1
TABLES = ("chunks", "postings", "terms", "corpus", "vectors")
#: The columns that a stored index must have.
NEED = {
    "chunks": {"chunk_id": "bigint", "content": "string", "file_path": "string", "start_line": "bigint", "end_line": "bigint", "language": "string"},
    "postings": {"term": "string", "chunk_id": "bigint", "tf": "int", "dl": "bigint"}, "terms": {"term": "string", "df": "bigint"},
    "corpus": {"n": "bigint", "avgdl": "double"}, "vectors": {"chunk_id": "bigint", "v": "array<float>"},
}
CHUNK_SCHEMA = "chunk_id long, content string, file_path string, start_line long, end_line long, language string"
ROW = ("content", "file_path", "start_line", "end_line", "language")


def known_content(content) -> tuple[str, ...]:
    """Kinds of content without repeats; none means code."""
    out = tuple(dict.fromkeys(content or ("code",)))
    if bad := [c for c in out if c not in CONTENT]:
        raise ValueError(f"unknown content: {bad}")
    return out


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """The rows with ``chunk_id`` from 0 in an order that has no ties: ranges are numbered apart, and the driver adds up their sizes."""
    ranges = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    own = stash(ranges.withColumn("__n", F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1), "ranges")
    start, starts = 0, []
    for r in own.groupBy("__range").count().orderBy("__range").collect():  # one row a partition
        starts.append((r["__range"], start))
        start += r["count"]
    first = rows.sparkSession.createDataFrame(starts, "__of int, __first long")
    return own.join(F.broadcast(first), F.col("__range") == F.col("__of")).withColumn("chunk_id", F.col("__first") + F.col("__n")).drop("__range", "__n", "__of", "__first")


class Index:
    """A searchable index. All tables are DataFrames keyed by ``chunk_id``; results are DataFrames too."""

    def __init__(self, spark: SparkSession, chunks: DataFrame, postings: bm25.Postings, vectors: DataFrame, model, root: str | None = None, content: tuple[str, ...] = ("code",)):
        self.spark, self.chunks, self.postings, self.vectors = spark, chunks, postings, vectors
        self.model, self.root, self.content = model, root, content
        self._files: str | None = None

    # building

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, model_path: str | None = None, content=None, work: str | None = None) -> Index:
        """Index a folder. Tables are written below ``work`` (by default the shared folder for work tables) and read back."""
        if not os.path.exists(path):
            raise FileNotFoundError(f"nothing at {path}")
        if not os.path.isdir(path):
            raise NotADirectoryError(f"{path} is no folder")
        kinds = known_content(content)
        rows = walk.decoded(walk.files(spark, path, kinds))
        parts = chunking.chunk_files(rows.select("file_path", "text", "language"))
        order = rows.select(F.col("file_path").alias("__p"), F.col("ord").alias("__o"))
        # ids go by file in the order of the walk, then by place
        chunks = numbered(parts.join(order, F.col("file_path") == F.col("__p")), ["__o", "ord"]).select("chunk_id", *ROW)
        return cls.from_chunks(spark, chunks, dense.load_model(model_path), path, kinds, work, f"{path} has no file of a known kind")

    @classmethod
    def from_chunks(cls, spark: SparkSession, chunks: DataFrame, model, root: str | None, content: tuple[str, ...], work: str | None = None, empty: str = "an index needs a chunk") -> Index:
        """Index a table of chunks."""
        folder = work or work_folder(spark, "index")
        put = lambda df, name: (df.write.mode("overwrite").parquet(f"{folder}/{name}"), spark.read.parquet(f"{folder}/{name}"))[1]
        chunks = put(chunks.select("chunk_id", *ROW), "chunks")
        if not chunks.head(1):
            raise ValueError(empty)
        built = bm25.build(counted := put(bm25.chunk_terms(chunks), "counted"))
        # sorted by term: a search reads only the row groups of its terms
        posted = put(built.postings.repartitionByRange("term").sortWithinPartitions("term", "chunk_id"), "postings")
        terms = put(posted.groupBy("term").agg(F.count("*").alias("df")), "terms")
        stats = put(built.corpus, "corpus")
        vectors = put(dense.embed(chunks, model), "vectors")
        out = cls(spark, chunks, bm25.Postings(posted, terms, stats, counted), vectors, model, root, content)
        out._files = folder
        return out

    @classmethod
    def from_git(cls, spark: SparkSession, url: str, ref: str | None = None, model_path: str | None = None, content=None, work: str | None = None) -> Index:
        """Index a shallow clone; the index keeps the URL as its root."""
        with tempfile.TemporaryDirectory(prefix="glyphmill-git-") as folder:
            git.clone(url, folder, ref)
            out = cls.from_path(spark, folder, model_path, content, work)
        out.root = url
        return out

    # queries

    def queries(self, texts: list[str], alpha: float | None = None, languages: list[str] | None = None, file_paths: list[str] | None = None) -> DataFrame:
        """A table of queries with their vectors."""
        v = self.model.encode(texts)
        rows = [(i, t, alpha, languages, file_paths, [float(x) for x in v[i]]) for i, t in enumerate(texts)]
        return self.spark.createDataFrame(rows, "query_id long, text string, alpha double, filter_languages array<string>, filter_paths array<string>, v array<float>")

    def search(self, query: str | DataFrame, top_k: int = TOP_K, languages: list[str] | None = None, file_paths: list[str] | None = None, alpha: float | None = None, reranked: bool = True, strict_filters: bool = False) -> DataFrame:
        """``(query_id, rank, score, chunk_id, …chunk, location)``, best first; for one text or a table of queries."""
        if isinstance(query, str):
            q, filtered = self.queries([query], alpha, languages, file_paths), bool(languages or file_paths)
        else:
            q, filtered = query, "filter_languages" in query.columns
        hits = search.hybrid(self.chunks, self.postings, self.vectors, q, top_k, reranked, strict_filters, filtered)
        return self._rows(hits)

    def find_related(self, seed: dict, top_k: int = TOP_K) -> DataFrame:
        """The chunks nearest to a chunk, without those equal to it in all fields."""
        if top_k < 1:
            return self._rows(self.spark.createDataFrame([], "query_id long, chunk_id long, score double, rank int"))
        v = [float(x) for x in self.model.encode([seed["content"]])[0]]
        hits = dense.knn(self.vectors, self.spark.createDataFrame([(0, v)], "query_id long, v array<float>"), top_k + 1).join(self.chunks, "chunk_id")
        same = F.lit(True)
        for c in ROW:
            same &= F.col(c).eqNullSafe(F.lit(seed.get(c)))
        w = Window.partitionBy("query_id").orderBy("sem_rank")
        rest = hits.filter(~same).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top_k)
        return self._rows(rest.select("query_id", "chunk_id", F.col("similarity").alias("score"), "rank"))

    def resolve(self, file_path: str, line: int) -> dict | None:
        """The chunk at a line of a file."""
        if not 0 <= line < 1 << 32:
            return None
        place = self.spark.createDataFrame([(0, file_path, line)], "place_id long, file_path string, line long")
        r = lookup.resolve(self.chunks, place).join(self.chunks, "chunk_id").first()
        return {c: r[c] for c in ROW} if r else None

    def sizes(self) -> DataFrame:
        """``(file_path, chars)``: the UTF-16 units of each file's chunks."""
        return self.chunks.groupBy("file_path").agg(F.sum(utf16_length(F.col("content"))).alias("chars"))

    def stats(self) -> dict:
        """Files, chunks, and chunks by language in order."""
        s = lookup.index_stats(self.chunks).first()
        langs = {r.language: r.chunks for r in lookup.languages(self.chunks).orderBy("language").collect()}
        return {"indexed_files": s.indexed_files, "total_chunks": s.total_chunks, "languages": langs}

    def _rows(self, hits: DataFrame) -> DataFrame:
        full = hits.select("query_id", "rank", "score", "chunk_id").join(self.chunks, "chunk_id")
        place = paths.location(F.col("file_path"), F.col("start_line"), F.col("end_line"))
        return full.select("query_id", "rank", "score", "chunk_id", *ROW, place.alias("location")).orderBy("query_id", "rank")

    # storing

    def chunk_hash(self) -> str:
        """A digest of all chunks with their ids."""
        return digest(self.chunks.select(F.sha2(F.to_json(F.struct("chunk_id", *ROW)), 256).alias("h"))).first().digest

    def save(self, folder: str, content_hash: str | None = None) -> None:
        """Write the tables, and the manifest last: an index without one isn't whole."""
        os.makedirs(folder, exist_ok=True)
        manifest = os.path.join(folder, "manifest.json")
        if os.path.exists(manifest):
            os.remove(manifest)
        content_hash = content_hash or self.chunk_hash()
        if self._files != folder:
            for name, df in zip(TABLES, (self.chunks, self.postings.postings, self.postings.terms, self.postings.corpus, self.vectors)):
                df.write.mode("overwrite").parquet(os.path.join(folder, name))
        data = {"schemaVersion": VERSION, "contentHash": content_hash, "sourceId": self.root, "content": list(self.content), "modelId": self.model.name, "chunkSize": chunking.CHUNK, "dim": self.model.dim}
        with open(tmp := manifest + ".tmp", "w", encoding="utf-8") as f:
            json.dump(data, f)
        os.replace(tmp, manifest)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Index:
        """Read a stored index; every table must be there, and the version right."""
        if not os.path.isdir(folder):
            raise FileNotFoundError(f"no index in {folder}")
        for name in ("manifest.json", *TABLES):
            if not os.path.exists(os.path.join(folder, name)):
                raise FileNotFoundError(f"the index lacks {os.path.join(folder, name)}")
        m = read_manifest(folder)
        if m["schemaVersion"] != VERSION:
            raise ValueError(f"the index is of version {m['schemaVersion']}, this engine reads {VERSION}")
        t = {n: spark.read.parquet(os.path.join(folder, n)) for n in TABLES}
        for name, need in NEED.items():
            if missing := [c for c, kind in need.items() if dict(t[name].dtypes).get(c) != kind]:
                raise ValueError(f"{name}: column {missing[0]} isn't there as {need[missing[0]]}")
        v = t["vectors"].agg(F.count("v").alias("n"), F.count_distinct("chunk_id").alias("ids"), F.min(F.size("v")).alias("least"), F.max(F.size("v")).alias("most")).first()
        chunks = t["chunks"].count()
        if v.least != v.most or not v.n == v.ids == chunks or v.most != m.get("dim", v.most):
            raise ValueError(f"{chunks} chunks, {v.n} vectors of {v.ids} chunks, with {v.least} to {v.most} values instead of {m.get('dim', v.most)}")
        model = dense.load_model(m["modelId"])
        if v.most and model.dim != v.most:
            model = dense.StubModel(v.most)
        counted = spark.read.parquet(os.path.join(folder, "counted")) if os.path.exists(os.path.join(folder, "counted")) else None
        out = cls(spark, t["chunks"], bm25.Postings(t["postings"], t["terms"], t["corpus"], counted), t["vectors"], model, m["sourceId"], tuple(m["content"]))
        out._files = folder
        return out


def read_manifest(folder: str) -> dict:
    """A manifest whose every field has been looked at."""
    with open(os.path.join(folder, "manifest.json"), encoding="utf-8") as f:
        m = json.load(f)
    if not isinstance(m, dict):
        raise ValueError("the manifest is no object")
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 32
    checks = {
        "schemaVersion": whole, "contentHash": lambda x: isinstance(x, str), "sourceId": lambda x: x is None or isinstance(x, str), "modelId": lambda x: isinstance(x, str),
        "chunkSize": lambda x: x is None or whole(x), "content": lambda x: isinstance(x, list) and all(c in CONTENT for c in x),
    }
    for key, ok in checks.items():
        if not ok(m.get(key)):
            raise ValueError(f"the manifest's {key} is wrong")
    return {"sourceId": None, "chunkSize": None} | m


# cache of indexes


def normal_source(source: str) -> str:
    """Local paths without . and .., remote ones as they are."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", source) or source.startswith("git@"):
        return source
    out: list[str] = []
    absolute = source.startswith("/")
    for part in source.split("/"):
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part == ".." and absolute:
            continue
        elif part not in ("", "."):
            out.append(part)
    s = ("/" if absolute else "") + "/".join(out) or "."
    return s + "/" if len(source) > 1 and source.endswith("/") and not s.endswith("/") else s


def cache_root(base: str | None = None) -> str:
    return os.path.join(base or telemetry.home(), "index")


def cache_dir(source: str, content: tuple[str, ...], base: str | None = None, ref: str | None = None, model: str | None = None) -> str:
    """Where the index of a source is kept: by source, content, ref and model."""
    key = json.dumps({"source": normal_source(source), "content": sorted(content), "ref": ref, "model": model}, sort_keys=True)
    return os.path.join(cache_root(base), hashlib.sha256(key.encode()).hexdigest()[:32])


def keyed(rows: DataFrame, content: tuple[str, ...]) -> DataFrame:
    """The rows with their ``source`` in normal form and ``key``, the name of its index's folder."""
    ship(rows.sparkSession)

    def run(it):
        for b in it:
            at = b.schema.get_field_index("source")
            normal = [None if s is None else normal_source(s) for s in b.column(at).to_pylist()]
            keys = [None if s is None else os.path.basename(cache_dir(s, content, "/")) for s in normal]
            yield pa.RecordBatch.from_arrays([*(c if k != at else pa.array(normal, pa.string()) for k, c in enumerate(b.columns)), pa.array(keys, pa.string())], [*b.schema.names, "key"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("key", StringType())]))


def ensure_dir(folder: str, base: str | None = None) -> None:
    """Make the folder; it and those above it up to the cache's home are for the user alone."""
    os.makedirs(folder, exist_ok=True)
    home = os.path.abspath(base or telemetry.home())
    at = os.path.abspath(folder)
    while at.startswith(home):
        os.chmod(at, stat.S_IRWXU)
        if at == home:
            break
        at = os.path.dirname(at)


def digest(hashes: DataFrame) -> DataFrame:
    """``(n, digest)`` of rows with a SHA-256 ``h``, in any order: of their number and the sums of the eight parts of each.

    The sums are partial where the rows are, so nothing but one row comes together.
    """
    part = lambda k: F.sum(F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(38,0)"))
    sums = hashes.agg(F.count("*").alias("n"), *(F.coalesce(part(k), F.lit(0)).cast("string").alias(f"s{k}") for k in range(8)))
    return sums.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(f"s{k}" for k in range(8))), 256).alias("digest"))


def file_hashes(rows: DataFrame) -> DataFrame:
    """``h`` of files ``(path, bytes)``, each hashed where it is read."""
    head = F.encode(F.concat(utf16_length(F.col("path")).cast("string"), F.lit(":"), F.col("path")), "utf-8")
    return rows.select(F.sha2(F.concat(head, F.col("bytes")), 256).alias("h"))


def content_hash(rows: DataFrame) -> str:
    """A digest of files ``(path, bytes)`` that doesn't depend on their order."""
    return digest(file_hashes(rows)).first().digest


def load_or_build(spark: SparkSession, source: str, content=None, base: str | None = None, ref: str | None = None, model_path: str | None = None) -> Index:
    """The cached index of a source if it is still right, else a new one, which is cached.

    Local sources are compared by the digest of their files; remote ones by URL and ref.
    """
    kinds = known_content(content)
    remote = git.looks_remote(source)
    folder = cache_dir(source, kinds, base, ref, model_path)
    ensure_dir(folder, base)
    now = None if remote else content_hash(walk.files(spark, source, kinds).select("path", "bytes"))
    if (kept := reuse(spark, folder, now)) is not None:
        return kept
    make = {"model_path": model_path, "content": kinds, "work": folder}
    index = Index.from_git(spark, source, ref, **make) if remote else Index.from_path(spark, source, **make)
    index.save(folder, now)
    return index


def reuse(spark: SparkSession, folder: str, now: str | None) -> Index | None:
    """A stored index if it is whole, has today's chunk size and, with ``now``, that digest."""
    try:
        m = read_manifest(folder)
        if m["chunkSize"] != chunking.CHUNK or now is not None and m["contentHash"] != now:
            return None
        return Index.load(spark, folder)
    except (OSError, ValueError):
        return None


def clear_cache(base: str | None = None) -> tuple[str, bool, int]:
    """Delete all cached indexes: (folder, whether there was one, entries). Only the folder ``index`` right below the home is ever deleted."""
    root = cache_root(base)
    if not os.path.exists(root):
        return root, False, 0
    real, home = os.path.realpath(root), os.path.realpath(base or telemetry.home())
    if os.path.basename(real) != "index" or os.path.dirname(real) != home:
        raise ValueError(f"{real} isn't the cache's own folder, so nothing is deleted")
    n = len(os.listdir(real))
    shutil.rmtree(real)
    return root, True, n


class BadSource(ValueError):
    """A source that a tool call can't name."""


class Session:
    """Up to ``most`` indexes by source, the least recently used goes first; a failed build isn't kept."""

    def __init__(self, build: Callable[[str, str | None], Index], most: int = 10):
        self.build, self.most, self.held = build, most, OrderedDict()

    def key(self, source: str, ref: str | None = None) -> str:
        if git.looks_remote(source):
            return f"{source}@{ref}" if ref else source
        return os.path.abspath(source)

    def get(self, source: str, ref: str | None = None) -> Index:
        k = self.key(source, ref)
        if k in self.held:
            self.held.move_to_end(k)
            return self.held[k]
        index = self.build(source, ref)
        while len(self.held) >= self.most:
            self.held.popitem(last=False)
        self.held[k] = index
        return index

    def evict(self, source: str, ref: str | None = None) -> None:
        self.held.pop(self.key(source, ref), None)

    def find(self, repo: str | None, default: str | None = None, default_ref: str | None = None) -> Index:
        """The index that a tool call means; only https, http and local folders can be named in one."""
        if repo and git.looks_remote(repo) and not repo.startswith(("https://", "http://")):
            raise BadSource(f"A tool call can name a local folder or an http(s) address; this is neither: {json.dumps(repo)}")
        source = repo or default
        if not source:
            raise BadSource("Nothing to search: name a folder or an http(s) address of a repository in `repo`")
        return self.get(source, None if repo else default_ref)


def payload(query: str, results: DataFrame) -> str:
    """The results of one query as JSON: ``{query, results: [{chunk, score}]}``."""
    rows = results.orderBy("rank").collect()
    return json.dumps({"query": query, "results": [{"chunk": {c: r[c] for c in (*ROW, "location")}, "score": r.score} for r in rows]}, ensure_ascii=False)
