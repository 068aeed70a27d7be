"""Folders, stored indexes, the cache, the command line and telemetry."""

import io
import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from glyphmill import cli, telemetry
from glyphmill import index as ix
from glyphmill.sources import git, languages, walk
from glyphmill.streaming import telemetry as streaming




@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    for name, text in {
        "src/handler_stack.py": "class HandlerStack:\n    def push(self, x):\n        return x\n", "src/cache_layer.py": "def cache(x):\n    '''keeps answers'''\n    return x\n", "src/util.ts": "export function add(a, b) { return a + b }\n",
        "tests/test_stack.py": "def test_push():\n    assert HandlerStack().push(1)\n", "README.md": "# Notes\n", "data.json": "{}", "node_modules/x.py": "x = 1\n", "__init__.py": "y = 1\n", ".gitignore": "*.log\n!special.log\n", "foo.log": "no", "special.log": "yes it is\n",
    }.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def names(root, content=("code",), **kw):
    return [os.path.relpath(p, root) for p, _ in walk.walk(root, languages.extensions_for(content), **kw)]


def test_walk(repo):
    assert names(repo) == ["__init__.py", "special.log", "src/cache_layer.py", "src/handler_stack.py", "src/util.ts", "tests/test_stack.py"]
    assert "README.md" in names(repo, ("docs",)) and "data.json" not in names(repo, languages.CONTENT)
    os.symlink(f"{repo}/src/util.ts", f"{repo}/link.ts")
    with open(f"{repo}/src/.glyphmillignore", "w") as f:
        f.write("util.*\n")
    assert "link.ts" not in names(repo) and "src/util.ts" not in names(repo)


@pytest.mark.parametrize(
    "line,path,is_dir,hit",
    [
        ("*.py", "a/b.py", False, True), ("/a.py", "x/a.py", False, False), ("a/b", "x/a/b", False, False), ("build/", "x/build", True, True), ("build/", "build", False, False), ("a/**/b", "a/x/y/b", False, True), ("a/**", "a/x", False, True),
        ("**/z", "q/r/z", False, True), ("[ab].c", "b.c", False, True), ("[!ab].c", "b.c", False, False), ("a?c", "abc", False, True), (r"\#x", "#x", False, True), ("foo ", "foo", False, True), (r"\!k", "!k", False, True),
    ],
)
def test_ignore_lines(line, path, is_dir, hit):
    assert walk.compile_line(line).matches(path, is_dir) is hit


def test_source_tree(spark, repo):
    with open(f"{repo}/src/bad.py", "wb") as f:
        f.write(b"x = '\xff'\n")
    with open(f"{repo}/src/large.py", "wb") as f:
        f.write(b"#" * 1_000_001)
    rows = walk.decoded(walk.files(spark, repo, files="2")).orderBy("ord").collect()
    assert [r.file_path for r in rows][0] == "__init__.py" and "src/large.py" not in {r.file_path for r in rows}
    bad = next(r for r in rows if r.file_path == "src/bad.py")
    assert "�" in bad.text and bad.language == "python"
    assert {r.file_path: r.found for r in walk.files(spark, repo).selectExpr("path as file_path", "found").collect()}["special.log"]


def test_languages(spark):
    f = spark.createDataFrame([("a/B.PY",), (".gitignore",), ("x.d.ts",), ("y.zzz",), ("n",)], "file_path string")
    assert [r.language for r in languages.detect(f).collect()] == ["python", None, "typescript", None, None]
    t = languages.extension_table(spark)
    assert [r.ext for r in languages.content_extensions(t, ("docs",), (".foo",)).collect()] == languages.extensions_for(("docs",), (".foo",))


def test_git_urls(spark):
    yes = ["https://x/y", "http://x", "ssh://h/r", "git://h/r", "git+ssh://h/r", "file:///r", "git@github.com:o/r.git", "user@host:repo"]
    no = ["/abs", "./rel", "repo", "user@host:/abs"]
    df = spark.createDataFrame([(u,) for u in yes + no], "u string").select(git.is_git_url(F.col("u")))
    assert [r[0] for r in df.collect()] == [True] * 8 + [False] * 4 == [git.looks_remote(u) for u in yes + no]
    with pytest.raises(ValueError):
        git.clone("file:///x", "/tmp/never", "--evil")


def test_build_search_store(spark, repo, tmp_path):
    index = ix.Index.from_path(spark, repo, model_path="stub-16")
    s = index.stats()
    assert s["indexed_files"] == 6 and s["languages"]["python"] >= 4
    top = index.search("HandlerStack", 3).collect()
    assert top[0].file_path == "src/handler_stack.py" and [r.rank for r in top] == [1, 2, 3]
    assert all("src/" in r.file_path for r in index.search("return x", file_paths=["src/"], languages=["python"]).collect())
    assert index.search("   ").count() == 0 and index.search("x", 0).count() == 0
    assert index.search("return x", file_paths=["nowhere"]).count() == 0
    seed = index.resolve("src/handler_stack.py", 2)
    assert seed["content"].startswith("class HandlerStack") and index.resolve("src/handler_stack.py", -1) is None
    rel = index.find_related(seed, 3).collect()
    assert len(rel) == 3 and all(r.content != seed["content"] for r in rel)
    index.save(str(tmp_path / "ix"))
    again = ix.Index.load(spark, str(tmp_path / "ix"))
    assert [tuple(r) for r in again.search("HandlerStack", 3).collect()] == [tuple(r) for r in top]
    m = json.load(open(tmp_path / "ix" / "manifest.json"))
    json.dump(m | {"schemaVersion": 99}, open(tmp_path / "ix" / "manifest.json", "w"))
    with pytest.raises(ValueError):
        ix.Index.load(spark, str(tmp_path / "ix"))
    json.dump(m, open(tmp_path / "ix" / "manifest.json", "w"))
    v = spark.read.parquet(str(tmp_path / "ix" / "vectors")).collect()
    for broken in ([(r.chunk_id, r.v[:-1] if k == 0 else r.v) for k, r in enumerate(v)], [(r.chunk_id, r.v) for r in v[1:]], [(v[0].chunk_id, r.v) for r in v]):
        spark.createDataFrame(broken, "chunk_id long, v array<float>").write.mode("overwrite").parquet(str(tmp_path / "ix" / "vectors"))
        with pytest.raises(ValueError):
            ix.Index.load(spark, str(tmp_path / "ix"))
    json.dump(m | {"content": ["nope"]}, open(tmp_path / "ix" / "manifest.json", "w"))
    with pytest.raises(ValueError):
        ix.read_manifest(str(tmp_path / "ix"))
    with pytest.raises(FileNotFoundError):
        ix.Index.load(spark, str(tmp_path / "none"))


def test_numbered(spark):
    rows = spark.range(1000).selectExpr("id % 37 as a", "id as b").repartition(7)
    got = {(r.a, r.b): r.chunk_id for r in ix.numbered(rows, ["a", "b"]).collect()}
    assert [got[k] for k in sorted(got)] == list(range(1000))


def test_digest(spark):
    rows = spark.createDataFrame([("a", b"x"), ("b", b""), ("c\U0001f600", b"\xff")], "path string, bytes binary")
    want = ix.content_hash(rows)
    assert want == ix.content_hash(rows.orderBy(F.desc("path")).repartition(3)) != ix.content_hash(rows.limit(2)) and len(want) == 64
    assert ix.content_hash(rows.limit(0)) != want


def test_wire(spark):
    from glyphmill import wire

    good = {"content": "x", "filePath": "a.py", "startLine": 1, "endLine": 4294967295, "language": None, "location": "lies:0-0", "more": 1}
    bad = [("no object", "[1]"), ("no object", "junk"), ("content is no string", json.dumps(good | {"content": 3})), ("filePath is no string", json.dumps({k: v for k, v in good.items() if k != "filePath"})), ("startLine is no line", json.dumps(good | {"startLine": -1})),
           ("startLine is no line", json.dumps(good | {"startLine": "1"})), ("endLine is no line", json.dumps(good | {"endLine": 4294967296})), ("endLine is no line", json.dumps(good | {"endLine": 1.5})), ("language is no string", json.dumps(good | {"language": 7}))]
    df = spark.createDataFrame([(0, json.dumps(good)), *((k, t) for k, (_, t) in enumerate(bad, 1))], "k int, j string")
    got = {r.k: r for r in wire.parsed(df, "j", "k").collect()}
    assert [got[k].error for k in range(1, len(bad) + 1)] == [e for e, _ in bad]
    assert tuple(got[0])[1:] == ("x", "a.py", 1, 4294967295, None, None) and got[1].content is None
    back = wire.checked(df.filter("k = 0"), "j").select(wire.chunk_json().alias("j")).first().j
    assert json.loads(back) == {k: v for k, v in good.items() if k != "more"} | {"location": "a.py:1-4294967295"}
    with pytest.raises(Exception, match="Invalid chunk: no object"):
        wire.checked(df, "j").collect()
    res = spark.createDataFrame([(0, 2, 0.5, "b", "q.py", 1, 2, None), (0, 1, 0.75, "a", "p.py", 1, 2, "python")], "query_id long, rank int, score double, content string, file_path string, start_line long, end_line long, language string")
    out = {r.query_id: json.loads(r.payload) for r in wire.payloads(res, spark.createDataFrame([(0, "ask"), (1, "none")], "query_id long, text string")).collect()}
    assert [r["score"] for r in out[0]["results"]] == [0.75, 0.5] and out[0]["results"][0]["chunk"]["location"] == "p.py:1-2" and out[0]["results"][1]["chunk"]["language"] is None
    assert out[1] == {"query": "none", "results": []}
    assert json.loads(res.filter("rank = 1").select(wire.result_json(F.col("score")).alias("j")).first().j)["chunk"]["startLine"] == 1


def test_static_model(tmp_path):
    import numpy as np
    from tokenizers import Tokenizer, models, pre_tokenizers

    from glyphmill.operators import dense

    t = Tokenizer(models.WordLevel({"[UNK]": 0, "sea": 1, "sky": 2}, unk_token="[UNK]"))
    t.pre_tokenizer = pre_tokenizers.Whitespace()
    t.save(str(tmp_path / "tokenizer.json"))
    m = np.array([[9, 9], [3, 4], [0, 2]], np.float32)

    def store(**arrays):
        head, data = {}, b""
        for k, (kind, a) in arrays.items():
            head[k] = {"dtype": kind, "shape": list(a.shape), "data_offsets": [len(data), len(data) + a.nbytes]}
            data += a.tobytes()
        text = json.dumps(head).encode()
        (tmp_path / "model.safetensors").write_bytes(len(text).to_bytes(8, "little") + text + data)
        dense._static.cache_clear()
        return dense.load_model(str(tmp_path))

    v = store(embeddings=("F32", m)).encode(["sea", "sea sky what", "", "what"])
    assert np.allclose(v, [[0.6, 0.8], np.array([1.5, 3]) / 11.25**0.5, [0, 0], [0, 0]])
    v = store(embeddings=("F16", m.astype(np.float16)[::-1].copy()), mapping=("I64", np.array([2, 1, 0])), weights=("F64", np.array([1.0, 2.0, 1.0]))).encode(["sea sky"])
    assert np.allclose(v, np.array([3, 5]) / 34**0.5)
    (tmp_path / "config.json").write_text(json.dumps({"normalize": False}))
    assert np.allclose(store(embeddings=("F32", m)).encode(["sea"]), [[3, 4]])
    assert isinstance(dense.load_model(str(tmp_path / "none")), dense.StubModel)


def test_strict_filters(spark):
    rows = [(0, "nothing here", "lib/other.py", 1, 2, "python"), (1, "class HandlerStack:", "src/handler_stack.py", 1, 2, "python")]
    chunks = spark.createDataFrame(rows, ix.CHUNK_SCHEMA)
    index = ix.Index.from_chunks(spark, chunks, __import__("glyphmill.operators.dense", fromlist=["x"]).StubModel(8), None, ("code",))
    loose = {r.chunk_id for r in index.search("HandlerStack", file_paths=["lib/"]).collect()}
    strict = {r.chunk_id for r in index.search("HandlerStack", file_paths=["lib/"], strict_filters=True).collect()}
    assert loose == {0, 1} and strict == {0}


def test_cache(spark, repo, tmp_path):
    base = str(tmp_path / "home")
    a = ix.load_or_build(spark, repo, base=base, model_path="stub-8")
    folder = ix.cache_dir(repo, ("code",), base, None, "stub-8")
    before = os.stat(folder + "/manifest.json").st_mtime_ns
    b = ix.load_or_build(spark, repo, base=base, model_path="stub-8")
    assert os.stat(folder + "/manifest.json").st_mtime_ns == before and a.stats() == b.stats()
    with open(f"{repo}/src/new.py", "w") as f:
        f.write("z = 3\n")
    assert ix.load_or_build(spark, repo, base=base, model_path="stub-8").stats()["indexed_files"] == 7
    assert os.stat(folder).st_mode & 0o777 == 0o700
    m = ix.read_manifest(folder)
    json.dump(m | {"chunkSize": 1}, open(folder + "/manifest.json", "w"))
    assert ix.reuse(spark, folder, m["contentHash"]) is None
    assert ix.clear_cache(base)[1:] == (True, 1) and ix.clear_cache(base)[1] is False
    os.makedirs(tmp_path / "elsewhere")
    os.symlink(tmp_path / "elsewhere", f"{base}/index")
    with pytest.raises(ValueError):
        ix.clear_cache(base)


def test_from_git(spark, repo):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", repo, *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "x")
    index = ix.Index.from_git(spark, f"file://{repo}", model_path="stub-8")
    assert index.root == f"file://{repo}" and index.stats()["indexed_files"] == 6


def test_session():
    built = []

    def build(source, ref):
        if source == "/bad":
            raise OSError("no")
        built.append((source, ref))
        return source

    s = ix.Session(build, most=2)
    s.get("/a")
    s.get("/b")
    s.get("/a")
    s.get("/c")
    assert list(s.held) == ["/a", "/c"] and built == [("/a", None), ("/b", None), ("/c", None)]
    with pytest.raises(OSError):
        s.get("/bad")
    assert s.key("https://x/y", "v1") == "https://x/y@v1"
    with pytest.raises(ValueError):
        s.find("ssh://x/y")
    with pytest.raises(ValueError):
        s.find(None)
    assert s.find(None, "https://h/r", "v2") == "https://h/r" and built[-1] == ("https://h/r", "v2")


def test_normal_source():
    assert [ix.normal_source(x) for x in ("a/./b//c/..", "/../x/", "https://a//b", "git@h:r", ".", "a/../..")] == ["a/b", "/x/", "https://a//b", "git@h:r", ".", ".."]


def test_cli(spark, repo, tmp_path, capsys, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path))
    out = str(tmp_path / "out")
    assert cli.main(["index", repo, "-o", out], spark) == 0
    assert cli.main(["search", "HandlerStack", "--index", out, "-k", "2"], spark) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["query"] == "HandlerStack" and got["results"][0]["chunk"]["location"] == "src/handler_stack.py:1-3"
    assert cli.main(["find-related", "src/util.ts", "1", "--index", out], spark) == 0
    assert json.loads(capsys.readouterr().out)["query"] == "Chunks related to src/util.ts:1"
    assert cli.main(["find-related", "src/util.ts", "x", "--index", out], spark) == 1
    assert cli.main(["search", "x", "--index", str(tmp_path / "none")], spark) == 1
    noted = [json.loads(x) for x in open(telemetry.default_file())]
    assert [(r["call"], r["results"]) for r in noted][:1] == [("search", 2)] and noted[0]["file_chars"] >= noted[0]["snippet_chars"] > 0
    session = ix.Session(lambda s, r: ix.Index.load(spark, out))
    lines = [json.dumps({"id": 1, "method": "tools/call", "params": {"name": "search", "arguments": {"query": "HandlerStack", "top_k": 1}}}), json.dumps({"id": 2, "method": "tools/list"}), "junk"]
    buf = io.StringIO()
    cli.serve(session, repo, None, lines, buf)
    first, second = map(json.loads, buf.getvalue().splitlines())
    assert "HandlerStack" in first["result"]["content"][0]["text"] and len(second["result"]["tools"]) == 2
    assert cli.content(None) == ("code",) and cli.content(["docs", "all"]) == cli.KINDS


NOW = 1_700_000_000.0


def test_savings(spark, tmp_path):
    f = tmp_path / "s.jsonl"
    row = lambda ts, a, b, call="search": json.dumps({"ts": ts, "call": call, "results": 1, "snippet_chars": a, "file_chars": b})
    f.write_text("\n".join([row(NOW, 10, 40), row(NOW - 8 * 86400, 50, 20, "other"), "{broken", '{"ts": "x"}', ""]))
    got = {r.bucket: (r.calls, r.saved_chars) for r in telemetry.summary(telemetry.read(spark, str(f)), NOW).collect()}
    assert got == {"Today": (1, 30), "Last 7 days": (1, 30), "All time": (2, 30)}
    assert {r.call: r.calls for r in telemetry.by_call(telemetry.read(spark, str(f))).collect()} == {"search": 1, "other": 1}
    text = telemetry.report(spark, str(f), NOW, verbose=True, color=False)
    assert "Last 7 days" in text and "other" in text and "50%" in text
    assert telemetry.report(spark, str(tmp_path / "no"), NOW) == "There is nothing to report before the first search."
    assert {r.calls for r in telemetry.summary(telemetry.read(spark, str(tmp_path / "no")), NOW).collect()} == {0}
    results = spark.createDataFrame([("a😀", "p"), ("b", "p"), ("c", "q")], "content string, file_path string")
    sizes = spark.createDataFrame([("p", 100)], "file_path string, chars long")
    telemetry.append(telemetry.record(results, sizes, "search", NOW), str(tmp_path / "d" / "x.jsonl"))
    assert json.loads((tmp_path / "d" / "x.jsonl").read_text()) == {"ts": NOW, "call": "search", "results": 3, "snippet_chars": 5, "file_chars": 100}
    assert telemetry.clear(str(f)) and not telemetry.clear(str(f))
    assert (telemetry.short(1_234_567, "~"), telemetry.short(1400), telemetry.short(999, "~")) == ("~1.2M", "1.4k", "~999")


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps({"ts": NOW, "call": "search", "results": 1, "snippet_chars": 5, "file_chars": 9}))
    q = streaming.daily(streaming.stream(spark, str(folder))).writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert [(r.calls, r.saved_chars) for r in spark.table("days").collect()] == [(1, 4)]
