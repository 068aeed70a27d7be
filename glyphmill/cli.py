"""The command line: search, find-related, index, savings, clear, and a tool server on stdio."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from glyphmill import index as ix
from glyphmill import telemetry
from glyphmill.session import build
from glyphmill.sources import git

KINDS = ("code", "docs", "config")


def content(flags: list[str] | None) -> tuple[str, ...]:
    """No flags mean code, ``all`` everything."""
    if not flags:
        return ("code",)
    return KINDS if "all" in flags else tuple(dict.fromkeys(flags))


def note(index: ix.Index, rows, call: str) -> None:
    """Add what a call showed to the usage records, for the report on savings."""
    telemetry.append(telemetry.record(rows, index.sizes(), call), telemetry.default_file())


def search_output(index: ix.Index, query: str, top_k: int = 5) -> str:
    rows = index.search(query, top_k) if query.strip() and top_k > 0 else None
    if rows is None or not rows.head(1):
        return json.dumps({"error": "nothing found"})
    note(index, rows, "search")
    return ix.payload(query, rows)


def related_output(index: ix.Index, file: str, line: str | int, top_k: int = 5) -> str:
    """JSON, or a ValueError with the message for the user."""
    try:
        n = int(line)
    except ValueError:
        raise ValueError(f"{line} is no line number") from None
    seed = index.resolve(file, n)
    if seed is None:
        raise ValueError(f"The index has no chunk at {file}:{n}.")
    rows = index.find_related(seed, top_k)
    if not rows.head(1):
        return json.dumps({"error": f"nothing is related to {file}:{n}"})
    note(index, rows, "find_related")
    return ix.payload(f"Chunks related to {file}:{n}", rows)


TOOLS = [
    {"name": "search", "description": "Search indexed sources.", "inputSchema": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "repo": {"type": "string"}, "top_k": {"type": "integer", "default": 5}}}},
    {"name": "find_related", "description": "Find chunks like the one at a line.", "inputSchema": {"type": "object", "required": ["file_path", "line"], "properties": {"file_path": {"type": "string"}, "line": {"type": "integer"}, "repo": {"type": "string"}, "top_k": {"type": "integer", "default": 5}}}},
]


def call_tool(session: ix.Session, name: str, args: dict, default: str | None = None, ref: str | None = None) -> str:
    """A tool's answer; what goes wrong is the answer too."""
    try:
        index = session.find(args.get("repo"), default, ref)
    except Exception as e:
        source = args.get("repo") or default
        return str(e) if isinstance(e, ix.BadSource) else f"{json.dumps(source)} can't be indexed: {e}"
    if name == "search":
        return search_output(index, args["query"], int(args.get("top_k", 5)))
    try:
        return related_output(index, args["file_path"], args["line"], int(args.get("top_k", 5)))
    except ValueError as e:
        return f"{e} Paths and lines are those of search results."


def serve(session: ix.Session, default: str | None, ref: str | None, lines=None, out=None) -> None:
    """Answer JSON-RPC requests, one a line."""
    out = out or sys.stdout
    for line in lines or sys.stdin:
        try:
            req = json.loads(line)
        except ValueError:
            continue
        if not isinstance(req, dict) or "id" not in req:
            continue
        method, args = req.get("method"), req.get("params") or {}
        if method == "initialize":
            result = {"protocolVersion": args.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "glyphmill", "version": "0.1.0"}}
        elif method == "tools/list":
            result = {"tools": TOOLS}
        elif method == "tools/call" and args.get("name") in ("search", "find_related"):
            result = {"content": [{"type": "text", "text": call_tool(session, args["name"], args.get("arguments") or {}, default, ref)}]}
        else:
            print(json.dumps({"jsonrpc": "2.0", "id": req["id"], "error": {"code": -32601, "message": f"unknown method {method}"}}), file=out, flush=True)
            continue
        print(json.dumps({"jsonrpc": "2.0", "id": req["id"], "result": result}, ensure_ascii=False), file=out, flush=True)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("glyphmill")
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in (("search", ["query"]), ("find-related", ["file", "line"])):
        s = sub.add_parser(name)
        for x in places:
            s.add_argument(x)
        s.add_argument("path", nargs="?", default=".")
        s.add_argument("-k", "--top-k", type=int, default=5)
        s.add_argument("--index", help="a stored index")
        s.add_argument("--ref", help="branch or tag of a git URL")
    s = sub.add_parser("index")
    s.add_argument("path", nargs="?", default=".")
    s.add_argument("-o", "--out", required=True)
    s = sub.add_parser("serve")
    s.add_argument("path", nargs="?")
    s.add_argument("--ref")
    for s in sub.choices.values():
        s.add_argument("--content", nargs="+", choices=[*KINDS, "all"])
    sub.add_parser("savings").add_argument("--verbose", action="store_true")
    sub.add_parser("clear").add_argument("what", choices=["all", "index", "savings"])
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "clear":
        failed = 0
        if a.what in ("all", "index"):
            try:
                path, cleared, n = ix.clear_cache()
                print(f"{path}: {n} indexes deleted" if cleared else f"{path}: nothing to delete")
            except (OSError, ValueError) as e:
                print(e, file=sys.stderr)
                failed = 1
        if a.what in ("all", "savings"):
            path = telemetry.default_file()
            print(f"{path}: deleted" if telemetry.clear(path) else f"{path}: nothing to delete")
        return failed
    spark = spark or build(master="local[*]")
    try:
        if a.command == "savings":
            print(telemetry.report(spark, telemetry.default_file(), time.time(), a.verbose), end="")
            return 0
        kinds = content(a.content)
        if a.command == "serve":
            serve(ix.Session(lambda source, ref: ix.load_or_build(spark, source, kinds, ref=ref)), a.path, a.ref)
            return 0
        if a.command == "index":
            make = ix.Index.from_git if git.looks_remote(a.path) else ix.Index.from_path
            make(spark, a.path, content=kinds).save(a.out)
            return 0
        index = ix.Index.load(spark, a.index) if a.index else ix.load_or_build(spark, a.path, kinds, ref=a.ref)
        print(search_output(index, a.query, a.top_k) if a.command == "search" else related_output(index, a.file, a.line, a.top_k))
        return 0
    except (OSError, ValueError, RuntimeError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
