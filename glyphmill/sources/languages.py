"""File extensions, languages, and kinds of content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions.paths import extension

#: ``language: extensions``; a language without extensions has the one of its own name.
LANGUAGES = """
abl: cls p w; actionscript: as; ada: ada adb ads; agda; al; apex: trigger; arduino: ino; asciidoc: adoc asciidoc; asm: asm s; astro; awk;
bash: bash sh; batch: bat cmd; beancount; bibtex: bib; bicep; bitbake: bb bbappend bbclass; blade; brightscript: brs; bsl;
c: c h; c3: c3 c3i c3t; caddy: caddyfile; cairo; capnp; cedar; cedarschema; cel; cfml: cfc; chatito; chuck: ck; circom; clarity: clar; clojure: clj cljc cljs; cmake; cobol: cbl cob cobol; commonlisp: cl lisp; cooklang: cook; corn; cpon; cpp: cc cpp cxx hpp hxx; crystal: cr; csharp: cs; css; cst; csv; cuda: cu cuda; cue; cylc;
d; dart; desktop; devicetree: dts dtsi; dhall; diff: diff patch; djot: dj; dockerfile; dot: dot gv; dtd;
ebnf; eds; eex: eex leex; elisp: el; elixir: ex exs; elm; elsa: lc; elvish: elv; embeddedtemplate: erb; enforce; erlang: erl hrl;
facility: fsd; faust: dsp; fennel: fnl; fidl; firrtl: fir; fish; forth: 4th fth; fortran: f f03 f08 f90 f95; fsharp: fs fsx; fsharp_signature: fsi; func: fc;
gap: g gi; gdscript: gd; gdshader; gitattributes; gitignore; gleam; glimmer: hbs; glsl; gn: gn gni; gnuplot: gnuplot gp plt; go; godot_resource: tres tscn; gomod: mod; gotmpl; graphql: gql graphql; gren; groovy: gradle groovy;
hack; hare; haskell: hs; haxe: hx; hcl; heex; hjson; hlsl; hocon; hoon; html: htm html; http; hurl;
idris: idr; ini: cfg ini; ispc; jai; janet; java; javascript: cjs js jsx mjs; jinja2: j2 jinja2; jq; json; json5; jsonnet: jsonnet libsonnet; julia: jl; just; kcl: k; kdl; kotlin: kt kts;
latex: tex; lean; ledger: journal ldg ledger; less; linkerscript: lds; liquid; llvm: ll; lua; luau;
magik; make: makefile mk; markdown: markdown md; matlab; mermaid: mermaid mmd; meson; mlir; mojo; move; nasm; netlinx: axi axs; nginx: conf nginx; nickel: ncl; nim: nim nims; ninja; nix; norg; nqc; nushell: nu;
objc: m; ocaml: ml; ocaml_interface: mli; ocamllex: mll; odin; openscad: scad; org; pascal: pas; pem; perl: pl pm; pgn; php; pkl; po: po pot; poe_filter: filter; pony; postscript: eps ps; powershell: ps1 psd1 psm1; prisma; prolog: pro; promql; properties; proto; prql; psv; pug; puppet: pp; purescript: purs; python: py pyi pyw;
ql; qmljs: qml; r; racket: rkt; rasi; razor: cshtml razor; rbs; re2c: re; rego; rescript: res resi; robot; roc; ron; rst; rtf; ruby: rb; rust: rs;
scala; scheme: scm; scss; slang; smali; smalltalk: st; smithy; sml: fun sig sml; snakemake: smk; solidity: sol; souffle: dl; sourcepawn: inc sp; sparql; sql; sql_bigquery: bq; squirrel: nut squirrel; stan; starlark: bzl star; superhtml: shtml; svelte; sway: sw; swift; systemverilog: sv svh;
tablegen: td; tact; tcl; teal: tl; templ; tera; terraform: tf tfvars; textproto: pbtxt textproto; thrift; tlaplus: tla; todotxt; toml; tsv; tsx; turtle: ttl; twig; typescript: cts mts ts; typespec: tsp; typoscript: tsconfig typoscript; typst;
uxntal: tal; v; vb; verilog; vhdl: vhd vhdl; vhs: tape; vim; vrl; vue; wast; wat; wgsl; wit; wolfram: wl; xml: xml xsl xslt; yaml: yaml yml; yuck; zig; ziggy; zsh
"""
DOCS = "asciidoc bibtex djot doxygen html javadoc jsdoc latex luadoc markdown markdown_inline mermaid norg norg_meta org phpdoc po rst rtf vimdoc".split()
CONFIG = (
    "beancount capnp cedarschema comment cooklang cpon desktop devicetree diff dtd editorconfig ebnf git_config gitattributes gitcommit gitignore godot_resource gomod gosum gowork gpg hjson hocon "
    "ini kdl ledger pem pgn properties proto requirements ron smithy ssh_config textproto thrift todotxt toml turtle typespec wit xcompose xml yaml ziggy_schema"
).split()
DATA = "csv json json5 psv tsv".split()
CONTENT = ("code", "docs", "config")


def _table() -> dict[str, str]:
    out = {}
    for entry in LANGUAGES.replace("\n", " ").split(";"):
        name, _, exts = entry.strip().partition(":")
        for e in (exts or name).split():
            out["." + e] = name
    return out


EXTENSIONS = _table()


def content_type(language: str) -> str:
    """code, docs, config, or data, which no search covers."""
    return "docs" if language in DOCS else "config" if language in CONFIG else "data" if language in DATA else "code"


def extension_table(spark: SparkSession) -> DataFrame:
    """``(ext, language, content_type)``: a constant of a few hundred rows."""
    return spark.createDataFrame([(e, n, content_type(n)) for e, n in sorted(EXTENSIONS.items())], "ext string, language string, content_type string")


def detect(files: DataFrame, path_col: str = "file_path") -> DataFrame:
    """The files with their ``language``; null for unknown extensions."""
    ext = extension_table(files.sparkSession).select("ext", "language")
    return files.withColumn("__ext", extension(F.col(path_col))).join(F.broadcast(ext), F.col("__ext") == F.col("ext"), "left").drop("__ext", "ext")


def by_language(table: DataFrame) -> DataFrame:
    """``(language, extensions)``, the extensions in order."""
    return table.groupBy("language").agg(F.sort_array(F.collect_list("ext")).alias("extensions"))


def content_extensions(table: DataFrame, types: tuple[str, ...], extra: tuple[str, ...] = ()) -> DataFrame:
    """``(ext)``: distinct extensions of the kinds of content, and ``extra`` ones, in order."""
    rows = table.filter(F.col("content_type").isin(*types)).select("ext")
    if extra:
        rows = rows.union(table.sparkSession.createDataFrame([(e,) for e in extra], "ext string"))
    return rows.distinct().orderBy("ext")


def extensions_for(types: tuple[str, ...], extra: tuple[str, ...] = ()) -> list[str]:
    """The same on the driver, for walking."""
    return sorted({e for e, n in EXTENSIONS.items() if content_type(n) in types} | set(extra))
