"""DuckDB SQL for the engine's queries, put together from named parts."""

from __future__ import annotations

import re

from glyphmill.functions.tokens import TOKEN
from glyphmill.operators import boosts
from glyphmill.plans import corpus


def split(tok: str) -> str:
    """split_identifier as SQL; RE2 has no lookahead, so humps are parted beforehand."""
    low = f"lower({tok})"
    snake = f"list_filter(string_split({low}, '_'), lambda s: s <> '')"
    humps = f"list_transform(regexp_extract_all(regexp_replace({tok}, '([A-Z]+)([A-Z][a-z])', '\\1_\\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda s: lower(s))"
    parts = f"(CASE WHEN contains({tok}, '_') THEN {snake} ELSE {humps} END)"
    return f"(CASE WHEN NOT regexp_matches({tok}, '[A-Z0-9_]') OR len({parts}) < 2 THEN [{low}] ELSE list_concat([{low}], {parts}) END)"


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_words = "|".join(boosts.KEYWORDS)
_sql_words = "|".join(boosts.SQL_KEYWORDS)
_esc = "regexp_replace({n}, '([.*+?^${{}}()|\\[\\]\\\\])', '\\\\\\1', 'g')"


def defines(content: str, name: str) -> str:
    n = _esc.format(n=name)
    out = []
    for flags, words in (("(?m)", _words), ("(?im)", _sql_words)):
        out.append(f"regexp_matches({content}, '{flags}(?:^|\\s)(?:{words})\\s+(?:[A-Za-z_]\\w*(?:\\.|::))*' || {n} || '(?:\\s|[<({{:\\[;]|$)')")
    return f"({' OR '.join(out)})"


def forms(stem: str) -> str:
    return f"[{stem}, replace({stem}, '_', ''), rtrim({stem}, 's'), rtrim(replace({stem}, '_', ''), 's')]"


def tier(content: str, stem: str, names: str, unit: str) -> str:
    hit = f"len(list_filter({names}, lambda n: {defines(content, 'n')})) > 0"
    named = f"len(list_filter({names}, lambda n: list_contains({forms(stem)}, lower(n)))) > 0"
    return f"(CASE WHEN {hit} THEN {unit} * (CASE WHEN {named} THEN 1.5 ELSE 1.0 END) ELSE 0.0 END)"


TEST_FILE = "(?:^|/)(?:test_[^/]*\\.(?:py|cpp|c|dart|lua)|[^/]*_test\\.(?:py|go|rb|cpp|c|dart|lua)|[^/]*\\.(?:test|spec)\\.[jt]sx?)$"
PENALTY = f"""(CASE WHEN regexp_matches(file_path, '{TEST_FILE}') OR regexp_matches(file_path, '(?:^|/)(?:tests?|__tests__|spec|testing)(?:/|$)') THEN 0.3::DOUBLE ELSE 1.0 END
 * CASE WHEN regexp_extract(file_path, '[^/]*$') IN ('__init__.py', 'package-info.java') THEN 0.5::DOUBLE ELSE 1.0 END
 * CASE WHEN regexp_matches(file_path, '(?:^|/)(?:_?compat|legacy)(?:/|$)') THEN 0.3::DOUBLE ELSE 1.0 END
 * CASE WHEN regexp_matches(file_path, '(?:^|/)(?:_?examples?|docs?_src)(?:/|$)') THEN 0.3::DOUBLE ELSE 1.0 END
 * CASE WHEN regexp_matches(file_path, '\\.d\\.ts$') THEN 0.7::DOUBLE ELSE 1.0 END)"""

_near = "(w = p OR (least(strlen(w), strlen(p)) >= 3 AND (starts_with(w, p) OR starts_with(p, w))))"
_sep = "list_last(string_split(text, {s}))"
_name = f"(CASE WHEN contains(text, '::') THEN {_sep.format(s=quote('::'))} WHEN contains(text, chr(92)) THEN {_sep.format(s='chr(92)')} WHEN contains(text, '->') THEN {_sep.format(s=quote('->'))} WHEN contains(text, '.') THEN {_sep.format(s=quote('.'))} ELSE trim(text) END)"
_emb = f"list_distinct(regexp_extract_all(text, {quote(boosts.IN_TEXT)}))"
_kw = f"list_distinct(list_transform(list_filter(regexp_extract_all(text, {quote(boosts.WORD)}), lambda w: length(w) > 2 AND NOT list_contains({list(boosts.STOPWORDS)}, lower(w))), lambda w: lower(w)))"

#: Parts in order; each may use those before it.
PARTS = {
    "chunks": corpus.CHUNKS[len("chunks AS (") : -1],
    "asked": corpus.QUERIES[len("asked AS (") : -1],
    "named": "SELECT *, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\\.[^.]*$', '') AS stem, regexp_extract(file_path, '([^/]+)/[^/]*$', 1) AS folder FROM chunks",
    "raw": f"SELECT chunk_id, unnest(regexp_extract_all(content || ' ' || stem || ' ' || stem || ' ' || replace(regexp_replace(file_path, '/[^/]*$', ''), '/', ' '), '{TOKEN}')) AS tok FROM named",
    "spelt": f"SELECT tok, unnest({split('tok')}) AS term FROM (SELECT DISTINCT tok FROM raw)",
    "counts": "SELECT chunk_id, term, count(*) AS tf FROM raw JOIN spelt USING (tok) GROUP BY ALL",
    "dls": "SELECT chunk_id, sum(tf) AS dl FROM counts GROUP BY ALL",
    "dfs": "SELECT term, count(*) AS df FROM counts GROUP BY ALL",
    "corp": "SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(dl) FROM dls)::DOUBLE / (SELECT count(*) FROM chunks) AS avgdl",
    "qlist": f"SELECT query_id, flatten(list_transform(regexp_extract_all(text, '{TOKEN}'), lambda tok: {split('tok')})) AS l FROM asked",
    "qterms": "SELECT query_id, term, min(i) AS pos FROM (SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS i FROM qlist) GROUP BY ALL",
    "contribs": "SELECT query_id, chunk_id, pos, ln(1.0::DOUBLE + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS c FROM qterms JOIN dfs USING (term) JOIN counts USING (term) JOIN dls USING (chunk_id), corp",
    "bm": "SELECT query_id, chunk_id, list_reduce(list_prepend(0.0::DOUBLE, list(c ORDER BY pos)), lambda a, x: CAST(CAST(a + x AS FLOAT) AS DOUBLE)) AS score FROM contribs GROUP BY ALL",
    "bmk": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS bm_rank FROM bm WHERE score > 0) WHERE bm_rank <= 25",
    "norms": "SELECT vec_id, list_transform(list_transform(embedding, lambda x: x::DOUBLE / n), lambda x: x::FLOAT::DOUBLE) AS v FROM (SELECT vec_id, embedding, (CASE WHEN s = 0 THEN 1 ELSE sqrt(s) END) AS n FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS s FROM embeddings))",
    "qvecs": "SELECT query_id, v FROM asked JOIN norms ON query_id % 500 = vec_id WHERE trim(text) <> ''",
    "semk": "SELECT * FROM (SELECT q.query_id, n.vec_id AS chunk_id, row_number() OVER (PARTITION BY q.query_id ORDER BY round(list_dot_product(q.v, n.v), 12) DESC, n.vec_id) AS sem_rank FROM qvecs q, norms n) WHERE sem_rank <= 25",
    "spec": f"""SELECT *, coalesce(alpha0, CASE WHEN symbol THEN 0.3 ELSE 0.5 END)::DOUBLE AS alpha, CASE WHEN symbol THEN list_distinct([name, trim(text)]) ELSE emb END AS names, CASE WHEN symbol THEN 3.0 ELSE 1.5 END::DOUBLE AS scale,
 CASE WHEN symbol THEN [lower(name)] ELSE list_transform(emb, lambda s: lower(s)) END AS look, CASE WHEN symbol THEN [] ELSE kw END AS words
 FROM (SELECT query_id, text, alpha AS alpha0, regexp_matches(trim(text), {quote(boosts.SYMBOL)}) AS symbol, {_name} AS name, {_emb} AS emb, {_kw} AS kw FROM asked WHERE trim(text) <> '')""",
    "blended": "SELECT query_id, chunk_id, sem_rank, bm_rank, alpha * coalesce(1.0::DOUBLE / (60 + sem_rank), 0) + (1 - alpha) * coalesce(1.0::DOUBLE / (60 + bm_rank), 0) AS score FROM semk FULL JOIN bmk USING (query_id, chunk_id) JOIN spec USING (query_id)",
    "cand": "SELECT b.query_id, b.chunk_id, file_path, content, lower(stem) AS stem, folder, b.score, row_number() OVER (PARTITION BY b.query_id ORDER BY start_line, sem_rank NULLS LAST, bm_rank) AS ord FROM blended b JOIN named USING (chunk_id)",
    "summed": "SELECT *, sum(score) OVER (PARTITION BY query_id, file_path) AS fs, row_number() OVER (PARTITION BY query_id, file_path ORDER BY score DESC, ord) AS best, max(score) OVER (PARTITION BY query_id) AS mx FROM cand",
    "coherent": "SELECT query_id, chunk_id, file_path, content, stem, folder, ord, score + CASE WHEN best = 1 AND mx <> 0 AND mfs > 0 THEN 0.2::DOUBLE * mx * fs / mfs ELSE 0 END AS score FROM (SELECT *, max(fs) OVER (PARTITION BY query_id) AS mfs FROM summed)",
    "topped": "SELECT query_id, max(score) AS top FROM coherent GROUP BY ALL",
    "matched": f"SELECT c.*, top, names, scale, CASE WHEN len(words) = 0 THEN 0 ELSE len(list_filter(words, lambda w: len(list_filter(list_concat({split('stem')}, {split('folder')}), lambda p: {_near})) > 0))::DOUBLE / len(words) END AS ratio FROM coherent c JOIN topped USING (query_id) JOIN spec USING (query_id)",
    "lifted": f"SELECT query_id, chunk_id, file_path, ord, score + CASE WHEN ratio >= 0.1 THEN top * ratio ELSE 0 END + {tier('content', 'stem', 'names', 'top * scale')} AS score FROM matched",
    "inject": f"""SELECT query_id, chunk_id, file_path, chunk_id + 1099511627776 AS ord, {tier('content', 'st', 'names', 'top * scale')} AS score FROM (SELECT *, lower(stem) AS st FROM named) n JOIN spec ON len(look) > 0 AND CASE WHEN symbol THEN list_contains({forms('st')}, look[1])
 ELSE len(list_filter(look, lambda s: s = st OR s = replace(st, '_', '') OR (strlen(st) >= 4 AND starts_with(s, st)) OR (strlen(replace(st, '_', '')) >= 4 AND starts_with(s, replace(st, '_', ''))))) > 0 END JOIN topped USING (query_id)
 WHERE NOT EXISTS (SELECT 1 FROM cand WHERE cand.query_id = spec.query_id AND cand.chunk_id = n.chunk_id)""",
    "boosted": "SELECT query_id, chunk_id, file_path, ord, score FROM lifted UNION ALL SELECT query_id, chunk_id, file_path, ord, score FROM inject WHERE score <> 0",
    "penalised": f"SELECT b.*, b.score * CASE WHEN alpha < 1 THEN {PENALTY} ELSE 1 END AS pen FROM boosted b JOIN spec USING (query_id)",
    "effective": "SELECT *, pen * pow(0.5, row_number() OVER (PARTITION BY query_id, file_path ORDER BY pen DESC, ord) - 1) AS eff FROM penalised",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY eff DESC, pen DESC, ord) AS rank FROM effective",
    "records": "SELECT epoch(ts)::DOUBLE AS ts, event_type AS call, 1::BIGINT AS results, floor(value)::BIGINT AS snippet_chars, floor(value * (event_id % 5))::BIGINT AS file_chars FROM events",
}


def query(final: str) -> str:
    """The final select with the parts that it needs, and no others."""
    need: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name, body in PARTS.items():
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                need.add(name)
                todo.append(body)
    parts = ", ".join(f"{n} AS MATERIALIZED ({b})" for n, b in PARTS.items() if n in need)
    return f"WITH {parts} {final}" if parts else final
