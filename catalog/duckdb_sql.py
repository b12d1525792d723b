"""The registered queries as DuckDB SQL, composed from shared CTEs."""

from __future__ import annotations

S = r"[\t-\r\x1c-\x20\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"
LINE_END = r"\r\n|[\n-\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BLOCK = rf"(?s)\A{S}*/\*(.*?)\*/{S}*"
LINES = rf"\A{S}*(?://[^\n]*\n)+{S}*"
PACKAGE = rf"(?m)^{S}*package{S}+([\p{{L}}\p{{N}}_.]+){S}*;"
CLASS = rf"class{S}+({W}+)"
METHOD = rf"(?:public|protected|private)[^\n]*?{S}+({W}+){S}*\([^\n]*?\){S}*\{{"
CALL = rf"({W}+){S}*\("
# Names that are never taken for a call.
STOP = """
'if', 'for', 'while', 'switch', 'catch', 'return', 'new', 'throw', 'try', 'else',
'do', 'synchronized', 'super', 'this', 'eval',
'String', 'INT', 'ROW', 'FIELD', 'FLOAT', 'BOOLEAN', 'explicit',
'hashCode', 'equals', 'toString', 'clone', 'finalize', 'wait', 'notify', 'notifyAll'"""
NL = "chr(10)"
GRID = "round({0} * 1e9) / 1e9"

# -- CTEs ------------------------------------------------------------------------

CORPUS = rf"""
corpus AS (
  SELECT doc_id, lang,
    '/corpus/' || lang || '/' || source || '/Doc' || doc_id
      || CASE lang WHEN 'en' THEN '.java' WHEN 'fr' THEN '.JAVA' WHEN 'de' THEN '.Java' ELSE '.txt' END AS file_path,
    CASE source
      WHEN 'src0' THEN {NL} || '/* Licensed under some terms.' || {NL} || ' * Copyright holders */' || {NL} || {NL}
      WHEN 'src1' THEN '/* plain words */' || {NL}
      WHEN 'src2' THEN '  // License line' || {NL} || '// second line' || {NL} || {NL}
      WHEN 'src3' THEN '// plain line' || {NL}
      WHEN 'src4' THEN '/* COPYRIGHT */ // Apache' || {NL} || '//' || {NL}
      ELSE '' END
    || CASE WHEN lang IN ('en', 'fr') THEN ' package corpus.' || lang || ' ;' || {NL} ELSE '' END
    || CASE WHEN lang IN ('en', 'de') THEN 'public class Doc' || doc_id || ' {{' || {NL} ELSE '' END
    || regexp_replace(regexp_replace(text, '(\p{{L}}),', '\1(),', 'g'),
         '([a-z]{{2,4}})\.\n', 'private void \1() {{ \1(); }}' || {NL}, 'g')
    || {NL} || '}}' || {NL}
    || CASE WHEN lang = 'en' THEN '}}' || {NL} || 'class Aux' || doc_id || ' {{' || {NL} ELSE '' END AS source_text
  FROM documents)"""


def strip_block(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower(regexp_extract({column}, '{BLOCK}', 1)), "
        f"'license|copyright|apache software foundation|licensed to the apache') "
        f"THEN regexp_replace({column}, '{BLOCK}', '') ELSE {column} END"
    )


def strip_line(column: str) -> str:
    return (
        f"CASE WHEN regexp_matches(lower(regexp_extract({column}, '{LINES}')), 'apache|license|copyright') "
        f"THEN regexp_replace({column}, '{LINES}', '') ELSE {column} END"
    )


def names_of(source: str, columns: str) -> str:
    """CTEs from a (…, code) relation to names and local calls."""
    return rf"""
sites AS (
  SELECT {columns}, code,
    nullif(regexp_extract(code, '{PACKAGE}', 1), '') AS package,
    regexp_extract_all(code, '{CLASS}', 1) AS classes,
    regexp_extract_all(code, '{METHOD}', 1) AS methods,
    regexp_extract_all(code, '{CALL}', 1) AS call_sites
  FROM {source}),
names AS (
  SELECT *, list_filter(call_sites, lambda c: list_contains(methods, c) AND c NOT IN ({STOP})) AS calls
  FROM sites)"""


NAMES = (
    CORPUS
    + f"""
, bodies AS (SELECT *, {strip_block("source_text")} AS body FROM corpus)
, coded AS (SELECT doc_id, lang, file_path, {strip_line("body")} AS code FROM bodies)
, """
    + names_of("coded", "doc_id, lang, file_path")
)


def fragments_of(columns: str) -> str:
    return f"""
fragment_names AS (
  SELECT {columns}, code, package, classes, calls, 'class' AS type, unnest(classes) AS name FROM names
  UNION ALL
  SELECT {columns}, code, package, classes, calls, 'method' AS type, unnest(methods) AS name FROM names),
fragments AS (
  SELECT {columns}, code, type,
    CASE type WHEN 'class' THEN concat_ws('.', package, name)
      ELSE concat_ws('.', package, classes[1], name) END AS symbol,
    CASE type WHEN 'class' THEN calls
      ELSE list_transform(list_filter(calls, lambda c: c <> name),
        lambda c: concat_ws('.', package, classes[1], c)) END AS calls
  FROM fragment_names)"""


FRAGMENTS = NAMES + "," + fragments_of("doc_id, lang, file_path")


def edges_of(where: str = "TRUE", name: str = "edges") -> str:
    return f"""
{name}_from AS (
  SELECT package, classes[1] AS cls, unnest(list_distinct(methods)) AS m, list_distinct(calls) AS cs
  FROM names WHERE {where}),
{name}_pairs AS (SELECT package, cls, m, unnest(cs) AS c FROM {name}_from),
{name} AS (
  SELECT DISTINCT concat_ws('.', package, cls, m) AS caller, concat_ws('.', package, cls, c) AS callee
  FROM {name}_pairs WHERE m <> c)"""


EDGES = NAMES + "," + edges_of()

LINKS = """
edges AS (
  SELECT DISTINCT regexp_extract(url, '^https?://([^/?#]+)', 1) AS caller,
    unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS callee
  FROM pages)"""


def neighbours(n: int) -> str:
    return f"""
ends AS (
  SELECT callee AS target, 'in' AS side, caller AS name FROM edges
  UNION ALL SELECT caller, 'out', callee FROM edges),
near AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY target, side ORDER BY name) AS rn FROM ends)
  WHERE rn <= {n}),
neighbours AS (
  SELECT target,
    coalesce(list(name ORDER BY name) FILTER (side = 'in'), []) AS callers,
    coalesce(list(name ORDER BY name) FILTER (side = 'out'), []) AS callees
  FROM near GROUP BY target)"""


def vectors_of(prefix: str, source: str, key: str, text: str) -> str:
    """CTEs {prefix}_cells (key, slot, value, zeros left out) and {prefix}_norms."""
    return rf"""
{prefix}_words AS (
  SELECT {key} AS key, unnest(regexp_extract_all(
    lower(regexp_replace({text}, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '{W}+')) AS w
  FROM {source}),
{prefix}_slots AS (SELECT key, ('0x' || substr(md5(w), 1, 8))::BIGINT % 128 AS s FROM {prefix}_words),
{prefix}_cells AS (
  SELECT key, s % 64 AS slot, sum(CASE WHEN s < 64 THEN 1 ELSE -1 END)::DOUBLE AS v
  FROM {prefix}_slots GROUP BY ALL),
{prefix}_norms AS (
  SELECT a.{key} AS key, sqrt(coalesce(sum(v * v), 0)) AS norm
  FROM {source} a LEFT JOIN {prefix}_cells c ON a.{key} = c.key GROUP BY ALL)"""


def scores(base: str, query: str) -> str:
    """CTE scored(query_id, key, score) for all pairs."""
    return f"""
dots AS (
  SELECT q.key AS query_id, b.key, sum(q.v * b.v) AS dot
  FROM {query}_cells q JOIN {base}_cells b USING (slot) GROUP BY ALL),
scored AS (
  SELECT q.key AS query_id, b.key,
    CASE WHEN q.norm * b.norm = 0 THEN 0.0
      ELSE {GRID.format("(coalesce(d.dot, 0) / (q.norm * b.norm))")} END AS score
  FROM {query}_norms q CROSS JOIN {base}_norms b
  LEFT JOIN dots d ON d.query_id = q.key AND d.key = b.key)"""


DENSE = """
SELECT k.doc_id, array_to_string(list(coalesce(c.v, 0)::INT::VARCHAR ORDER BY k.slot), ',') AS vector
FROM (SELECT doc_id, slot FROM documents CROSS JOIN range(64) r(slot)) k
LEFT JOIN d_cells c ON c.key = k.doc_id AND c.slot = k.slot
GROUP BY k.doc_id"""

# Ten best fragments per benchmark text over the Java corpus.
HITS = (
    FRAGMENTS
    + ", with_names AS (SELECT * FROM names WHERE len(classes) + len(methods) > 0), "
    + vectors_of("d", "with_names", "file_path", "code")
    + ","
    + vectors_of("q", "benchmark", "item_id", "text")
    + ","
    + scores("d", "q")
    + """
, best_files AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS place FROM scored)
  WHERE place <= 10),
ranked AS (
  SELECT * FROM (
    SELECT s.query_id, s.score, f.type, f.symbol, f.file_path,
      row_number() OVER (PARTITION BY s.query_id
        ORDER BY s.score DESC, f.file_path, f.symbol, f.type) AS rank
    FROM best_files s JOIN fragments f ON f.file_path = s.key)
  WHERE rank <= 10),
hits AS (SELECT r.*, c.code FROM ranked r JOIN coded c USING (file_path))"""
)


def join_names(column: str) -> str:
    return f"coalesce(array_to_string({column}, ','), '')"


def lines_of(text: str) -> str:
    parts = f"string_split_regex({text}, '{LINE_END}')"
    return f"CASE WHEN {parts}[-1] = '' THEN list_slice({parts}, 1, len({parts}) - 1) ELSE {parts} END"


def escaped(text: str) -> str:
    return f"replace(replace(replace({text}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


PREVIEW = f"""CASE WHEN code = '' THEN '[no code stored for this fragment]'
  ELSE array_to_string(list_slice(l, 1, 8), {NL}) || CASE WHEN len(l) > 8 THEN {NL} || '...' ELSE '' END END"""


def graph_text(symbol: str, callers: str, callees: str) -> str:
    return f"""array_to_string(list_concat(
      ['graph LR' || {NL} || '  target["' || {symbol} || '"]'],
      list_transform({callers}, lambda c: '  caller_' || substr(md5(c), 1, 16) || '(["' || c || '"]) --> target'),
      list_transform({callees}, lambda c: '  target --> callee_' || substr(md5(c), 1, 16) || '(["' || c || '"]) ')
    ), {NL})"""


DOC_FILES = "files AS (SELECT '/docs/' || doc_id AS file_path, md5(text) AS hash FROM documents)"
STATE = """
state AS (
  SELECT '/docs/' || doc_id AS file_path,
    md5(CASE WHEN toxic = 1 THEN text || ' before' ELSE text END) AS hash
  FROM documents JOIN labels USING (doc_id))"""
MIXED = """
mixed AS (
  SELECT vec_id, CASE label WHEN 0 THEN NULL WHEN 1 THEN [] WHEN 2
      THEN list_transform(embedding, lambda x: 0.0::DOUBLE) ELSE embedding::DOUBLE[] END AS v
  FROM embeddings)"""
PAGE_NAMES = (
    rf"""
coded AS (
  SELECT page_id, 'class Page' || page_id || {NL}
    || regexp_replace(html, 'href="/([A-Za-z]+)"', ' private void \1() {{ }}', 'g') || {NL} AS code
  FROM pages),"""
    + names_of("coded", "page_id")
    + ","
    + fragments_of("page_id")
)
PAGE_INDEX = f"WITH {PAGE_NAMES} SELECT md5(code) AS hash, type, symbol, len(calls) AS n_calls FROM fragments"


def fragment_copies(runs: int) -> str:
    return f"WITH {FRAGMENTS} SELECT file_path, type, symbol, {runs} * count(*) AS copies FROM fragments GROUP BY ALL"


def cosine(a: str, b: str) -> str:
    dot = f"list_dot_product({a}, {b})"
    lengths = f"(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
    return f"CASE WHEN {lengths} = 0 THEN 0.0 ELSE {GRID.format(f'({dot} / {lengths})')} END"


REPORT = f"""
WITH {HITS}, {edges_of()}, {neighbours(12)}
SELECT query_id, rank, score,
  {escaped("type || ' · ' || symbol")} AS title,
  {escaped("'File: ' || file_path || ' · Score: ' || printf('%.4f', score)")} AS meta,
  {escaped(f"array_to_string(list_slice({lines_of('code')}, 1, 60), {NL})")} AS snippet,
  {escaped(graph_text("symbol", "coalesce(n.callers, [])", "coalesce(n.callees, [])"))} AS graph
FROM hits LEFT JOIN neighbours n ON hits.symbol = n.target"""

SQL = {
    "scan_filter": f"WITH {CORPUS} SELECT doc_id, file_path FROM corpus WHERE lower(file_path) LIKE '%.java'",
    "field_defaults": f"""
WITH {CORPUS}
SELECT c.doc_id, CASE WHEN c.lang = 'es' THEN '-' ELSE file_path END AS file_path,
  CASE WHEN c.lang = 'fr' THEN 0 ELSE length(d.text) END AS code_chars
FROM corpus c JOIN documents d USING (doc_id)""",
    "decode_text": rf"""
SELECT doc_id, regexp_replace(text, '\r\n?', {NL}, 'g') || {NL} || 'xy' || {NL}
  || CASE WHEN lang = 'en' THEN 'z' ELSE chr(65533) END AS decoded FROM documents""",
    "content_md5": "SELECT doc_id, md5(text) AS hash FROM documents",
    "incremental_changed": f"""
WITH {DOC_FILES}, {STATE}
SELECT f.file_path, f.hash FROM files f
WHERE NOT EXISTS (SELECT 1 FROM state s WHERE s.file_path = f.file_path AND s.hash = f.hash)""",
    "incremental_counts": f"""
WITH {DOC_FILES}, {STATE},
flagged AS (SELECT s.hash IS NOT NULL AS same FROM files f LEFT JOIN state s USING (file_path, hash))
SELECT count(*) AS discovered, count_if(same) AS skipped, count_if(NOT same) AS processed,
  'incremental' AS mode FROM flagged
UNION ALL SELECT count(*), 0, count(*), 'full' FROM files""",
    "hash_upsert": f"""
WITH {DOC_FILES}, {STATE},
old AS (SELECT * FROM state UNION ALL SELECT '/gone' || file_path, hash FROM state)
SELECT coalesce(f.file_path, o.file_path) AS file_path, coalesce(f.hash, o.hash) AS hash
FROM old o FULL JOIN files f ON o.file_path = f.file_path""",
    "strip_license_block": f"WITH {CORPUS} SELECT doc_id, {strip_block('source_text')} AS code FROM corpus",
    "strip_license_line": f"WITH {CORPUS} SELECT doc_id, {strip_line('source_text')} AS code FROM corpus",
    "strip_license": f"WITH {NAMES} SELECT file_path, code FROM coded",
    "package_of": f"""
WITH {CORPUS}
SELECT doc_id, nullif(regexp_extract(source_text, '{PACKAGE}', 1), '') AS package FROM corpus""",
    "classes_of": f"""
WITH {CORPUS}
SELECT doc_id, {join_names(f"regexp_extract_all(source_text, '{CLASS}', 1)")} AS classes FROM corpus""",
    "methods_of": f"""
WITH {CORPUS}
SELECT doc_id, {join_names("m")} AS methods, len(list_distinct(m)) AS distinct_methods
FROM (SELECT doc_id, regexp_extract_all(source_text, '{METHOD}', 1) AS m FROM corpus)""",
    "calls_of": f"""
WITH {CORPUS}
SELECT doc_id, {join_names(f"regexp_extract_all(source_text, '{CALL}', 1)")} AS calls FROM corpus""",
    "local_calls": f"WITH {NAMES} SELECT file_path, {join_names('calls')} AS calls FROM names",
    "fragments": f"""
WITH {FRAGMENTS}
SELECT type, symbol, file_path, md5(code) AS code_md5, len(calls) AS n_calls,
  md5({join_names("calls")}) AS calls_md5 FROM fragments""",
    "call_edges": f"WITH {EDGES} SELECT caller, callee FROM edges",
    "edges_from_fragments": f"""
WITH {FRAGMENTS}
SELECT DISTINCT caller, callee FROM (
  SELECT symbol AS caller, unnest(calls) AS callee FROM fragments WHERE type = 'method')""",
    "method_nodes": f"WITH {EDGES} SELECT caller AS name FROM edges UNION SELECT callee FROM edges",
    "graph_counts": f"""
WITH {EDGES}
SELECT (SELECT count(*) FROM (SELECT caller FROM edges UNION SELECT callee FROM edges)) AS methods,
  (SELECT count(*) FROM edges) AS calls""",
    "edges_merge": f"""
WITH {EDGES}, {edges_of("lang = 'en'", "english")},
merged AS (SELECT * FROM english UNION SELECT * FROM edges)
SELECT (SELECT count(*) FROM (SELECT caller FROM merged UNION SELECT callee FROM merged)) AS methods,
  (SELECT count(*) FROM merged) AS calls""",
    "edges_new": f"""
WITH {EDGES}, {edges_of("lang = 'en'", "english")}
SELECT caller, callee FROM edges EXCEPT SELECT caller, callee FROM english""",
    "link_edges": f"WITH {LINKS} SELECT caller, callee FROM edges",
    "link_counts": f"""
WITH {LINKS}
SELECT (SELECT count(*) FROM (SELECT caller FROM edges UNION SELECT callee FROM edges)) AS methods,
  (SELECT count(*) FROM edges) AS calls""",
    "link_neighbours": f"""
WITH {LINKS}, {neighbours(10)}
SELECT target, {join_names("callers")} AS callers, {join_names("callees")} AS callees FROM neighbours""",
    "neighbours_topn": f"""
WITH {EDGES}, {neighbours(10)}
SELECT target, {join_names("callers")} AS callers, {join_names("callees")} AS callees FROM neighbours""",
    "callers_lookup": f"WITH {LINKS} SELECT caller AS name FROM edges WHERE callee = '/the' ORDER BY 1 LIMIT 10",
    "callees_lookup": f"""
WITH {LINKS} SELECT callee AS name FROM edges WHERE caller = (
  SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) FROM pages WHERE page_id = 0) ORDER BY 1 LIMIT 12""",
    "valid_vectors": f"WITH {MIXED} SELECT vec_id, len(v) AS dims FROM mixed WHERE len(v) > 0",
    "vector_norms": f"""
WITH {MIXED}
SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm,
  round(list_dot_product(v, list_reverse(v)), 6) AS dot_reversed,
  {cosine("v", "list_reverse(v)")} AS cosine_reversed
FROM mixed WHERE len(v) > 0""",
    "cosine_topk": f"""
WITH wide AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (
  SELECT b.vec_id, b.label, {cosine("b.v", "q.v")} AS score
  FROM wide b, (SELECT v FROM wide WHERE vec_id = 0) q)
SELECT vec_id, label, score FROM scored ORDER BY scored.score DESC, vec_id LIMIT 10""",
    "knn_batch": f"""
WITH wide AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (
  SELECT q.vec_id AS query_id, b.vec_id, {cosine("b.v", "q.v")} AS score FROM wide q CROSS JOIN wide b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, rank, score FROM ranked WHERE rank <= 10""",
    "knn_blocks": f"""
WITH wide AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
scored AS (
  SELECT 'v' || q.vec_id AS query_id, b.vec_id, {cosine("b.v", "q.v")} AS score FROM wide q CROSS JOIN wide b),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, vec_id, rank, score FROM ranked WHERE rank <= 10""",
    "hash_embed": f"WITH {vectors_of('d', 'documents', 'doc_id', 'text')} {DENSE}",
    "embed_dedup_join": f"WITH {vectors_of('d', 'documents', 'doc_id', 'text')} {DENSE}",
    "embed_errors": "SELECT doc_id FROM documents WHERE lang = 'es'",
    "model_embed": """
SELECT doc_id, CASE WHEN encoded THEN length(text) END AS n_chars,
  CASE WHEN encoded THEN length(text) - length(replace(text, 'e', '')) END AS n_e
FROM (SELECT doc_id, text, NOT contains(text, '@') AND length(text) % 5 <> 0 AS encoded FROM documents)""",
    "text_search": f"""
WITH {vectors_of("d", "documents", "doc_id", "text")}, {vectors_of("q", "benchmark", "item_id", "text")},
{scores("d", "q")},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored)
SELECT query_id, rank, key AS doc_id, score FROM ranked WHERE rank <= 10""",
    "fragment_search": f"""
WITH {HITS} SELECT query_id, rank, type, symbol, file_path, score FROM hits""",
    "single_search": f"""
WITH {HITS},
cut AS (
  SELECT *, {lines_of(rf"regexp_replace(code, '\A{S}+|{S}+\z', '', 'g')")} AS l FROM hits WHERE query_id = 0)
SELECT rank, type, substr(symbol, 1, 55) AS symbol, substr(file_path, 1, 40) AS file_path, {PREVIEW} AS preview,
  score FROM cut""",
    "search_context": f"""
WITH {HITS}, {edges_of()}, {neighbours(10)}
SELECT query_id, rank, type, substr(symbol, 1, 55) AS symbol, substr(file_path, 1, 40) AS file_path,
  CASE WHEN rank <= 5 THEN {join_names("n.callers")} ELSE '' END AS callers,
  CASE WHEN rank <= 5 THEN {join_names("n.callees")} ELSE '' END AS callees
FROM hits LEFT JOIN neighbours n ON hits.symbol = n.target""",
    "code_preview": f"""
WITH {NAMES},
shown AS (SELECT file_path, CASE WHEN file_path LIKE '%.txt' THEN '' ELSE code END AS code FROM coded),
cut AS (
  SELECT file_path, code, {lines_of(rf"regexp_replace(code, '\A{S}+|{S}+\z', '', 'g')")} AS l FROM shown)
SELECT file_path, {PREVIEW} AS preview FROM cut""",
    "report_rows": REPORT,
    "report_written": f"""
WITH {HITS}
SELECT query_id, rank, {escaped("type || ' · ' || symbol")} AS title,
  {escaped("'File: ' || file_path || ' · Score: ' || printf('%.4f', score)")} AS meta FROM hits""",
    "report_graph_written": REPORT,
    "graph_text": f"""
WITH {LINKS}, {neighbours(12)}
SELECT target, {graph_text("target", "callers", "callees")} AS graph FROM neighbours""",
    "html_escape": f"SELECT page_id, {escaped('html')} AS escaped FROM pages",
    "index_preview": """
SELECT type, substr(symbol, 1, 60) AS symbol, dims, head FROM (
  SELECT 'label' || label AS type, 'vector number ' || vec_id || repeat('.', 60) AS symbol,
    len(embedding) AS dims,
    '[' || array_to_string(list_transform(embedding[1:5], lambda x: printf('%.4f', x::DOUBLE)), ', ')
      || ' ...]' AS head
  FROM embeddings ORDER BY type, symbol LIMIT 25)""",
    "index_preview_stored": f"""
WITH {FRAGMENTS}
SELECT type, substr(symbol, 1, 60) AS symbol, 64 AS dims FROM (
  SELECT * FROM fragments ORDER BY file_path, type, symbol LIMIT 25)""",
    "index_errors": f"""
WITH {FRAGMENTS}
SELECT 1 AS run, file_path, type, symbol,
       'ValueError: ' || CASE WHEN contains(code, '@') THEN 'not encoded'
                              ELSE 'the model returned a vector of another width' END AS error
FROM fragments WHERE contains(code, '@') OR length(code) % 5 = 0""",
    "index_runs": """
SELECT 1 AS run, count(*) AS discovered, 0 AS skipped, count(*) AS processed FROM documents
UNION ALL SELECT 2, count(*), count_if(lang <> 'de'), count_if(lang = 'de') FROM documents
UNION ALL SELECT 3, count(*), 0, count(*) FROM documents""",
    "index_hashes": f"""
WITH {CORPUS}
SELECT file_path, md5(CASE WHEN lang = 'de' THEN source_text || '// edited' || {NL} ELSE source_text END) AS hash
FROM corpus""",
    "index_edges": f"WITH {EDGES} SELECT caller, callee FROM edges",
    "index_summary": f"""
WITH {EDGES}, {fragments_of("file_path")}
SELECT 'discovered' AS metric, count(*) AS value FROM corpus
UNION ALL SELECT 'skipped', 0
UNION ALL SELECT 'processed', count(*) FROM corpus
UNION ALL SELECT 'fragments', count(*) FROM fragments
UNION ALL SELECT 'methods', count(*) FROM (SELECT caller FROM edges UNION SELECT callee FROM edges)
UNION ALL SELECT 'calls', count(*) FROM edges""",
    "index_fragments": fragment_copies(2),
    "index_latest": fragment_copies(1),
    "index_replaced": f"""
WITH {FRAGMENTS}
SELECT file_path, type, symbol, count(*) AS copies FROM fragments WHERE lang <> 'fr' GROUP BY ALL""",
    "index_replaced_edges": f"""
WITH {EDGES}, {edges_of("lang <> 'fr'", "left_edges")}
SELECT caller, callee FROM left_edges""",
    "index_hidden": PAGE_INDEX,
    "index_files": PAGE_INDEX,
    "index_stream": PAGE_INDEX,
    "purge_counts": f"""
WITH {FRAGMENTS}
SELECT 'fragments' AS table_name, count(*) AS deleted FROM fragments
UNION ALL SELECT 'file_hashes', count(*) FROM corpus""",
}
