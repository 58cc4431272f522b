"""Queries over the structural graph and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import graph as g
from trellis.sources import table

NAME, FILE, SYMBOL = "parse", "runtime/core/dispatch.ts", 3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WITH = r"""WITH RECURSIVE e AS (
  SELECT DISTINCT id, from_id, to_id, lower(trim(kind)) AS kind, coalesce(confidence, 1.0) AS confidence, file FROM edges WHERE from_id IS NOT NULL AND to_id IS NOT NULL),
s AS (SELECT id, name, upper(trim(kind)[1:1]) || lower(trim(kind)[2:]) AS kind, file, line_start, line_end, signature, doc, content FROM symbols),
f AS (SELECT * FROM files),
fe AS (SELECT DISTINCT a.file AS src, b.file AS dst FROM e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE a.file <> b.file),
ends AS (SELECT from_id AS symbol_id, id AS edge_id FROM e UNION SELECT to_id, id FROM e),
callers AS (SELECT t.name AS of_name, e.id AS edge_id, e.kind AS edge_kind, e.confidence, c.id, c.name, c.kind, c.file, c.line_start, c.line_end FROM e JOIN s t ON t.id = e.to_id JOIN s c ON c.id = e.from_id),
callees AS (SELECT t.name AS of_name, t.file AS of_file, e.id AS edge_id, e.kind AS edge_kind, e.confidence, c.id, c.name, c.kind, c.file, c.line_start, c.line_end FROM e JOIN s t ON t.id = e.from_id JOIN s c ON c.id = e.to_id WHERE e.confidence >= 0.5)
"""


def add(name: str, sql: str):
    def keep(query):
        QUERIES[name] = lambda spark, d: query(*_tables(spark, d))
        SQL[name] = WITH + sql
        return query

    return keep


def _tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "files"), g.clean_symbols(table(spark, d, "symbols").drop("loaded_at")), g.clean_edges(table(spark, d, "edges"))


_ROW = ["id", "name", "kind", "file", "line_start", "line_end"]
_C = ", ".join(_ROW)


@add("find_symbol_exact", f"SELECT {_C} FROM s WHERE name = '{NAME}'")
def _(f, s, e):
    return g.find_symbol(s, NAME).select(*_ROW)


@add("find_symbol_suffix", f"SELECT {_C.replace('name', "split_part(file, '/', 2) || '.' || name AS name")} FROM s WHERE lower(name) = 'parse'")
def _(f, s, e):
    scoped = s.withColumn("name", F.concat(F.split_part("file", F.lit("/"), F.lit(2)), F.lit("."), "name"))
    return g.find_symbol(scoped, "Parse").select(*_ROW)


@add("find_symbol_kind_nocase", f"SELECT {_C} FROM s WHERE name = '{NAME}' AND kind = 'Function'")
def _(f, s, e):
    return g.find_symbol(s, NAME, kind="fUNCTION").select(*_ROW)


@add("symbols_in_file", f"SELECT {_C} FROM s WHERE file = '{FILE}'")
def _(f, s, e):
    return g.symbols_in_file(s, FILE).select(*_ROW)


@add("find_listeners", f"SELECT {_C} FROM s WHERE name = 'handle' AND kind IN ('Function', 'Method')")
def _(f, s, e):
    return g.find_listeners(s, "handle").select(*_ROW)


@add("is_indexed_file", f"SELECT count(*) > 0 AS indexed FROM f WHERE path = '{FILE}'")
def _(f, s, e):
    return g.is_indexed_file(f, FILE)


@add("files_in_languages", "SELECT id, path, language FROM f WHERE language IN ('go', 'rust')")
def _(f, s, e):
    return g.files_in_languages(f, ["go", "rust"]).select("id", "path", "language")


@add("language_exclusion", "SELECT id, file FROM s WHERE NOT EXISTS (FROM f WHERE path = s.file AND language IN ('python', 'go'))")
def _(f, s, e):
    return g.without_languages(s, f, ["python", "go"]).select("id", "file")


@add("all_symbols", f"SELECT {_C} FROM s")
def _(f, s, e):
    return s.select(*_ROW)


@add("embed_eligible", "SELECT id FROM s WHERE content IS NOT NULL OR signature IS NOT NULL")
def _(f, s, e):
    return g.embed_eligible(s).select("id")


@add("test_predicates", "SELECT id, contains(file, 'test') OR contains(file, 'spec') AS by_name, contains(file, '/tests/') OR contains(file, '/test/') OR contains(file, '_test.') OR contains(file, '.test.') AS by_path FROM s")
def _(f, s, e):
    return s.select("id", g.is_test_name("file").alias("by_name"), g.is_test_path("file").alias("by_path"))


@add("snippets", "SELECT id, array_to_string(string_split(content, chr(10))[1:3], chr(10)) AS snippet FROM s")
def _(f, s, e):
    return s.select("id", g.snippet("content").alias("snippet"))


@add("content_elision", """SELECT id, CASE WHEN len(l) > 100 THEN array_to_string(l[1:60], chr(10)) || chr(10) || '... ' || (len(l) - 80) || ' lines ...' || chr(10) || array_to_string(l[len(l) - 19:], chr(10)) ELSE content END AS shown
  FROM (SELECT id, content, string_split(content, chr(10)) AS l FROM s)""")
def _(f, s, e):
    return s.select("id", g.elide("content").alias("shown"))


_E = "edge_id, edge_kind, confidence, id, name, kind, file, line_start, line_end"


@add("callers", f"SELECT {_E} FROM callers WHERE of_name = '{NAME}'")
def _(f, s, e):
    return g.callers(e, s, NAME)


@add("callees", f"SELECT {_E} FROM callees WHERE of_name = '{NAME}'")
def _(f, s, e):
    return g.callees(e, s, NAME)


@add("callees_in_file", f"SELECT {_E} FROM callees WHERE of_name = 'run' AND of_file = 'runtime/core/ident.ts'")
def _(f, s, e):
    return g.callees(e, s, "run", "runtime/core/ident.ts")


@add("call_import_split", f"SELECT {_E}, CASE WHEN edge_kind = 'imports' THEN 'imports' ELSE 'calls' END AS part FROM callers WHERE of_name = '{NAME}' QUALIFY row_number() OVER (PARTITION BY name, file, line_start ORDER BY edge_id, id) = 1")
def _(f, s, e):
    return g.split_imports(g.callers(e, s, NAME))


@add("callers_page", f"SELECT edge_id, name, file FROM callers WHERE of_name = '{NAME}' ORDER BY edge_id, id LIMIT 20 OFFSET 10")
def _(f, s, e):
    return g.page(g.callers(e, s, NAME), ["edge_id", "id"], 10, 20).select("edge_id", "name", "file")


@add("definition_view", f"""SELECT 'definitions' AS section, name, kind, file, line_start FROM s WHERE name = '{NAME}'
  UNION ALL (SELECT CASE WHEN edge_kind = 'imports' THEN 'imported_by' ELSE 'callers' END, name, kind, file, line_start FROM callers WHERE of_name = '{NAME}' QUALIFY row_number() OVER (PARTITION BY name, file, line_start ORDER BY edge_id, id) = 1)
  UNION ALL (SELECT CASE WHEN edge_kind = 'imports' THEN 'imports' ELSE 'callees' END, name, kind, file, line_start FROM callees WHERE of_name = '{NAME}' QUALIFY row_number() OVER (PARTITION BY name, file, line_start ORDER BY edge_id, id) = 1)""")
def _(f, s, e):
    return g.definition_view(e, s, NAME)


@add("dead_code", "SELECT id, name, file, line_start FROM s WHERE kind IN ('Function', 'Method') AND NOT EXISTS (FROM e WHERE to_id = s.id) ORDER BY file, line_start, id LIMIT 50")
def _(f, s, e):
    return g.dead_code(e, s).select("id", "name", "file", "line_start")


@add("dead_code_kind", "SELECT id, name, file, line_start FROM s WHERE kind = 'Class' AND NOT EXISTS (FROM e WHERE to_id = s.id)")
def _(f, s, e):
    return g.dead_code(e, s, ("Class",), None).select("id", "name", "file", "line_start")


@add("detect_cycles", "SELECT a.src, a.dst FROM fe a JOIN fe b ON a.src = b.dst AND a.dst = b.src")
def _(f, s, e):
    return g.mutual_files(e, s)


@add("qualified_names", """SELECT s.id, CASE WHEN count(p.id) = 0 THEN s.name ELSE string_agg(p.name, '::' ORDER BY p.line_start, p.id) || CASE WHEN s.kind IN ('Function', 'Method') THEN '#' ELSE '::' END || s.name END AS qualified
  FROM s LEFT JOIN s p ON p.file = s.file AND p.kind IN ('Class', 'Interface', 'Module') AND p.line_start < s.line_start AND p.line_end > s.line_end AND p.id <> s.id GROUP BY s.id, s.name, s.kind""")
def _(f, s, e):
    return g.qualified_names(s)


@add("outline_flat", """SELECT a.id, arg_max(b.id, b.ord) AS parent_id, a.ord FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, line_end DESC, id) AS ord FROM s) a
  LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, line_end DESC, id) AS ord FROM s) b ON a.file = b.file AND b.ord < a.ord AND b.line_end >= a.line_end GROUP BY a.id, a.ord""")
def _(f, s, e):
    return g.outline(s)


@add("incident_edges", f"SELECT id, from_id, to_id, kind FROM e WHERE from_id = {SYMBOL} OR to_id = {SYMBOL}")
def _(f, s, e):
    return g.incident_edges(e, SYMBOL).select("id", "from_id", "to_id", "kind")


@add("file_deps", f"SELECT b.file, e.kind AS edge_kind, count(*) AS n_edges FROM e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE a.file = '{FILE}' AND b.file <> a.file GROUP BY ALL")
def _(f, s, e):
    return g.file_deps(e, s, FILE)


@add("file_reverse_deps", f"SELECT a.file, e.kind AS edge_kind, count(*) AS n_edges FROM e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE b.file = '{FILE}' AND b.file <> a.file GROUP BY ALL")
def _(f, s, e):
    return g.file_deps(e, s, FILE, reverse=True)


@add("top_connected", "SELECT file, count(DISTINCT edge_id) AS n_edges FROM s LEFT JOIN ends ON symbol_id = s.id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(f, s, e):
    return g.top_connected(e, s)


@add("connection_counts", "SELECT s.id, count(edge_id) AS n_edges FROM s LEFT JOIN ends ON symbol_id = s.id GROUP BY 1")
def _(f, s, e):
    return g.connections(e, s)


@add("out_degrees", "SELECT s.id, count(e.id) AS n_out FROM s LEFT JOIN e ON e.from_id = s.id GROUP BY 1")
def _(f, s, e):
    return g.out_degree(e, s)


@add("stats", "SELECT (SELECT count(*) FROM f) AS n_files, (SELECT count(*) FROM s) AS n_symbols, (SELECT count(*) FROM e) AS n_edges")
def _(f, s, e):
    return g.stats(f, s, e)


@add("language_breakdown", "SELECT language, count(*) AS n_files FROM f WHERE language IS NOT NULL GROUP BY 1")
def _(f, s, e):
    return g.language_breakdown(f)


@add("fn_impact_direct", f"SELECT count(*) AS n_callers, count(DISTINCT file) AS n_files FROM callers WHERE of_name = '{NAME}'")
def _(f, s, e):
    return g.direct_impact(e, s, NAME)


@add("similar_symbols", f"""SELECT id, name, file, round(1.0 / (1 + d + 2 * abs(n - o)), 6) AS score FROM (
  SELECT x.id, x.name, x.file, abs((x.line_end - x.line_start) - (m.line_end - m.line_start)) AS d, (SELECT count(*) FROM e WHERE from_id = x.id) AS n, (SELECT count(*) FROM e WHERE from_id = m.id) AS o
  FROM s x JOIN s m ON m.id = {SYMBOL} AND x.kind = m.kind AND x.id <> m.id WHERE d IS NOT NULL ORDER BY d, x.id LIMIT 30) ORDER BY score DESC, id LIMIT 10""")
def _(f, s, e):
    return g.similar_symbols(e, s, SYMBOL)


@add("file_subgraph", f"""SELECT id, true AS inside FROM s WHERE file = '{FILE}' UNION
  SELECT o.id, false FROM e JOIN s i ON i.file = '{FILE}' AND i.id IN (e.from_id, e.to_id) JOIN s o ON o.id IN (e.from_id, e.to_id) WHERE o.file <> '{FILE}'""")
def _(f, s, e):
    return g.file_subgraph(e, s, FILE)


_VIEW = "SELECT s.id, count(edge_id) AS n_edges FROM s LEFT JOIN ends ON symbol_id = s.id WHERE contains(file, 'lib/') AND s.kind = 'Method' AND file IN (SELECT path FROM f WHERE language = 'python') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1500"


@add("graph_view_topn", _VIEW)
def _(f, s, e):
    return g.graph_view(f, s, e, "lib/", "Method", "python")


@add("graph_view_edges", f", v AS ({_VIEW}) SELECT id, from_id, to_id FROM e WHERE from_id IN (SELECT id FROM v) AND to_id IN (SELECT id FROM v)")
def _(f, s, e):
    return g.induced_edges(e, g.graph_view(f, s, e, "lib/", "Method", "python")).select("id", "from_id", "to_id")


def _bfs(seeds: str, depth: int) -> str:
    return f", w(file, depth) AS (SELECT file, 0 FROM ({seeds}) UNION SELECT fe.src, w.depth + 1 FROM w JOIN fe ON fe.dst = w.file WHERE w.depth < {depth}) "


@add("impact", _bfs(f"SELECT '{FILE}' AS file", 5) + "SELECT file, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def _(f, s, e):
    return g.impact(e, s, [FILE])


@add("diff_impact", _bfs(f"SELECT unnest(['{FILE}', 'runtime/core/clock.ts']) AS file", 3) + "SELECT file FROM w GROUP BY 1 HAVING min(depth) > 0")
def _(f, s, e):
    return g.diff_impact(e, s, [FILE, "runtime/core/clock.ts"])


@add("diff_impact_kept", _bfs(f"SELECT '{FILE}' AS file", 3) + ", w2(file, depth) AS (SELECT 'runtime/core/clock.ts', 0 UNION SELECT fe.src, w2.depth + 1 FROM w2 JOIN fe ON fe.dst = w2.file WHERE w2.depth < 3) SELECT file FROM w GROUP BY 1 HAVING min(depth) > 0 UNION SELECT file FROM w2 GROUP BY 1 HAVING min(depth) > 0")
def _(f, s, e):
    return g.diff_impact(e, s, [FILE, "runtime/core/clock.ts"], keep_changed=True)


@add("fn_impact_files", _bfs(f"SELECT DISTINCT file FROM s WHERE name = '{NAME}'", 3) + "SELECT file, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1 HAVING min(depth) > 0")
def _(f, s, e):
    return g.function_impact(e, s, NAME)


@add("who_calls_chain", """, nk AS (SELECT DISTINCT t.name AS a_name, t.file AS a_file, c.name, c.file FROM e JOIN s t ON t.id = e.to_id JOIN s c ON c.id = e.from_id),
  w(name, file, depth) AS (SELECT DISTINCT name, file, 0 FROM s WHERE name = 'parse' UNION SELECT nk.name, nk.file, w.depth + 1 FROM w JOIN nk ON nk.a_name = w.name AND nk.a_file = w.file WHERE w.depth < 3)
  SELECT name, file, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1, 2 HAVING min(depth) > 0 ORDER BY 3, 2, 1 LIMIT 200""")
def _(f, s, e):
    return g.who_calls_chain(e, s, "parse")


_NEAR = f", w(id, depth) AS (SELECT CAST({SYMBOL} AS BIGINT), 0 UNION SELECT CASE WHEN e.from_id = w.id THEN e.to_id ELSE e.from_id END, w.depth + 1 FROM w JOIN e ON w.id IN (e.from_id, e.to_id) WHERE w.depth < 2), n AS (SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM w GROUP BY 1) "


@add("neighborhood", _NEAR + "SELECT id, depth FROM n")
def _(f, s, e):
    return g.neighborhood(e, SYMBOL, 2)[0]


@add("neighborhood_edges", _NEAR + "SELECT n.id AS at_id, e.id AS edge_id, from_id, to_id, kind FROM n JOIN e ON n.id IN (e.from_id, e.to_id) WHERE depth < 2")
def _(f, s, e):
    return g.neighborhood(e, SYMBOL, 2)[1]


_PROJECT = "split_part(file, '/', 2)"


@add("shared_symbols", f"SELECT name, kind, count(DISTINCT {_PROJECT}) AS n_projects FROM s GROUP BY 1, 2 HAVING count(DISTINCT {_PROJECT}) > 1")
def _(f, s, e):
    return g.shared_symbols(s.withColumn("project", F.split_part("file", F.lit("/"), F.lit(2))))


@add("infer_links", f""", p AS (SELECT DISTINCT {_PROJECT} AS project, name, kind FROM s)
  SELECT a.project AS from_project, b.project AS to_project, 'shares-pattern' AS type, 'Shared symbol: ' || min(struct_pack(n := a.name, k := a.kind)).n || ' (' || min(struct_pack(n := a.name, k := a.kind)).k || ')' AS reason, CAST(0.7 AS DOUBLE) AS confidence
  FROM p a JOIN p b ON a.name = b.name AND a.kind = b.kind AND a.project < b.project WHERE NOT (a.project = 'core' OR b.project = 'core') GROUP BY 1, 2""")
def _(f, s, e):
    s = s.withColumn("project", F.split_part("file", F.lit("/"), F.lit(2)))
    known = s.select(F.col("project").alias("to_project"), F.lit("core").alias("from_project")).distinct()
    return g.infer_links(s.filter("project is not null"), known)


@add("cross_query", f"SELECT {_PROJECT} AS project, id, name, kind, file, line_start, count(*) OVER (PARTITION BY {_PROJECT}) AS n FROM s WHERE name = '{NAME}' QUALIFY row_number() OVER (PARTITION BY {_PROJECT} ORDER BY file, line_start, id) <= 20")
def _(f, s, e):
    return g.cross_query(s.withColumn("project", F.split_part("file", F.lit("/"), F.lit(2))), NAME)


_LINKS = """, k AS (SELECT DISTINCT split_part(a.file, '/', 2) AS from_project, split_part(b.file, '/', 2) AS to_project, e.kind AS type FROM e JOIN s a ON a.id = e.from_id JOIN s b ON b.id = e.to_id WHERE from_project < to_project)"""


def _links(s, e):
    """Projects whose symbols an edge joins, as links."""
    at = lambda end, c: s.select(F.col("id").alias(end), F.split_part("file", F.lit("/"), F.lit(2)).alias(c))
    rows = e.join(at("from_id", "from_project"), "from_id").join(at("to_id", "to_project"), "to_id")
    return rows.filter("from_project < to_project").select("from_project", "to_project", F.col("kind").alias("type")).distinct()


@add("project_links", _LINKS + "SELECT from_project, to_project, type, CASE WHEN from_project = 'core' THEN 'out' ELSE 'in' END AS direction FROM k WHERE 'core' IN (from_project, to_project)")
def _(f, s, e):
    return g.project_links(_links(s, e), "core")


@add("link_add", _LINKS + "SELECT from_project, to_project, type, CASE WHEN type = 'calls' THEN 'new' ELSE 'old' END AS state FROM k")
def _(f, s, e):
    links = _links(s, e)
    new = links.filter("type = 'calls'").withColumn("state", F.lit("new"))
    return g.add_links(links.withColumn("state", F.lit("old")), new.unionByName(new))


@add("link_delete", _LINKS + "SELECT from_project, to_project, type FROM k WHERE (from_project, to_project) NOT IN (SELECT (from_project, to_project) FROM k WHERE type = 'calls')")
def _(f, s, e):
    links = _links(s, e)
    return g.delete_links(links, links.filter("type = 'calls'").select(F.col("to_project").alias("from_project"), F.col("from_project").alias("to_project")))


@add("export_dot_lines", f"""SELECT '  n' || id || ' [label="' || replace(name, '"', chr(92) || '"') || '"];' AS line FROM s WHERE file = '{FILE}'
  UNION ALL SELECT '  n' || from_id || ' -> n' || to_id || ' [label="' || e.kind || '"];' FROM e WHERE from_id IN (SELECT id FROM s WHERE file = '{FILE}')""")
def _(f, s, e):
    from trellis.operators.export import dot_lines

    own = g.symbols_in_file(s, FILE)
    return dot_lines(own, e.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi"))


@add("export_mermaid_lines", f"""SELECT '  n' || id || '["' || replace(name, '"', chr(39)) || '"]' AS line FROM s WHERE file = '{FILE}'
  UNION ALL SELECT '  n' || from_id || ' -->|' || e.kind || '| n' || to_id FROM e WHERE from_id IN (SELECT id FROM s WHERE file = '{FILE}')""")
def _(f, s, e):
    from trellis.operators.export import mermaid_lines

    own = g.symbols_in_file(s, FILE)
    return mermaid_lines(own, e.join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi"))


@add("export_json_lines", f"SELECT CAST(to_json(struct_pack(id := id, name := name, kind := kind)) AS VARCHAR) AS line FROM s WHERE file = '{FILE}'")
def _(f, s, e):
    from trellis.operators.export import json_lines

    return json_lines(g.symbols_in_file(s, FILE).select("id", "name", "kind"))


@add("page_names", r"""SELECT id, regexp_replace(regexp_replace(name, '[/\\:<>|?*"`]', '_', 'g'), '^_+|_+$', '', 'g') AS page FROM (SELECT id, kind || ':' || name || '/?' AS name FROM s)""")
def _(f, s, e):
    from trellis.operators.export import page_name

    return s.select("id", F.concat("kind", F.lit(":"), "name", F.lit("/?")).alias("name")).select("id", page_name("name").alias("page"))


@add("vault_pages", f"""{""}, own AS (SELECT * FROM s WHERE file = '{FILE}'), k AS (SELECT name, count(*) AS n FROM own GROUP BY 1),
  p AS (SELECT own.*, regexp_replace(regexp_replace(name, '[/\\\\:<>|?*"`]', '_', 'g'), '^_+|_+$', '', 'g') || CASE WHEN n > 1 THEN ' (' || regexp_extract(file, '([^/.]+)[^/]*$', 1) || ')' ELSE '' END AS page FROM own JOIN k USING (name)),
  ee AS (SELECT from_id, to_id FROM e WHERE from_id IN (SELECT id FROM own) AND to_id IN (SELECT id FROM own)),
  u AS (SELECT ee.from_id AS id, list_sort(list(DISTINCT page)) AS l FROM ee JOIN p ON p.id = ee.to_id GROUP BY 1), v AS (SELECT ee.to_id AS id, list_sort(list(DISTINCT page)) AS l FROM ee JOIN p ON p.id = ee.from_id GROUP BY 1)
  SELECT page, '---' || chr(10) || 'kind: ' || kind || chr(10) || 'file: ' || file || chr(10) || '---' || chr(10) || '# ' || name || chr(10)
    || CASE WHEN u.l IS NULL THEN '' ELSE chr(10) || '## Uses' || chr(10) || array_to_string(list_transform(u.l, lambda x: '- [[' || x || ']]'), chr(10)) || chr(10) END
    || CASE WHEN v.l IS NULL THEN '' ELSE chr(10) || '## Used by' || chr(10) || array_to_string(list_transform(v.l, lambda x: '- [[' || x || ']]'), chr(10)) || chr(10) END AS body
  FROM p LEFT JOIN u ON u.id = p.id LEFT JOIN v ON v.id = p.id""")
def _(f, s, e):
    from trellis.operators.export import vault_pages

    own = g.symbols_in_file(s, FILE)
    return vault_pages(own, g.induced_edges(e, own.select("id")))
