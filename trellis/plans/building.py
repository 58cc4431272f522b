"""Queries of the build, upkeep and session operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import slug
from trellis.operators import build as b
from trellis.operators import graph as g
from trellis.operators import sessions as s
from trellis.plans.structure import WITH
from trellis.sources import table
from trellis.sources.parse import parse_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def _symbols(spark, d):
    return g.clean_symbols(table(spark, d, "symbols").drop("loaded_at"))


def _edges(spark, d):
    return g.clean_edges(table(spark, d, "edges"))


def _bodies(spark, d):
    return table(spark, d, "files").select("id", "path").join(table(spark, d, "file_texts").select(F.col("file_id").alias("id"), "body"), "id")


@add("language_map", """WITH m(e, l) AS (VALUES
  ('.ts', 'typescript'), ('.tsx', 'typescript'), ('.js', 'javascript'), ('.jsx', 'javascript'), ('.mjs', 'javascript'), ('.py', 'python'), ('.go', 'go'), ('.rs', 'rust'), 
  ('.rb', 'ruby'), ('.tf', 'hcl'), ('.tfvars', 'hcl'), ('.yml', 'yaml'), ('.yaml', 'yaml'), ('.md', 'markdown'), ('.c', 'c'), ('.h', 'c'), ('.m', 'objc'), ('.mm', 'objc'), 
  ('.java', 'java'), ('.php', 'php'), ('.swift', 'swift'), ('.sh', 'bash'), ('.bash', 'bash'), ('.zsh', 'bash'), ('.pl', 'perl'), ('.pm', 'perl'), ('.html', 'html'), ('.htm', 'html'), 
  ('.toml', 'toml'), ('.sql', 'sql'), ('Dockerfile', 'dockerfile'), ('.cpp', 'cpp'), ('.cc', 'cpp'), ('.cxx', 'cpp'), ('.hpp', 'cpp'), ('.hh', 'cpp'), ('.cs', 'csharp'), 
  ('.kt', 'kotlin'), ('.kts', 'kotlin'), ('.dart', 'dart'), ('.scala', 'scala'), ('.sc', 'scala'), ('.r', 'r'), ('.R', 'r'), ('.graphql', 'graphql'), ('.gql', 'graphql'), 
  ('.ps1', 'powershell'), ('.psm1', 'powershell'))
  SELECT id, coalesce((SELECT l FROM m WHERE e = regexp_extract(base, '^.+(\\.[^.]*)$', 1)), (SELECT l FROM m WHERE e = base)) AS language FROM (SELECT id, string_split(path, '/')[-1] AS base FROM files)""")
def _(spark, d):
    return table(spark, d, "files").select("id", b.language_of("path").alias("language"))


@add("parse_symbols")
def _(spark, d):
    files = _bodies(spark, d).withColumn("language", b.language_of("path")).filter(~b.is_dense("body"))
    return parse_files(files)[0].select("file", "name", "kind", "line_start", "line_end")


@add("call_kinds", "SELECT id, CASE WHEN name IN ('addEventListener', 'on', 'once', 'addListener', 'subscribe', 'observe') THEN 'listens' WHEN name IN ('emit', 'dispatch', 'trigger', 'fire', 'publish', 'send', 'broadcast') THEN 'emits' WHEN name IN ('spawn', 'fork') THEN 'spawns' ELSE 'calls' END AS kind FROM symbols")
def _(spark, d):
    return table(spark, d, "symbols").select("id", b.call_kind("name").alias("kind"))


@add("minified_skip", r"SELECT file_id FROM (SELECT file_id, strlen(body) AS n, len(body) - len(replace(body, chr(10), '')) + CASE WHEN body = '' OR ends_with(body, chr(10)) THEN 0 ELSE 1 END AS l FROM file_texts) WHERE n > 5000 AND n // greatest(l, 1) > 500")
def _(spark, d):
    return table(spark, d, "file_texts").filter(b.is_dense("body")).select("file_id")


@add("content_hash_diff", "SELECT path, sha256(body) AS hash FROM files JOIN file_texts ON file_id = id WHERE id % 10 = 0")
def _(spark, d):
    now = _bodies(spark, d)
    known = now.select("path", F.sha2(F.when(F.col("id") % 10 == 0, F.concat("body", F.lit("x"))).otherwise(F.col("body")).cast("binary"), 256).alias("hash"))
    return b.changed_files(now, known)


_GONE = "gone AS (SELECT path FROM f WHERE language = 'ruby')"


@add("stale_purge", WITH + f", {_GONE}, k AS (SELECT id FROM s WHERE file NOT IN (SELECT path FROM gone)) SELECT id FROM e WHERE from_id IN (FROM k) AND to_id IN (FROM k)")
def _(spark, d):
    files = table(spark, d, "files")
    gone = b.stale_files(files, files.filter("language is null or language != 'ruby'"))
    return b.purge(files, _symbols(spark, d), _edges(spark, d), gone)[2].select("id")


@add("outgoing_reset", WITH + f", {_GONE} SELECT id FROM e WHERE from_id NOT IN (SELECT id FROM s WHERE file IN (FROM gone))")
def _(spark, d):
    gone = table(spark, d, "files").filter("language = 'ruby'").select("path")
    return b.reset_outgoing(_edges(spark, d), _symbols(spark, d), gone).select("id")


@add("identity_match", WITH + """, o AS (SELECT id, file, name, kind, row_number() OVER (PARTITION BY file, name, kind ORDER BY line_start, id) AS n FROM s WHERE id % 11 <> 0),
  w AS (SELECT id + 1000000000 AS id, file, name, kind, row_number() OVER (PARTITION BY file, name, kind ORDER BY line_start + 5, id) AS n FROM s WHERE id % 13 <> 0)
  SELECT w.id AS new_id, o.id AS old_id, CASE WHEN o.id IS NULL THEN 'insert' WHEN w.id IS NULL THEN 'delete' ELSE 'keep' END AS change FROM o FULL JOIN w USING (file, name, kind, n)""")
def _(spark, d):
    rows = _symbols(spark, d).select("id", "file", "name", "kind", "line_start")
    new = rows.filter("id % 13 != 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("line_start", F.col("line_start") + 5)
    return b.reuse_ids(rows.filter("id % 11 != 0"), new)


@add("symbol_upsert", WITH + """, o AS (SELECT id, name, kind, file, line_start FROM s WHERE id % 11 <> 0), w AS (SELECT id + 1000000000 AS id, name, kind, file, line_start + 5 AS line_start FROM s WHERE id % 13 <> 0 AND id % 2 = 0),
  g AS (SELECT DISTINCT file FROM w), a AS (SELECT *, row_number() OVER (PARTITION BY file, name, kind ORDER BY line_start, id) AS n FROM o WHERE file IN (FROM g)), b AS (SELECT *, row_number() OVER (PARTITION BY file, name, kind ORDER BY line_start, id) AS n FROM w),
  m AS (SELECT b.*, a.id AS old_id FROM b LEFT JOIN a USING (file, name, kind, n))
  SELECT id, name, kind, file, line_start FROM o WHERE file NOT IN (FROM g) UNION ALL SELECT old_id, name, kind, file, line_start FROM m WHERE old_id IS NOT NULL
  UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY file, line_start, name, kind, id), name, kind, file, line_start FROM m WHERE old_id IS NULL""")
def _(spark, d):
    rows = _symbols(spark, d).select("id", "name", "kind", "file", "line_start")
    new = rows.filter("id % 13 != 0 and id % 2 = 0").withColumn("id", F.col("id") + 1_000_000_000).withColumn("line_start", F.col("line_start") + 5)
    return b.upsert_symbols(rows.filter("id % 11 != 0"), new)


@add("embed_sync_plan", WITH + """, w AS (SELECT file, name, kind, concat_ws(chr(10), kind || ' ' || name, signature, substring(content, 1, 512)) AS text FROM s), v AS (SELECT file, symbol_name AS name, symbol_kind AS kind, CASE WHEN id % 3 = 0 THEN text ELSE concat_ws(chr(10), symbol_kind || ' ' || symbol_name, text) END AS text FROM vectors WHERE symbol_kind <> 'memory'),
  a AS (SELECT file, name, kind, text, count(*) AS n FROM w GROUP BY ALL), z AS (SELECT file, name, kind, text, count(*) AS n FROM v GROUP BY ALL),
  d AS (SELECT coalesce(a.file, z.file) AS file, coalesce(a.n, 0) - coalesce(z.n, 0) AS d FROM a FULL JOIN z ON a.file IS NOT DISTINCT FROM z.file AND a.name IS NOT DISTINCT FROM z.name AND a.kind IS NOT DISTINCT FROM z.kind AND a.text IS NOT DISTINCT FROM z.text)
  SELECT file, 'embed' AS action, CAST(sum(d) AS BIGINT) AS n FROM d WHERE d > 0 GROUP BY 1 UNION ALL SELECT file, 'delete', CAST(-sum(d) AS BIGINT) FROM d WHERE d < 0 GROUP BY 1""")
def _(spark, d):
    from trellis.operators.embedding import sync_plan

    text = lambda kind, name, *rest: F.concat_ws("\n", F.concat(kind, F.lit(" "), name), *rest).alias("text")
    wanted = _symbols(spark, d).select("file", F.col("name").alias("symbol_name"), F.col("kind").alias("symbol_kind"), text("kind", "name", "signature", F.substring("content", 1, 512)))
    stored = table(spark, d, "vectors").filter("symbol_kind != 'memory'").select("id", "file", "symbol_name", "symbol_kind", F.when(F.col("id") % 3 == 0, F.col("text")).otherwise(text("symbol_kind", "symbol_name", "text")).alias("text"))
    missing, stale = sync_plan(wanted, stored)
    count = lambda df, action: df.groupBy("file").agg(F.count(F.lit(1)).alias("n")).withColumn("action", F.lit(action))
    return count(missing, "embed").unionByName(count(stale.join(stored.select("id", "file"), "id"), "delete")).select("file", "action", "n")


@add("embed_plan_diff", WITH + """, w AS (SELECT file, name, kind, count(*) AS w FROM s WHERE content IS NOT NULL OR signature IS NOT NULL GROUP BY ALL), v AS (SELECT file, symbol_name AS name, symbol_kind AS kind, count(*) AS v FROM vectors WHERE symbol_kind <> 'memory' GROUP BY ALL)
  SELECT file, name, kind, CASE WHEN coalesce(w, 0) > coalesce(v, 0) THEN 'embed' ELSE 'delete' END AS action, abs(coalesce(w, 0) - coalesce(v, 0)) AS n FROM w FULL JOIN v ON w.file IS NOT DISTINCT FROM v.file AND w.name IS NOT DISTINCT FROM v.name AND w.kind IS NOT DISTINCT FROM v.kind
  WHERE coalesce(w, 0) <> coalesce(v, 0)""".replace("SELECT file, name, kind, CASE", "SELECT coalesce(w.file, v.file) AS file, coalesce(w.name, v.name) AS name, coalesce(w.kind, v.kind) AS kind, CASE"))
def _(spark, d):
    stored = table(spark, d, "vectors").filter("symbol_kind != 'memory'").select("file", F.col("symbol_name").alias("name"), F.col("symbol_kind").alias("kind"))
    return b.embed_plan(g.embed_eligible(_symbols(spark, d)), stored, ["file", "name", "kind"])


def _sites(spark, d):
    """Edges seen as call sites: by name, every third one behind a receiver."""
    sym, e = _symbols(spark, d).select("id", "name", "file"), _edges(spark, d)
    a, z = sym.select(F.col("id").alias("from_id"), F.col("name").alias("caller"), "file"), sym.select(F.col("id").alias("to_id"), F.col("name").alias("callee"))
    owner = table(spark, d, "symbols").filter("lower(kind) = 'class'").groupBy("file").agg(F.min("name").alias("owner"))
    rows = e.drop("file").join(a, "from_id").join(z, "to_id").join(owner, "file", "left")
    return rows.select(F.col("id").alias("call_id"), "file", "caller", "callee", F.when(F.col("id") % 3 == 0, F.coalesce("owner", F.lit("it"))).alias("receiver"), "kind").distinct()


_SITES = WITH + """, o AS (SELECT file, min(name) AS owner FROM s WHERE kind = 'Class' GROUP BY 1),
c AS (SELECT DISTINCT e.id AS call_id, a.file, a.name AS caller, z.name AS callee, CASE WHEN e.id % 3 = 0 THEN coalesce(owner, 'it') END AS receiver, e.kind FROM e JOIN s a ON a.id = e.from_id JOIN s z ON z.id = e.to_id LEFT JOIN o ON o.file = a.file),
place AS (SELECT file, name, min(id) AS id FROM s GROUP BY 1, 2),
via AS (SELECT a.file, z.name, arg_max(z.file, e.id) AS target FROM e JOIN s a ON a.id = e.from_id JOIN s z ON z.id = e.to_id WHERE e.kind = 'imports' GROUP BY 1, 2),
held AS (SELECT k.name AS receiver, i.name AS callee, min(i.id) AS id FROM s k JOIN s i ON i.file = k.file AND i.line_start >= k.line_start AND i.line_end <= k.line_end WHERE k.kind IN ('Class', 'Interface', 'Module') GROUP BY 1, 2)
"""


@add("edge_resolution", _SITES + """SELECT c.call_id, p0.id AS from_id, coalesce(p1.id, p2.id, h.id, n.id) AS to_id, c.kind, CASE WHEN coalesce(p1.id, p2.id, h.id) IS NOT NULL THEN 1.0::DOUBLE WHEN c.receiver IS NOT NULL THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS confidence
  FROM c JOIN place p0 ON p0.file = c.file AND p0.name = c.caller LEFT JOIN place p1 ON p1.file = c.file AND p1.name = c.callee LEFT JOIN via ON via.file = c.file AND via.name = c.callee LEFT JOIN place p2 ON p2.file = via.target AND p2.name = c.callee
  LEFT JOIN held h ON h.receiver = c.receiver AND h.callee = c.callee LEFT JOIN (SELECT name, min(id) AS id FROM s GROUP BY 1) n ON n.name = c.callee WHERE coalesce(p1.id, p2.id, h.id, n.id) IS NOT NULL""")
def _(spark, d):
    sym, e = _symbols(spark, d), _edges(spark, d).filter("kind = 'imports'").drop("file")
    a, z = sym.select(F.col("id").alias("from_id"), "file"), sym.select(F.col("id").alias("to_id"), "name", F.col("file").alias("target"))
    imported = e.join(a, "from_id").join(z, "to_id").select(F.col("id").alias("import_id"), "file", "name", "target")
    return b.resolve_calls(_sites(spark, d), sym, imported)


_IMPORTS = _SITES + """, i AS (SELECT DISTINCT e.id AS import_id, a.file, z.name, CASE WHEN e.id % 2 = 0 THEN z.file END AS target FROM e JOIN s a ON a.id = e.from_id JOIN s z ON z.id = e.to_id WHERE e.kind = 'imports')
"""


@add("import_edges", _IMPORTS + """SELECT i.import_id, f0.id AS from_id, coalesce(p.id, n.id) AS to_id, 'imports' AS kind FROM i JOIN (SELECT file, min(id) AS id FROM s GROUP BY 1) f0 ON f0.file = i.file
  LEFT JOIN place p ON p.file = i.target AND p.name = i.name LEFT JOIN (SELECT name, min(id) AS id FROM s GROUP BY 1) n ON n.name = i.name WHERE coalesce(p.id, n.id) IS NOT NULL""")
def _(spark, d):
    sym, e = _symbols(spark, d), _edges(spark, d).filter("kind = 'imports'").drop("file")
    a, z = sym.select(F.col("id").alias("from_id"), "file"), sym.select(F.col("id").alias("to_id"), "name", F.col("file").alias("target"))
    rows = e.join(a, "from_id").join(z, "to_id").select(F.col("id").alias("import_id"), "file", "name", "target").distinct()
    return b.import_edges(rows.select("import_id", "file", "name"), sym, rows.filter("import_id % 2 = 0").select("import_id", "target"))


@add("import_targets", r"""WITH i AS (SELECT id, regexp_replace(path, '/?[^/]*$', '') || '/./' || CASE WHEN id % 2 = 0 THEN regexp_extract(path, '([^/]*)\.[^./]*$', 1) ELSE regexp_extract(path, '([^/]*)$', 1) END AS loc FROM files),
  t AS (SELECT id, replace(loc, '/./', '/') || x AS path, k FROM i, (VALUES ('', 1), ('.ts', 2), ('.tsx', 3), ('.js', 4), ('.jsx', 5), ('.mjs', 6), ('/index.ts', 7), ('/index.js', 8)) v(x, k))
  SELECT t.id AS import_id, arg_min(t.path, t.k) AS target FROM t JOIN (SELECT DISTINCT path FROM files) f USING (path) GROUP BY 1""".replace("\\\\", "\\"))
def _(spark, d):
    files = table(spark, d, "files").select("id", "path")
    stem = F.when(F.col("id") % 2 == 0, F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1)).otherwise(F.regexp_extract("path", r"([^/]*)$", 1))
    imports = files.select(F.col("id").alias("import_id"), F.col("path").alias("file"), F.concat(F.lit("./"), stem).alias("source"), F.lit("x").alias("name"))
    return b.resolve_imports(imports, files, normalize=True)


@add("markdown_links", r"""SELECT doc_id, target FROM (SELECT doc_id, unnest(list_distinct(list_concat(regexp_extract_all(text, '\[[^\]\n]*\]\(([^)\s]+)\)', 1), regexp_extract_all(text, '\[\[([^\]|#\n]+)', 1)))) AS target FROM (SELECT doc_id, text || ' [a](docs/' || project || '.md) [[Page ' || source || ']] [b](https://x.y)' AS text FROM documents)) WHERE NOT regexp_matches(target, '^https?://')""")
def _(spark, d):
    linked = F.concat("text", F.lit(" [a](docs/"), "project", F.lit(".md) [[Page "), "source", F.lit("]] [b](https://x.y)"))
    return b.markdown_links(table(spark, d, "documents").select("doc_id", linked.alias("text")), "doc_id")


@add("slugs", r"""SELECT id, regexp_replace(regexp_replace(lower(regexp_extract(path, '([^/]*)/*$', 1)), '[ _]', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g') AS slug FROM files""")
def _(spark, d):
    return table(spark, d, "files").select("id", slug("path").alias("slug"))


@add("markdown_outline", r"""WITH l AS (SELECT doc_id, generate_subscripts(x, 1) AS i, unnest(x) AS line, len(x) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
  o AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^\s*(```|~~~)') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) % 2 AS open FROM l),
  h AS (SELECT doc_id, i, n, len(regexp_extract(line, '^(#+)', 1)) AS level, trim(regexp_replace(regexp_replace(line, '^#+\s+', ''), '\s+$', '')) AS name FROM o WHERE open = 0 AND regexp_matches(line, '^#{1,6}\s+\S'))
  SELECT doc_id, i AS line_start, coalesce((SELECT min(z.i) FROM h z WHERE z.doc_id = h.doc_id AND z.i > h.i AND z.level <= h.level) - 1, n) AS line_end, CAST(level AS INTEGER) AS level, name, CASE WHEN level <= 2 THEN 'Class' ELSE 'Type' END AS kind FROM h""")
def _(spark, d):
    return b.markdown_symbols(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


# ---------------------------------------------------------------- sessions

_EV = "WITH ev AS (SELECT event_id, user_id AS session, event_type AS terms, ts FROM events) "


def _events(spark, d):
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("session"), F.col("event_type").alias("terms"), F.col("ts").cast("timestamp_ntz").alias("ts"))


@add("search_cache_dedup", _EV + "SELECT event_id, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY session, terms ORDER BY ts, event_id)) < 180000000, false) AS skipped FROM ev")
def _(spark, d):
    return s.repeated_searches(_events(spark, d)).select("event_id", "skipped")


@add("turn_checkpoint", _EV + "SELECT event_id, session, CAST(turn AS INTEGER) AS turn FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY ts, event_id) AS turn FROM ev) WHERE turn % 10 = 0")
def _(spark, d):
    return s.checkpoints(_events(spark, d)).select("event_id", "session", "turn")


@add("once_per_session", _EV + "SELECT event_id, session FROM ev QUALIFY row_number() OVER (PARTITION BY session ORDER BY ts, event_id) = 1")
def _(spark, d):
    return s.first_of_session(_events(spark, d)).select("event_id", "session")


@add("daily_throttle", _EV.replace("WITH", "WITH RECURSIVE", 1) + """, t AS (SELECT DISTINCT epoch_us(ts) // 1000000 AS sec FROM ev),
  n AS (SELECT sec, min(sec) OVER (ORDER BY sec RANGE BETWEEN 86400 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM t),
  w(sec) AS (SELECT min(sec) FROM t UNION ALL SELECT n.nxt FROM w JOIN n USING (sec)) SELECT sec AS run_at FROM w WHERE sec IS NOT NULL""")
def _(spark, d):
    return s.daily_runs(_events(spark, d)).select(F.col("at").alias("run_at"))


@add("session_expiry", _EV + "SELECT session FROM ev GROUP BY 1 HAVING max(ts) < TIMESTAMP '2024-02-01' - INTERVAL 2 DAY")
def _(spark, d):
    return s.idle_sessions(_events(spark, d), "2024-02-01 00:00:00").select("session")


@add("session_history", _EV + "SELECT event_id, session, terms FROM ev ORDER BY CAST(ts AS DATE) DESC, ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    return s.history(_events(spark, d)).select("event_id", "session", "terms")
