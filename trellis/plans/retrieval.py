"""Queries over text, vectors and memory, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.functions.text import one_line
from trellis.operators import graph as g
from trellis.operators import memory as m
from trellis.operators import search as r
from trellis.operators.postings import Postings, bm25_postings, build_postings
from trellis.plans.structure import WITH
from trellis.sources import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = "2025-09-01 00:00:00"


def add(name: str, sql: str | None = None):
    def keep(query):
        QUERIES[name] = query
        if sql:
            SQL[name] = sql
        return query

    return keep


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    return g.clean_symbols(table(spark, d, "symbols").drop("loaded_at"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return g.clean_edges(table(spark, d, "edges"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return r.usable_vectors(table(spark, d, "vectors"))


_INDEX: dict[tuple[str, str], Postings] = {}


def postings(spark: SparkSession, d: str) -> Postings:
    """Postings of the symbols of a folder, written once for each session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEX:
        _INDEX[key] = build_postings(_symbols(spark, d))
    return _INDEX[key]


# ---------------------------------------------------------------- full text

_TOKENS = r"regexp_extract_all(strip_accents(lower(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"
_COLS = {"name": 10, "signature": 5, "doc": 3, "content": 1}


def _count(c: str, phrase: list[str]) -> str:
    if len(phrase) == 1:
        return f"len(list_filter(w_{c}, lambda x: starts_with(x, '{phrase[0]}')))"
    n = len(phrase)
    test = " AND ".join([f"w_{c}[i + {k}] = '{p}'" for k, p in enumerate(phrase[:-1])] + [f"starts_with(w_{c}[i + {n - 1}], '{phrase[-1]}')"])
    return f"len(list_filter(range(1, len(w_{c}) - {n - 2}), lambda i: {test}))"


def bm25_sql(query: str, source: str = "s") -> str:
    """A chain of common table expressions that ends in ``bm(id, name, kind, file, line_start, score)``."""
    ph = r.phrases(query)
    words = ", ".join(f"{_TOKENS.format(c)} AS w_{c}" for c in _COLS)
    f = ", ".join("CAST(" + " + ".join(f"{w} * {_count(c, p)}" for c, w in _COLS.items()) + f" AS DOUBLE) AS f{i}" for i, p in enumerate(ph))
    n = ", ".join(f"sum(CASE WHEN f{i} > 0 THEN 1 ELSE 0 END) AS n{i}" for i in range(len(ph)))
    score = " ".join(f"- greatest(ln((N - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)), 1e-6::DOUBLE) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))" for i in range(len(ph)))
    any_ = " + ".join(f"f{i}" for i in range(len(ph)))
    return f"""tok AS (SELECT id, name, kind, file, line_start, {words} FROM {source}),
    cnt AS (SELECT id, name, kind, file, line_start, CAST({' + '.join(f'len(w_{c})' for c in _COLS)} AS DOUBLE) AS len, {f} FROM tok),
    facts AS (SELECT count(*) AS N, avg(len) AS avg, {n} FROM cnt),
    bm AS (SELECT id, name, kind, file, line_start, 0 {score} AS score FROM cnt, facts WHERE {any_} > 0)"""


_SYM = WITH.replace("WITH RECURSIVE", "WITH RECURSIVE ", 1)


@add("bm25_single", f"{_SYM}, {bm25_sql('cache')} SELECT id, round(score, 9) AS score FROM bm ORDER BY bm.score, id LIMIT 20")
def _(spark, d):
    return bm25_postings(postings(spark, d), "cache").orderBy("score", "id").limit(20).select("id", F.round("score", 9).alias("score"))


@add("bm25_prefix_or", f"{_SYM}, {bm25_sql('query snap; index')} SELECT id, round(score, 9) AS score FROM bm")
def _(spark, d):
    return bm25_postings(postings(spark, d), "query snap; index").select("id", F.round("score", 9).alias("score"))


@add("bm25_phrase", f"{_SYM}, {bm25_sql('both-resu')} SELECT id, round(score, 9) AS score FROM bm")
def _(spark, d):
    return bm25_postings(postings(spark, d), "both-resu").select("id", F.round("score", 9).alias("score"))


@add("bm25_code_only", f"{_SYM}, code AS (SELECT * FROM s WHERE file NOT IN (SELECT path FROM f WHERE language = 'python')), {bm25_sql('session', 'code')} SELECT id, round(score, 9) AS score FROM bm WHERE kind = 'Method' ORDER BY bm.score, id LIMIT 20")
def _(spark, d):
    rows = g.without_languages(_symbols(spark, d), table(spark, d, "files"), ["python"])
    return r.search_symbols(rows, "session", kind="Method").select("id", F.round("score", 9).alias("score"))


@add("tool_search", f"{_SYM}, {bm25_sql('cache')} SELECT CAST(row_number() OVER (ORDER BY score, id) AS INTEGER) AS rank, id, name, kind, file, line_start, CAST(0 AS DOUBLE) AS score FROM bm WHERE kind = 'Method' ORDER BY rank LIMIT 20")
def _(spark, d):
    return r.tool_search(bm25_postings(postings(spark, d), "cache"), _symbols(spark, d), kind="method")


@add("single_hit_expand", WITH + """, h AS (SELECT min(id) AS id FROM s HAVING count(*) FILTER (WHERE id = 3) = 1), x AS (SELECT 'caller' AS side, e.from_id AS id FROM e JOIN h ON e.to_id = 3 UNION SELECT 'callee', e.to_id FROM e JOIN h ON e.from_id = 3)
  SELECT side, x.id, name, file, line_start FROM x JOIN s ON s.id = x.id""")
def _(spark, d):
    s = _symbols(spark, d)
    return r.expand_single(s.filter("id = 3"), _edges(spark, d), s)


@add("postings", WITH + f""", t AS ({' UNION ALL '.join(f"SELECT id, {i} AS col, {_TOKENS.format(c)} AS w FROM s" for i, c in enumerate(_COLS))}), l AS (SELECT id, col, w, CAST(sum(len(w)) OVER (PARTITION BY id) AS INTEGER) AS length FROM t),
  x AS (SELECT id, col, length, unnest(w) AS token FROM l) SELECT token, id, col, length, CAST(count(*) AS INTEGER) AS n FROM x GROUP BY ALL""")
def _(spark, d):
    return postings(spark, d).terms.select("token", "id", "col", "length", F.size("positions").alias("n"))


# ---------------------------------------------------------------- vectors

_V = "WITH v AS (SELECT *, CAST(embedding AS DOUBLE[]) AS e FROM vectors WHERE len(embedding) = 64 AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR isnan(x))))"
_COS = "CASE WHEN list_inner_product(v.e, v.e) = 0 OR list_inner_product(q.e, q.e) = 0 THEN 0.0 ELSE list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))) END"
_FIRST = "(SELECT e FROM v ORDER BY id LIMIT 1)"
_NEAR = f"SELECT v.id, symbol_name, coalesce(file, '') AS file, {_COS} AS score FROM v, {_FIRST} q"


def _query(vectors: DataFrame, nth: int = 1) -> DataFrame:
    return vectors.select("id", "embedding").orderBy("id").limit(nth).orderBy(F.desc("id")).limit(1).select("embedding")


@add("cosine_topk", f"{_V} SELECT id, round(score, 6) AS score FROM ({_NEAR}) t ORDER BY t.score DESC, file, symbol_name, id LIMIT 10")
def _(spark, d):
    v = _vectors(spark, d)
    return r.nearest(v, _query(v), 10).select("id", F.round("score", 6).alias("score"))


@add("cosine_topk_kind", f"{_V} SELECT id, round(score, 6) AS score FROM ({_NEAR} WHERE symbol_kind = 'Method') t ORDER BY t.score DESC, file, symbol_name, id LIMIT 10")
def _(spark, d):
    v = _vectors(spark, d)
    return r.nearest(v, _query(v), 10, "Method").select("id", F.round("score", 6).alias("score"))


_RANKS = "SELECT file, symbol_name, min(rank) AS rank FROM (SELECT file, symbol_name, row_number() OVER (ORDER BY score DESC, file, symbol_name, id) AS rank FROM ({near})) WHERE rank <= 20 GROUP BY 1, 2"


@add("rrf_multi_query", f"{_V} SELECT file, symbol_name, round(sum(1.0 / (60 + rank)), 9) AS score FROM ({_RANKS.format(near=_NEAR)} UNION ALL {_RANKS.format(near=_NEAR.replace('LIMIT 1)', 'LIMIT 1 OFFSET 1)'))}) GROUP BY 1, 2 ORDER BY score DESC, file, symbol_name LIMIT 10")
def _(spark, d):
    v = _vectors(spark, d)
    return r.multi_query(v, [_query(v), _query(v, 2)], 10)


@add("symbol_text", WITH + "SELECT id, concat_ws(chr(10), kind || ' ' || name || ' (' || file || ')', signature, substring(content, 1, 512)) AS text FROM s")
def _(spark, d):
    return _symbols(spark, d).select("id", F.concat_ws("\n", F.concat("kind", F.lit(" "), "name", F.lit(" ("), "file", F.lit(")")), "signature", F.substring("content", 1, 512)).alias("text"))


_HYBRID = f"""{_SYM}, {_V[5:]}, {bm25_sql('resolve schema')}, words AS (SELECT name, file, line_start, row_number() OVER (ORDER BY score, id) AS rank FROM bm QUALIFY rank <= 60),
  near AS (SELECT symbol_name AS name, file, min(rank) AS rank FROM (SELECT symbol_name, file, row_number() OVER (ORDER BY score DESC, file, symbol_name, id) AS rank FROM ({_NEAR})) WHERE rank <= 60 GROUP BY 1, 2),
  placed AS (SELECT n.name, n.file, coalesce((SELECT arg_min(w.line_start, w.rank) FROM words w WHERE w.name = n.name AND w.file = n.file), (SELECT arg_min(s.line_start, s.id) FROM s WHERE s.name = n.name AND s.file = n.file), 0) AS line_start, n.rank FROM near n),
  fused AS (SELECT name, file, line_start, sum(1.0::DOUBLE / (60 + rank)) AS score FROM (SELECT * FROM words UNION ALL SELECT * FROM placed) GROUP BY 1, 2, 3)"""


@add("hybrid_tool", _HYBRID + " SELECT name, file, line_start, round(score * CASE WHEN contains(file, '/tests/') OR contains(file, '/test/') OR contains(file, '_test.') OR contains(file, '.test.') THEN 0.5::DOUBLE ELSE 1 END, 9) AS score FROM fused ORDER BY score DESC, file, line_start, name LIMIT 20")
def _(spark, d):
    v = _vectors(spark, d)
    return r.hybrid(_symbols(spark, d), v, "resolve schema", _query(v), scores=bm25_postings(postings(spark, d), "resolve schema"))


@add("hybrid_cli_boost", _HYBRID + """, hits AS (SELECT name, file, line_start, round(score, 9) AS score FROM fused ORDER BY score DESC, file, line_start, name LIMIT 20),
  seeds AS (SELECT name, sum(score) AS sc FROM hits GROUP BY 1),
  own AS (SELECT s.id, s.name, sc FROM s JOIN seeds USING (name)),
  up AS (SELECT own.name AS of, sc * 0.3::DOUBLE AS score, e.from_id AS id FROM e JOIN own ON own.id = e.to_id QUALIFY row_number() OVER (PARTITION BY own.name ORDER BY e.id, e.from_id) <= 3),
  dn AS (SELECT own.name AS of, sc * 0.15::DOUBLE AS score, e.to_id AS id FROM e JOIN own ON own.id = e.from_id WHERE e.confidence >= 0.5 QUALIFY row_number() OVER (PARTITION BY own.name ORDER BY e.id, e.to_id) <= 3)
  SELECT name, file, line_start, round(sum(score), 9) AS score FROM (SELECT * FROM hits UNION ALL SELECT s.name, s.file, s.line_start, x.score FROM (FROM up UNION ALL FROM dn) x JOIN s ON s.id = x.id WHERE s.file NOT IN (SELECT path FROM f WHERE language IN ('ruby', 'go')) OR (s.name, s.file, s.line_start) IN (SELECT (name, file, line_start) FROM hits)) GROUP BY 1, 2, 3 ORDER BY score DESC, file, line_start, name LIMIT 20""")
def _(spark, d):
    v, s = _vectors(spark, d), _symbols(spark, d)
    docs = g.files_in_languages(table(spark, d, "files"), ["ruby", "go"]).select(F.col("path").alias("file"))  # stand for documents
    return r.boost(r.hybrid(s, v, "resolve schema", _query(v), penalty=False, scores=bm25_postings(postings(spark, d), "resolve schema")), _edges(spark, d), s, doc_files=docs)


# ---------------------------------------------------------------- memory

_TYPES = ["decision", "pattern", "convention", "bug", "context", "session"]


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Documents as remembered facts."""
    doc = table(spark, d, "documents")
    i = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, _TYPES)), (i % 6 + 1).cast("int"))
    created = F.lit("2024-01-01").cast("timestamp") + F.make_interval(mins=i.cast("int"))
    ttl = F.create_map(*[F.lit(x) for kv in m.TTL_DAYS.items() for x in kv])
    rows = doc.select(F.lpad(i.cast("string"), 8, "0").alias("id"), i.alias("n"), created.alias("created"), "project", F.col("project").isNull().alias("global"), kind.alias("type"), F.col("text").alias("content"), F.array_compact(F.array("lang", "source")).alias("tags"), (i % 5).cast("int").alias("recall_count"))
    rows = rows.withColumn("expires_at", F.date_format(F.col("created") + F.make_interval(days=F.try_element_at(ttl, F.col("type"))), "yyyy-MM-dd HH:mm:ss"))
    return rows.withColumn("priority", F.col("n") % 3 == 0).withColumn("promoted", (F.col("n") % 3 == 0) & (F.col("n") % 2 == 0)).withColumn("demoted", (F.col("n") % 7 == 0) & (F.col("n") % 3 != 0)).drop("n")


_M = """WITH m AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS id, TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INTEGER)) AS created, project, project IS NULL AS global,
  ['decision', 'pattern', 'convention', 'bug', 'context', 'session'][doc_id % 6 + 1] AS type, text AS content, list_filter([lang, source], lambda x: x IS NOT NULL) AS tags, CAST(doc_id % 5 AS INTEGER) AS recall_count,
  doc_id % 3 = 0 AS priority, doc_id % 6 = 0 AS promoted, doc_id % 7 = 0 AND doc_id % 3 <> 0 AS demoted,
  CASE doc_id % 6 WHEN 3 THEN created + INTERVAL 90 DAY WHEN 4 THEN created + INTERVAL 30 DAY WHEN 5 THEN created + INTERVAL 7 DAY END AS expires_at FROM documents) """


def _term_sql(t: str, name: bool = False) -> str:
    hits = f"((length(c) - length(replace(c, '{t}', ''))) // {len(t)})"
    same = lambda x: f"({x} = '{t}' OR ends_with({x}, '/{t}') OR ends_with({x}, ':{t}') OR ends_with('{t}', '/' || {x}) OR ends_with('{t}', ':' || {x}) OR starts_with({x}, '{t}:') OR starts_with('{t}', {x} || ':'))"
    names = f"coalesce(list_bool_or(list_transform(tags, lambda x: {same('lower(x)')})), false)"
    if name:
        words = r"list_filter(list_transform(regexp_split_to_array(c, '[^\p{L}\p{N}_\-./:@$]+'), lambda x: regexp_replace(x, '^[.:\-/@$]+|[.:\-/@$]+$', '', 'g')), lambda x: x <> '')"
        names += f" OR coalesce(list_bool_or(list_transform({words}, lambda x: x = '{t}' OR (length(x) >= 3 AND {same('x')} AND x NOT IN ({', '.join(repr(w) for w in m.STOPWORDS)})))), false)"
    return f"(CASE WHEN {hits} > 0 THEN 1 + 0.1::DOUBLE * least({hits}, 3) ELSE 0 END + CASE WHEN {names} THEN 2 ELSE 0 END + CASE WHEN type = '{t}' THEN 1.5::DOUBLE ELSE 0 END)"


_TERMS = ["symbol", "queue", "review"]


@add("memory_search", _M + f", t AS (SELECT id, created, {', '.join(f'{_term_sql(t)} AS t{i}' for i, t in enumerate(_TERMS))} FROM (SELECT *, lower(content) AS c FROM m)) SELECT id, round(t0 + t1 + t2, 6) AS score FROM t WHERE (t0 > 0)::INT + (t1 > 0)::INT + (t2 > 0)::INT >= 2 ORDER BY score DESC, created DESC, id LIMIT 20")
def _(spark, d):
    return m.search(entries(spark, d), "the symbol queue, review").select("id", "score")


@add("memory_search_names", _M + f", t AS (SELECT id, created, {_term_sql('graph:index', True)} AS t0, {_term_sql('store/rows', True)} AS t1 FROM (SELECT *, lower(content) AS c FROM m)) SELECT id, round(t0 + t1, 6) AS score FROM t WHERE t0 > 0 OR t1 > 0 ORDER BY score DESC, created DESC, id LIMIT 20")
def _(spark, d):
    return m.search(entries(spark, d), "which of the graph:index or store/rows").select("id", "score")


@add("memory_display", _M + r"SELECT id, CASE WHEN length(line) > 40 THEN rtrim(substring(line, 1, 40)) || '…' ELSE line END AS shown FROM (SELECT id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS line FROM m)")
def _(spark, d):
    return entries(spark, d).select("id", one_line("content", 40).alias("shown"))


@add("memory_list", _M + "SELECT id FROM m WHERE global OR project = 'graph-core'")
def _(spark, d):
    return m.listed(entries(spark, d), "graph-core").select("id")


@add("memory_priority", _M + "SELECT id, CAST(row_number() OVER (ORDER BY promoted, CASE WHEN promoted THEN recall_count ELSE 0 END DESC, created DESC, id) AS INTEGER) AS ord FROM m WHERE priority")
def _(spark, d):
    return m.priorities(entries(spark, d)).select("id", "ord")


@add("memory_by_prefix", _M + "SELECT id FROM m WHERE starts_with(id, '00000012')")
def _(spark, d):
    return m.by_prefix(entries(spark, d), "00000012").select("id")


@add("memory_recalls", _M + "SELECT id, recall_count + CASE WHEN type = 'bug' THEN 1 ELSE 0 END AS recall_count FROM m")
def _(spark, d):
    e = entries(spark, d)
    return m.record_recalls(e, e.filter("type = 'bug'").select("id").union(e.filter("type = 'bug'").select("id"))).select("id", "recall_count")


@add("memory_expire", _M + "SELECT id FROM m WHERE expires_at IS NULL OR expires_at > TIMESTAMP '2024-02-15'")
def _(spark, d):
    return m.unexpired(entries(spark, d), "2024-02-15 00:00:00").select("id")


@add("memory_commit_purge", _M + "SELECT id FROM m WHERE content IS NULL OR NOT starts_with(content, '[commit]')")
def _(spark, d):
    return m.without_commits(entries(spark, d)).select("id")


@add("memory_promote", _M + "SELECT id, priority OR (NOT demoted AND recall_count >= 3) AS priority, promoted OR (NOT priority AND NOT demoted AND recall_count >= 3) AS promoted FROM m")
def _(spark, d):
    return m.auto_promote(entries(spark, d)).select("id", "priority", "promoted")


@add("tag_index", _M + "SELECT tag, count(*) AS n_entries FROM (SELECT DISTINCT id, lower(unnest(tags)) AS tag FROM m) GROUP BY 1")
def _(spark, d):
    return m.tag_index(entries(spark, d))


@add("project_index", _M + "SELECT coalesce(project, '__global__') AS project, count(*) AS n_entries FROM m GROUP BY 1")
def _(spark, d):
    return m.project_index(entries(spark, d))


_WORDSET = "list_sort(list_distinct(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')))"
_JACCARD = "CASE WHEN len(a.w) + len(b.w) = 0 THEN 1 ELSE len(list_intersect(a.w, b.w)) / CAST(len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS DOUBLE) END"


def edited(e: DataFrame) -> DataFrame:
    """Entries and, for those of one type, a copy without its last word."""
    return e.unionByName(e.filter("type = 'pattern'").withColumn("id", F.concat(F.lit("x"), "id")).withColumn("content", F.regexp_replace("content", r"\s+\S+\s*$", "")))


@add("memory_near_dup_pairs", _M + f""", e AS (SELECT id, content FROM m UNION ALL SELECT 'x' || id, regexp_replace(content, '\\s+\\S+\\s*$', '') FROM m WHERE type = 'pattern'),
  k AS (SELECT min(id) AS rep, w FROM (SELECT id, {_WORDSET.format('content')} AS w FROM e WHERE content IS NOT NULL) GROUP BY w)
  SELECT a.rep AS a, b.rep AS b, round({_JACCARD}, 6) AS similarity FROM k a JOIN k b ON a.rep < b.rep AND least(len(a.w), len(b.w)) >= 0.85 * greatest(len(a.w), len(b.w)) WHERE {_JACCARD} > 0.85""")
def _(spark, d):
    return m.near_duplicates(edited(entries(spark, d))).select("a", "b", F.round("similarity", 6).alias("similarity"))


@add("memory_word_classes", _M + "SELECT min(id) AS rep, count(*) AS n_rows FROM (SELECT id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> ''))) AS w FROM m) GROUP BY w")
def _(spark, d):
    return m.word_classes(entries(spark, d)).select("rep", "n_rows")


@add("memory_merge")
def _(spark, d):
    return m.greedy_merge(entries(spark, d))


@add("memory_batch_dedup", _M + f""", n AS (SELECT id, regexp_replace(content, '\\s+\\S+\\s*$', '') AS content FROM m WHERE type = 'pattern' UNION ALL SELECT 'y' || id, reverse(content) FROM m WHERE type = 'session'),
  k AS (SELECT id, {_WORDSET.format('content')} AS w FROM n WHERE length(trim(content)) > 0), o AS (SELECT DISTINCT {_WORDSET.format('content')} AS w FROM m WHERE content IS NOT NULL)
  SELECT id FROM k a WHERE NOT EXISTS (FROM o b WHERE least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) AND {_JACCARD} > 0.8)""")
def _(spark, d):
    e = entries(spark, d)
    batch = edited(e).filter("id like 'x%'").withColumn("id", F.expr("substring(id, 2)")).unionByName(e.filter("type = 'session'").withColumn("id", F.concat(F.lit("y"), "id")).withColumn("content", F.reverse("content")))
    return m.new_entries(batch, e).select("id")


@add("memory_mark_legacy", _M + "SELECT id, promoted OR (priority AND NOT promoted AND recall_count >= 3 AND type <> 'bug' AND created + INTERVAL 1 DAY < TIMESTAMP '2024-01-02 05:00:00') AS promoted FROM m")
def _(spark, d):
    e = entries(spark, d).withColumn("updated", F.when(F.col("type") == "bug", F.col("created")).otherwise(F.col("created") + F.expr("interval 1 day")))
    return m.mark_legacy(e, "2024-01-02 05:00:00").select("id", "promoted")


@add("memory_pin", _M + "SELECT id, true AS priority, false AS promoted, false AS demoted, recall_count FROM m WHERE type = 'bug' UNION ALL SELECT id, false, false, true, 0 FROM m WHERE type <> 'bug'")
def _(spark, d):
    e = entries(spark, d)
    return m.pin(e.filter("type = 'bug'")).unionByName(m.pin(e.filter("type != 'bug'"), False)).select("id", "priority", "promoted", "demoted", "recall_count")


@add("memory_retype", _M + """SELECT id, CASE WHEN type = 'bug' THEN strftime(expires_at, '%Y-%m-%d %H:%M:%S') ELSE '2025-11-30 00:00:00' END AS expires_at FROM m""")
def _(spark, d):
    return m.retype(entries(spark, d), "bug", NOW).select("id", "expires_at")


@add("memory_upsert", _M + "SELECT id, content FROM m WHERE type <> 'pattern' UNION ALL SELECT id, 'new ' || content FROM m WHERE type = 'pattern'")
def _(spark, d):
    e = entries(spark, d)
    return m.upsert(e, e.filter("type = 'pattern'").withColumn("content", F.concat(F.lit("new "), "content"))).select("id", "content")


@add("memory_delete", _M + "SELECT id FROM m WHERE type <> 'session'")
def _(spark, d):
    e = entries(spark, d)
    return m.delete(e, e.filter("type = 'session'")).select("id")


@add("memory_not_shown", _M + "SELECT id FROM m WHERE priority AND type <> 'bug'")
def _(spark, d):
    e = entries(spark, d)
    return m.not_shown(e, e.filter("type = 'bug'").select(F.substring("id", 1, 8).alias("id8"))).select("id")


_FACTS = ["index", "graph", "rows"]


@add("memory_fusion", f"""{_V}, x AS (SELECT symbol_name AS id, arg_max(text, id) AS content, min(loaded_at) AS created, CAST([] AS VARCHAR[]) AS tags, 'context' AS type FROM vectors WHERE symbol_kind = 'memory' GROUP BY 1),
  t AS (SELECT id, created, {', '.join(f'{_term_sql(t)} AS t{i}' for i, t in enumerate(_FACTS))} FROM (SELECT *, lower(content) AS c FROM x)),
  w AS (SELECT id, row_number() OVER (ORDER BY round(t0 + t1 + t2, 6) DESC, created DESC, id) AS rank FROM t WHERE (t0 > 0)::INT + (t1 > 0)::INT + (t2 > 0)::INT >= 2 QUALIFY rank <= 30),
  near AS (SELECT v.id, symbol_name, text, row_number() OVER (ORDER BY {_COS} DESC, coalesce(file, ''), symbol_name, v.id) AS rank FROM v, {_FIRST} q WHERE symbol_kind = 'memory' QUALIFY rank <= 30),
  n AS (SELECT x.id, min(rank) AS rank FROM near JOIN x ON x.id = near.symbol_name AND x.content = near.text GROUP BY 1)
  SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM w UNION ALL FROM n) GROUP BY 1 ORDER BY score DESC, id LIMIT 10""")
def _(spark, d):
    v = _vectors(spark, d)
    facts = table(spark, d, "vectors").filter("symbol_kind = 'memory'").groupBy(F.col("symbol_name").alias("fact")).agg(F.max_by("text", "id").alias("content"), F.min("loaded_at").alias("created"))
    facts = facts.select(F.col("fact").alias("id"), "content", "created", F.array().cast("array<string>").alias("tags"), F.lit("context").alias("type"))
    near = r.nearest(v, _query(v), 30, "memory").select(F.col("id").alias("vector_id"), "rank").join(v.select(F.col("id").alias("vector_id"), F.col("symbol_name").alias("id"), "text"), "vector_id")
    near = m.current_hits(near, facts).groupBy("id").agg(F.min("rank").alias("rank"))
    return m.fused_search(facts, "index of the graph, rows", near)
