"""Queries of the general problems (hierarchies, orphan references) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators.hierarchy import descendants, hierarchy, intervals
from trellis.operators.references import orphan_references, orphan_report
from trellis.sources import table


def _spawns(spark: SparkSession, d: str, paths: bool = False) -> DataFrame:
    rows = table(spark, d, "edges").select("from_id", "to_id", "kind").filter(F.lower(F.trim("kind")) == "spawns")
    return hierarchy(rows, child="to_id", parent="from_id", paths=paths)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _spawns(spark, d).select(F.col("node").alias("symbol_id"), F.col("root").alias("root_id"), "depth")


def p2_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = _spawns(spark, d, paths=True)
    return rows.select(F.col("node").alias("symbol_id"), F.col("root").alias("root_id"), "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"))


def p2_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_spawns(spark, d, paths=True)).select(F.col("ancestor").alias("symbol_id"), F.col("descendant").alias("descendant_id"), "distance")


def p2_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals(_spawns(spark, d, paths=True)).select(F.col("node").alias("symbol_id"), "depth", F.col("first").alias("first_no"), F.col("last").alias("last_no"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(*(table(spark, d, t) for t in ("edges", "vectors", "symbols", "files", "removals")))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p5_found(spark, d))


QUERIES = {"p2_found": p2_found, "p2_paths": p2_paths, "p2_descendants": p2_descendants, "p2_intervals": p2_intervals, "p5_found": p5_found, "p5_report": p5_report}

_TREE = """
WITH RECURSIVE link AS (
  SELECT to_id AS child, min(from_id) AS parent FROM edges
  WHERE lower(trim(kind)) = 'spawns' AND from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY 1),
down(node, root, depth, path) AS (
  SELECT DISTINCT parent, parent, CAST(0 AS BIGINT), CAST(parent AS VARCHAR) FROM link WHERE parent NOT IN (SELECT child FROM link)
  UNION ALL
  SELECT l.child, d.root, d.depth + 1, d.path || '/' || l.child FROM down d JOIN link l ON l.parent = d.node),
stuck AS (
  SELECT child AS node FROM link UNION SELECT parent FROM link EXCEPT SELECT node FROM down),
reach(node, up) AS (
  SELECT s.node, l.parent FROM stuck s JOIN link l ON l.child = s.node
  UNION
  SELECT r.node, l.parent FROM reach r JOIN link l ON l.child = r.up),
loops AS (SELECT node FROM reach WHERE node = up),
tree AS (
  SELECT node, root, depth, path FROM down
  UNION ALL
  SELECT r.node, min(r.up), -1, NULL FROM reach r WHERE r.up IN (SELECT node FROM loops) GROUP BY 1)
"""

_ORPHANS = """
WITH refs AS (
  SELECT 'edges' AS ref_table, id AS row_id, loaded_at, CAST(to_id AS VARCHAR) AS key FROM edges
  UNION SELECT 'vectors', id, loaded_at, symbol_name FROM vectors WHERE symbol_kind IS DISTINCT FROM 'memory'
  UNION SELECT 'symbols', id, loaded_at, file FROM symbols),
ends AS (
  SELECT 'edges' AS ref_table, CAST(id AS VARCHAR) AS key, min(loaded_at) AS since FROM symbols GROUP BY 2
  UNION ALL SELECT 'vectors', name, min(loaded_at) FROM symbols GROUP BY 2
  UNION ALL SELECT 'symbols', path, min(loaded_at) FROM files GROUP BY 2),
gone AS (
  SELECT DISTINCT 'edges' AS ref_table, CAST(target_id AS VARCHAR) AS key FROM removals WHERE target_table = 'symbols'
  UNION SELECT 'vectors', target_name FROM removals WHERE target_table = 'symbols'
  UNION SELECT 'symbols', target_name FROM removals WHERE target_table = 'files'),
found AS (
  SELECT DISTINCT r.ref_table, r.row_id, strftime(r.loaded_at, '%Y-%m') AS ref_month,
    CASE WHEN e.key IS NOT NULL THEN 'late' WHEN g.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS ref_state
  FROM refs r LEFT JOIN ends e USING (ref_table, key) LEFT JOIN gone g USING (ref_table, key)
  WHERE r.key IS NOT NULL AND (e.key IS NULL OR e.since > r.loaded_at))
"""

SQL = {
    "p2_found": _TREE + "SELECT node AS symbol_id, root AS root_id, depth FROM tree",
    "p2_paths": _TREE + "SELECT node AS symbol_id, root AS root_id, depth, path FROM tree",
    "p2_descendants": _TREE
    + """, pair(symbol_id, descendant_id, distance) AS (
      SELECT l.parent, l.child, CAST(1 AS BIGINT) FROM link l JOIN down d ON d.node = l.child
      UNION ALL SELECT l.parent, p.descendant_id, p.distance + 1 FROM pair p JOIN link l ON l.child = p.symbol_id)
    SELECT symbol_id, descendant_id, distance FROM pair""",
    "p2_intervals": _TREE
    + """, route AS (SELECT *, row_number() OVER (ORDER BY root, CAST(string_split(path, '/') AS BIGINT[])) - 1 AS first_no FROM tree WHERE depth >= 0),
    below AS (SELECT unnest(CAST(string_split(path, '/') AS BIGINT[])) AS node, count(*) - 1 AS n FROM route GROUP BY 1)
    SELECT r.node AS symbol_id, r.depth, r.first_no, r.first_no + b.n AS last_no FROM route r JOIN below b USING (node)""",
    "p5_found": _ORPHANS + "SELECT ref_table, row_id, ref_month, ref_state FROM found",
    "p5_report": _ORPHANS + "SELECT ref_table, ref_month, ref_state, count(*) AS n_refs FROM found GROUP BY ALL",
}
