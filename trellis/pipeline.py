"""From a project folder to a graph: read, skip what is unchanged, parse, resolve, purge, and take the new version over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.operators import build as b
from trellis.operators.order import numbered
from trellis.session import materialize
from trellis.sources.parse import parse_files
from trellis.sources.project import read_project
from trellis.store import GraphStore

SCHEMAS = {
    "files": "path string, language string, hash string",
    "symbols": "id long, name string, kind string, file string, line_start long, line_end long, signature string, doc string, content string",
    "edges": "id long, from_id long, to_id long, kind string, confidence double, file string",
}


def _numbered(rows: DataFrame, order: list[str], name: str = "id", after: DataFrame | None = None) -> DataFrame:
    """Ids in an order, above those of ``after``."""
    rows = numbered(rows, order, "_n")
    if after is None:
        return rows.withColumn(name, F.col("_n") + 1).drop("_n")
    top = after.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    return rows.crossJoin(F.broadcast(top)).withColumn(name, F.col("_top") + F.col("_n") + 1).drop("_n", "_top")


def build(spark: SparkSession, root: str, store: GraphStore, full: bool = False, excludes: list[str] | None = None, wait: float | None = None) -> dict[str, int]:
    """Brings the graph of ``store`` up to date with the folder ``root``; counts of changed, removed and all files.

    Only files whose text changed are parsed.  Symbols keep their ids across builds; edges that start in a changed file are
    made anew, those that lead to a symbol that is gone go with it.  If the root cannot be read, nothing changes; what lies
    below another unreadable folder stays as it was.  One build runs at a time.
    """
    with store.lock(wait):
        unreadable: list[str] = []
        found = materialize(read_project(spark, root, excludes, unreadable), "project")
        old = {name: store.read(name) if store.version else spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()}
        changed = materialize(b.changed_files(found, old["files"], full), "changed")
        gone = materialize(b.stale_files(old["files"], found, unreadable), "gone")
        files, symbols, edges = b.purge(old["files"], old["symbols"], old["edges"], gone)
        new_symbols, calls, imports = (materialize(x, "parsed") for x in parse_files(found.join(changed.select("path"), "path", "left_semi")))
        paths = changed.select("path")
        edges = b.reset_outgoing(edges, symbols, paths)
        # files that hold no symbol any more lose the ones they had
        emptied = paths.join(new_symbols.select(F.col("file").alias("path")), "path", "left_anti").select(F.col("path").alias("file"))
        symbols = symbols.join(emptied, "file", "left_anti").select(*old["symbols"].columns)
        fresh = _numbered(new_symbols, ["file", "line_start", "line_end", "name", "kind"]).select(*old["symbols"].columns)
        symbols = materialize(b.upsert_symbols(symbols, fresh), "symbols")
        ids = symbols.select("id")
        edges = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")
        files = files.join(paths, "path", "left_anti").unionByName(found.join(changed, "path").select("path", "language", "hash"))
        imports = materialize(_numbered(imports, ["file", "line", "source", "name"], "import_id"), "imports")
        calls = _numbered(calls, ["file", "line", "caller", "callee", "receiver"], "call_id")
        targets = b.resolve_imports(imports, files, normalize=True)
        imported = imports.join(targets, "import_id").select("import_id", "file", "name", "target")
        made = b.resolve_calls(calls, symbols, imported).select("from_id", "to_id", "kind", "confidence")
        made = made.unionByName(b.import_edges(imports, symbols, targets).select("from_id", "to_id", "kind", F.lit(1.0).alias("confidence"))).distinct()
        made = made.join(symbols.select(F.col("id").alias("from_id"), "file"), "from_id")
        edges = materialize(edges.select(*old["edges"].columns), "edges")
        made = _numbered(made, ["from_id", "to_id", "kind", "confidence"], after=edges).select(*old["edges"].columns)
        store.write({"files": files.select("path", "language", "hash"), "symbols": symbols, "edges": edges.unionByName(made)})
        return {"changed": changed.count(), "removed": gone.count(), "files": store.read("files").count()}
