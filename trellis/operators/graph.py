"""Structural graph operators over ``files``, ``symbols`` and ``edges``.

All of them take DataFrames and literals and give a DataFrame.  Ties are broken by columns named in the docstrings, so
results do not depend on the order of rows.  Traversals run one join a level over a frontier written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.session import materialize

FUNCTIONS = ("Function", "Method")
CONTAINERS = ("Class", "Interface", "Module")
DOC_LANGUAGES = ("markdown", "yaml", "toml", "html")


def clean_edges(edges: DataFrame) -> DataFrame:
    """Edges with both ends, kinds in lower case, replayed rows once, confidence 1.0 where absent."""
    return (
        edges.filter("from_id is not null and to_id is not null")
        .select("id", "from_id", "to_id", F.lower(F.trim("kind")).alias("kind"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "file")
        .distinct()
    )


def clean_symbols(symbols: DataFrame) -> DataFrame:
    return symbols.withColumn("kind", normal_kind("kind"))


def normal_kind(kind: str) -> Column:
    """First letter upper, rest lower."""
    k = F.trim(kind)
    return F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.expr(f"substring(trim({kind}), 2)")))


# ---------------------------------------------------------------- lookups


def find_symbol(symbols: DataFrame, name: str, file: str | None = None, kind: str | None = None) -> DataFrame:
    """Rows named ``name``; where there is none and the name has no dot, those whose name ends in ``.name`` (LIKE, no case)."""
    base = symbols
    if file is not None:
        base = base.filter(F.col("file") == file)
    if kind is not None:
        base = base.filter(F.lower("kind") == kind.lower())
    exact = base.filter(F.col("name") == name)
    if "." in name:
        return exact
    suffix = base.filter(F.lower("name").like("%." + name.lower()))
    none = exact.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0")
    return exact.unionByName(suffix.join(F.broadcast(none), how="left_semi", on=F.lit(True)))


def symbols_in_file(symbols: DataFrame, file: str) -> DataFrame:
    return symbols.filter(F.col("file") == file)


def find_listeners(symbols: DataFrame, event: str) -> DataFrame:
    return symbols.filter((F.col("name") == event) & F.col("kind").isin(*FUNCTIONS))


def is_indexed_file(files: DataFrame, path: str) -> DataFrame:
    return files.agg(F.coalesce(F.max(F.col("path") == path), F.lit(False)).alias("indexed"))


def files_in_languages(files: DataFrame, languages: list[str]) -> DataFrame:
    return files.filter(F.col("language").isin(*languages)) if languages else files.filter(F.lit(False))


def without_languages(symbols: DataFrame, files: DataFrame, languages: list[str]) -> DataFrame:
    out = files_in_languages(files, languages).select(F.col("path").alias("file")).distinct()
    return symbols.join(out, "file", "left_anti")


def embed_eligible(symbols: DataFrame) -> DataFrame:
    return symbols.filter("content is not null or signature is not null")


def is_test_name(file: str) -> Column:
    return F.col(file).contains("test") | F.col(file).contains("spec")


def is_test_path(file: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(file).contains(x) for x in ("/tests/", "/test/", "_test.", ".test.")])


def snippet(content: str, lines: int = 3) -> Column:
    return F.array_join(F.slice(F.split(content, "\n"), 1, lines), "\n")


def elide(content: str, limit: int = 100, head: int = 60, tail: int = 20) -> Column:
    """Long contents as their first and last lines around a marker."""
    lines = F.split(content, "\n")
    n = F.size(lines)
    cut = F.concat_ws("\n", F.array_join(F.slice(lines, 1, head), "\n"), F.concat(F.lit("... "), (n - head - tail).cast("string"), F.lit(" lines ...")), F.array_join(F.slice(lines, F.greatest(n - tail + 1, F.lit(1)), tail), "\n"))
    return F.when(n > limit, cut).otherwise(F.col(content))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(offset).limit(limit)


# ---------------------------------------------------------------- joins


def _ends(edges: DataFrame, symbols: DataFrame, side: str, name: str, file: str | None) -> DataFrame:
    own, other = ("to_id", "from_id") if side == "callers" else ("from_id", "to_id")
    target = symbols.filter(F.col("name") == name)
    if file is not None:
        target = target.filter(F.col("file") == file)
    hit = edges.join(target.select(F.col("id").alias(own)), own).select(F.col("id").alias("edge_id"), F.col(other).alias("id"), F.col("kind").alias("edge_kind"), "confidence")
    return hit.join(symbols, "id").select("edge_id", "edge_kind", "confidence", "id", "name", "kind", "file", "line_start", "line_end")


def callers(edges: DataFrame, symbols: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Symbols with an edge of any kind and confidence to one called ``name``."""
    return _ends(edges, symbols, "callers", name, file)


def callees(edges: DataFrame, symbols: DataFrame, name: str, file: str | None = None, least: float = 0.5) -> DataFrame:
    """Symbols that one called ``name`` has an edge of at least this confidence to."""
    return _ends(edges.filter(F.col("confidence") >= least), symbols, "callees", name, file)


def split_imports(ends: DataFrame) -> DataFrame:
    """Unique by (name, file, line_start), keeping the smallest edge; ``part`` is imports or calls."""
    first = F.row_number().over(W.partitionBy("name", "file", "line_start").orderBy("edge_id", "id"))
    return ends.withColumn("_n", first).filter("_n = 1").drop("_n").withColumn("part", F.when(F.col("edge_kind") == "imports", "imports").otherwise("calls"))


def definition_view(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """``section, name, kind, file, line_start``: definitions, callers, imported_by, callees and imports of a symbol."""
    cols = ["name", "kind", "file", "line_start"]
    out = find_symbol(symbols, name).select(F.lit("definitions").alias("section"), *cols)
    for ends, calls, imports in ((callers(edges, symbols, name), "callers", "imported_by"), (callees(edges, symbols, name), "callees", "imports")):
        out = out.unionByName(split_imports(ends).select(F.when(F.col("part") == "imports", imports).otherwise(calls).alias("section"), *cols))
    return out


def dead_code(edges: DataFrame, symbols: DataFrame, kinds: tuple[str, ...] = FUNCTIONS, limit: int | None = 50) -> DataFrame:
    """Symbols that no edge points at, in the order (file, line_start, id)."""
    unused = symbols.filter(F.col("kind").isin(*kinds)).join(edges.select(F.col("to_id").alias("id")).distinct(), "id", "left_anti")
    return unused if limit is None else unused.orderBy("file", "line_start", "id").limit(limit)


def file_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Distinct ``(src, dst)`` of different files joined by an edge."""
    at = lambda end, alias: symbols.select(F.col("id").alias(end), F.col("file").alias(alias))
    return edges.select("from_id", "to_id").distinct().join(at("from_id", "src"), "from_id").join(at("to_id", "dst"), "to_id").filter("src != dst").select("src", "dst").distinct()


def mutual_files(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """File pairs that depend on each other."""
    pairs = file_edges(edges, symbols)
    return pairs.join(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi")


def _nested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parent, order and enclosing containers of rows sorted by file, beginning, end (last first) and id, file by file."""
    file, open_, around, n = None, [], [], 0
    for batch in batches:
        out: list[tuple] = []
        for f, a, b, i, name, holds in zip(*(batch.column(c).to_pylist() for c in range(6))):
            if f != file or f is None:
                n = 0 if f != file else n
                file, open_, around = f, [], []
            n += 1
            # what ends before this row ends cannot be the parent of a later one: this row would be nearer
            while open_ and open_[-1][0] < b:
                open_.pop()
            around = [c for c in around if c[2] > a]
            chain = sorted(c for c in around if c[0] < a and c[2] > b and c[1] != i)
            out.append((i, open_[-1][1] if open_ else None, n, [c[3] for c in chain]))
            open_.append((b, i))
            if holds:
                around.append((a, i, b, name))
        columns = zip(*out) if out else ([], [], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string())))], names=["id", "parent_id", "ord", "chain"])


def nesting(symbols: DataFrame) -> DataFrame:
    """``id, parent_id, ord, chain``: one sorted pass over the symbols of each file with a stack of what is open.

    In the order (line_start, line_end descending, id) the parent is the last row before that ends no earlier; ``chain``
    has the names of the containers that begin before and end behind it, outermost first.  Rows without lines are left out.
    """
    rows = symbols.filter("line_start is not null and line_end is not null").select("file", "line_start", "line_end", "id", "name", F.coalesce(F.col("kind").isin(*CONTAINERS), F.lit(False)).alias("holds"))
    rows = rows.repartition("file").sortWithinPartitions("file", "line_start", F.desc("line_end"), "id")
    return rows.mapInArrow(_nested, "id long, parent_id long, ord long, chain array<string>")


def qualified_names(symbols: DataFrame) -> DataFrame:
    """``id, qualified``: containers that enclose the symbol, outermost first, joined by ``::``; ``#`` before a function."""
    rows = symbols.select("id", "name", "kind").join(nesting(symbols).select("id", F.array_join("chain", "::").alias("_chain")), "id", "left")
    sep = F.when(F.col("kind").isin(*FUNCTIONS), "#").otherwise("::")
    return rows.select("id", F.when(F.coalesce("_chain", F.lit("")) == "", F.col("name")).otherwise(F.concat("_chain", sep, "name")).alias("qualified"))


def endpoints(edges: DataFrame) -> DataFrame:
    """``(symbol_id, edge_id)`` for both ends; a self loop once.  Stands for the join on ``from_id = id or to_id = id``."""
    return edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("symbol_id"), F.col("id").alias("edge_id")).distinct()


def incident_edges(edges: DataFrame, symbol_id: int) -> DataFrame:
    one = edges.filter(F.col("from_id") == symbol_id)
    return one.unionByName(edges.filter((F.col("to_id") == symbol_id) & (F.col("from_id") != symbol_id)))


# ---------------------------------------------------------------- aggregates


def file_deps(edges: DataFrame, symbols: DataFrame, file: str, reverse: bool = False) -> DataFrame:
    """``file, edge_kind, n_edges`` of the other files that this one depends on (or that depend on it)."""
    own, other = ("to_id", "from_id") if reverse else ("from_id", "to_id")
    here = symbols.filter(F.col("file") == file).select(F.col("id").alias(own))
    there = symbols.filter(F.col("file") != file).select(F.col("id").alias(other), F.col("file").alias("other_file"))
    rows = edges.select("from_id", "to_id", "kind").join(here, own).join(there, other)
    return rows.groupBy(F.col("other_file").alias("file"), F.col("kind").alias("edge_kind")).agg(F.count(F.lit(1)).alias("n_edges"))


def connections(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``id, n_edges``: edges that touch each symbol, 0 included."""
    n = endpoints(edges).groupBy(F.col("symbol_id").alias("id")).agg(F.count(F.lit(1)).alias("n_edges"))
    return symbols.select("id").join(n, "id", "left").na.fill(0, ["n_edges"])


def out_degree(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    n = edges.groupBy(F.col("from_id").alias("id")).agg(F.count(F.lit(1)).alias("n_out"))
    return symbols.select("id").join(n, "id", "left").na.fill(0, ["n_out"])


def top_connected(edges: DataFrame, symbols: DataFrame, limit: int = 20) -> DataFrame:
    """Files by the number of different edges at their symbols; ties by path."""
    ends = symbols.select(F.col("id").alias("symbol_id"), "file").join(endpoints(edges), "symbol_id", "left")
    return ends.groupBy("file").agg(F.countDistinct("edge_id").alias("n_edges")).orderBy(F.desc("n_edges"), "file").limit(limit)


def stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return count(files, "n_files").crossJoin(count(symbols, "n_symbols")).crossJoin(count(edges, "n_edges"))


def language_breakdown(files: DataFrame) -> DataFrame:
    return files.filter("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("n_files"))


def direct_impact(edges: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Direct callers of a symbol and the files they are in."""
    return callers(edges, symbols, name).agg(F.count(F.lit(1)).alias("n_callers"), F.countDistinct("file").alias("n_files"))


def similar_symbols(edges: DataFrame, symbols: DataFrame, symbol_id: int, limit: int = 10) -> DataFrame:
    """Symbols of the kind with about as many lines and outgoing edges; the ``3 limit`` nearest in lines are scored."""
    sized = symbols.join(out_degree(edges, symbols), "id").select("id", "name", "kind", "file", (F.col("line_end") - F.col("line_start")).alias("lines"), "n_out")
    me = sized.filter(F.col("id") == symbol_id).select(F.lower("kind").alias("_kind"), F.col("lines").alias("_lines"), F.col("n_out").alias("_out"))
    near = sized.join(F.broadcast(me.limit(1)), F.lower("kind") == F.col("_kind")).filter(F.col("id") != symbol_id)
    near = near.withColumn("_d", F.abs(F.col("lines") - F.col("_lines"))).filter("_d is not null").orderBy("_d", "id").limit(3 * limit)
    score = 1.0 / (1 + F.col("_d") + 2 * F.abs(F.col("n_out") - F.col("_out")))
    return near.select("id", "name", "file", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def graph_view(files: DataFrame, symbols: DataFrame, edges: DataFrame, part: str | None = None, kind: str | None = None, language: str | None = None, limit: int = 1500) -> DataFrame:
    """``id, n_edges`` of the best connected symbols that pass the filters; ties by id."""
    rows = symbols
    if part is not None:
        rows = rows.filter(F.lower("file").contains(part.lower()))
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if language is not None:
        rows = rows.join(files_in_languages(files, [language]).select(F.col("path").alias("file")).distinct(), "file", "left_semi")
    return connections(edges, rows).orderBy(F.desc("n_edges"), "id").limit(limit)


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are in ``ids (id)``."""
    return edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_semi")


# ---------------------------------------------------------------- traversal


def reach(links: DataFrame, seeds: DataFrame, depth: int, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """``keys, carry, depth`` of what lies within ``depth`` steps of ``seeds (keys, carry)``, seeds (depth 0) included.

    ``links`` has the columns ``a_<key>`` (reached from) and ``b_<key>`` (next).  Seeds of different ``carry`` go their
    ways side by side.
    """
    own = [*keys, *carry]
    levels = [materialize(seeds.select(*own).distinct().withColumn("depth", F.lit(0)), "level")]
    links = materialize(links.select(*[f"a_{k}" for k in keys], *[f"b_{k}" for k in keys]).distinct(), "links")
    for n in range(1, depth + 1):
        seen = reduce(DataFrame.unionByName, [x.select(*own) for x in levels])
        step = links.join(levels[-1].select(*[F.col(k).alias(f"a_{k}") for k in keys], *carry), [f"a_{k}" for k in keys]).select(*[F.col(f"b_{k}").alias(k) for k in keys], *carry).distinct()
        new = materialize(step.join(seen, own, "left_anti").withColumn("depth", F.lit(n)), "level")
        if new.isEmpty():
            break
        levels.append(new)
    return reduce(DataFrame.unionByName, levels)


def impact(edges: DataFrame, symbols: DataFrame, files: list[str], depth: int = 5) -> DataFrame:
    """``file, depth``: files that depend on ``files``, directly or through others."""
    links = file_edges(edges, symbols).select(F.col("dst").alias("a_file"), F.col("src").alias("b_file"))
    seeds = links.sparkSession.createDataFrame([(f,) for f in files], "file string")
    return reach(links, seeds, depth, ["file"]).filter("depth > 0")


def diff_impact(edges: DataFrame, symbols: DataFrame, changed: list[str], depth: int = 3, keep_changed: bool = False) -> DataFrame:
    """Union of the impacts of changed files, without them or (``keep_changed``) with those that another one reaches."""
    if not keep_changed:
        return impact(edges, symbols, changed, depth).select("file").distinct()
    links = file_edges(edges, symbols).select(F.col("dst").alias("a_file"), F.col("src").alias("b_file"))
    seeds = links.sparkSession.createDataFrame([(f, f) for f in changed], "file string, seed string")
    return reach(links, seeds, depth, ["file"], ("seed",)).filter("depth > 0").select("file").distinct()


def function_impact(edges: DataFrame, symbols: DataFrame, name: str, depth: int = 3) -> DataFrame:
    """Files that depend on any file that defines ``name``; a defining file counts if another one of them reaches it."""
    links = file_edges(edges, symbols).select(F.col("dst").alias("a_file"), F.col("src").alias("b_file"))
    seeds = find_symbol(symbols, name).select("file").distinct()
    return reach(links, seeds, depth, ["file"]).filter("depth > 0")


def who_calls_chain(edges: DataFrame, symbols: DataFrame, name: str, depth: int = 3, cap: int = 200) -> DataFrame:
    """``name, file, depth`` of transitive callers by (name, file); the first ``cap`` in the order (depth, file, name)."""
    at = lambda end, p: symbols.select(F.col("id").alias(end), F.col("name").alias(f"{p}_name"), F.col("file").alias(f"{p}_file"))
    links = edges.select("from_id", "to_id").distinct().join(at("to_id", "a"), "to_id").join(at("from_id", "b"), "from_id")
    found = reach(links, find_symbol(symbols, name).select("name", "file"), depth, ["name", "file"])
    return found.filter("depth > 0").orderBy("depth", "file", "name").limit(cap)


def neighborhood(edges: DataFrame, symbol_id: int, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Undirected: ``(id, depth)`` of the symbols reached, and the edges at each expanded one (once for each end)."""
    both = edges.select(F.col("from_id").alias("a_id"), F.col("to_id").alias("b_id")).unionByName(edges.select(F.col("to_id").alias("a_id"), F.col("from_id").alias("b_id")))
    seeds = edges.sparkSession.createDataFrame([(symbol_id,)], "id long")
    found = reach(both, seeds, depth, ["id"])
    ends = edges.select(F.explode(F.array_distinct(F.array("from_id", "to_id"))).alias("at_id"), F.struct("id", "from_id", "to_id", "kind").alias("e"))
    at = ends.join(found.filter(F.col("depth") < depth).select(F.col("id").alias("at_id")), "at_id").select("at_id", F.col("e.id").alias("edge_id"), "e.from_id", "e.to_id", "e.kind")
    return found, at


def file_subgraph(edges: DataFrame, symbols: DataFrame, file: str) -> DataFrame:
    """``id, inside`` of the symbols of a file and of those outside that an edge joins to them."""
    own = symbols.filter(F.col("file") == file).select("id")
    touch = lambda a, b: edges.join(own.select(F.col("id").alias(a)), a, "left_semi").select(F.col(b).alias("id"))
    ends = touch("from_id", "to_id").unionByName(touch("to_id", "from_id")).distinct().join(own, "id", "left_anti")
    return own.distinct().withColumn("inside", F.lit(True)).unionByName(ends.join(symbols.select("id"), "id", "left_semi").withColumn("inside", F.lit(False)))


def outline(symbols: DataFrame) -> DataFrame:
    """``id, parent_id, ord``: nesting of each file's symbols by line ranges (see ``nesting``)."""
    return nesting(symbols).select("id", "parent_id", "ord")


def shared_symbols(symbols: DataFrame) -> DataFrame:
    """``name, kind, n_projects`` of the symbols that more than one ``project`` has."""
    return symbols.select("project", "name", "kind").distinct().groupBy("name", "kind").agg(F.count(F.lit(1)).alias("n_projects")).filter("n_projects > 1")


def infer_links(symbols: DataFrame, existing: DataFrame) -> DataFrame:
    """A ``shares-pattern`` link for each pair of projects with a shared symbol and no link yet in either direction.

    The reason names the smallest (name, kind) they share.  Projects of a symbol pair up once, smaller name first.
    """
    there = symbols.select("project", "name", "kind").dropna(subset=["project"]).distinct()
    a, b = there.withColumnRenamed("project", "from_project"), there.withColumnRenamed("project", "to_project")
    pairs = a.join(b, ["name", "kind"]).filter("from_project < to_project").groupBy("from_project", "to_project").agg(F.min(F.struct("name", "kind")).alias("_s"))
    known = existing.select(F.least("from_project", "to_project").alias("from_project"), F.greatest("from_project", "to_project").alias("to_project"))
    reason = F.concat(F.lit("Shared symbol: "), F.col("_s.name"), F.lit(" ("), F.col("_s.kind"), F.lit(")"))
    return pairs.join(known, ["from_project", "to_project"], "left_anti").select("from_project", "to_project", F.lit("shares-pattern").alias("type"), reason.alias("reason"), F.lit(0.7).alias("confidence"))


def project_links(links: DataFrame, project: str) -> DataFrame:
    out = F.when(F.col("from_project") == project, "out").otherwise("in")
    return links.filter((F.col("from_project") == project) | (F.col("to_project") == project)).withColumn("direction", out)


def add_links(links: DataFrame, new: DataFrame) -> DataFrame:
    """``links`` (one for each pair of projects and type) with ``new`` ones in place of those of the same key."""
    key = ["from_project", "to_project", "type"]
    return links.join(new.select(*key).distinct(), key, "left_anti").select(*links.columns).unionByName(new.dropDuplicates(key).select(*links.columns))


def delete_links(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """``links`` without those between the pairs (``from_project, to_project``), in either direction."""
    both = pairs.select("from_project", "to_project").unionByName(pairs.select(F.col("to_project").alias("from_project"), F.col("from_project").alias("to_project"))).distinct()
    return links.join(both, ["from_project", "to_project"], "left_anti")


def cross_query(symbols: DataFrame, name: str, limit: int = 20) -> DataFrame:
    """``project, id, name, kind, file, line_start, n``: the first symbols of that name in each project, and how many it has."""
    hits = find_symbol(symbols, name)
    counts = hits.groupBy("project").agg(F.count(F.lit(1)).alias("n"))
    first = hits.withColumn("_n", F.row_number().over(W.partitionBy("project").orderBy("file", "line_start", "id"))).filter(F.col("_n") <= limit)
    return first.join(counts, "project").select("project", "id", "name", "kind", "file", "line_start", "n")


def context_bundle(files: DataFrame, symbols: DataFrame, edges: DataFrame, entries: DataFrame, links: DataFrame, project: str) -> DataFrame:
    """One row ``payload``: JSON of counts, languages, the ten newest entries of the project and its links."""
    rows = lambda df, name, *order: df.groupBy().agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*df.columns).alias("_row")))).alias(name)).select(F.transform(name, lambda x: x["_row"]).alias(name))
    newest = entries.filter(F.col("global") | (F.col("project") == project)).orderBy(F.desc("created"), "id").limit(10).select("id", "created", "content")
    languages = language_breakdown(files)  # a row for each language, links one for each pair: small by their nature
    parts = stats(files, symbols, edges).crossJoin(rows(languages, "languages", "language"))
    parts = parts.crossJoin(rows(newest, "memory", (-F.unix_micros(F.col("created").cast("timestamp"))).alias("_k"), "id")).crossJoin(rows(project_links(links, project), "links", "from_project", "to_project", "type"))
    return parts.select(F.to_json(F.struct(F.lit(project).alias("project"), F.struct("n_files", "n_symbols", "n_edges").alias("stats"), "languages", "memory", "links")).alias("payload"))
