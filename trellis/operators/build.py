"""From source files to the graph: what to read, call and import resolution, identity across builds, upkeep.

``call_sites``: ``call_id, file, caller, callee, receiver, line, kind``; ``imports``: ``import_id, file, source, name``.
Where several symbols would do, the smallest id is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.operators.graph import CONTAINERS
from trellis.operators.order import numbered

# ---- fixed values: languages by extension or file name, suffixes tried for relative imports, kinds of calls
LANGUAGES = [
    (".ts", "typescript"), (".tsx", "typescript"), (".js", "javascript"), (".jsx", "javascript"), (".mjs", "javascript"), (".py", "python"),
    (".go", "go"), (".rs", "rust"), (".rb", "ruby"), (".tf", "hcl"), (".tfvars", "hcl"), (".yml", "yaml"),
    (".yaml", "yaml"), (".md", "markdown"), (".c", "c"), (".h", "c"), (".m", "objc"), (".mm", "objc"),
    (".java", "java"), (".php", "php"), (".swift", "swift"), (".sh", "bash"), (".bash", "bash"), (".zsh", "bash"),
    (".pl", "perl"), (".pm", "perl"), (".html", "html"), (".htm", "html"), (".toml", "toml"), (".sql", "sql"),
    ("Dockerfile", "dockerfile"), (".cpp", "cpp"), (".cc", "cpp"), (".cxx", "cpp"), (".hpp", "cpp"), (".hh", "cpp"),
    (".cs", "csharp"), (".kt", "kotlin"), (".kts", "kotlin"), (".dart", "dart"), (".scala", "scala"), (".sc", "scala"),
    (".r", "r"), (".R", "r"), (".graphql", "graphql"), (".gql", "graphql"), (".ps1", "powershell"), (".psm1", "powershell"),
]
IMPORT_SUFFIXES = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", "/index.ts", "/index.js")
CALL_KINDS = {
    "listens": ("addEventListener", "on", "once", "addListener", "subscribe", "observe"),
    "emits": ("emit", "dispatch", "trigger", "fire", "publish", "send", "broadcast"),
    "spawns": ("spawn", "fork"),
}


def language_of(path: str) -> Column:
    """Language by the extension (a name that begins with its only dot has none), else by the whole file name; else null."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES for x in pair])
    base = F.element_at(F.split(path, "/"), -1)
    ext = F.when(F.locate(".", base, 2) > 0, F.concat(F.lit("."), F.element_at(F.split(base, r"\."), -1)))
    return F.coalesce(F.try_element_at(table, F.coalesce(ext, F.lit("\0"))), F.try_element_at(table, base))


def call_kind(name: str) -> Column:
    out = F.lit("calls")
    for kind, names in CALL_KINDS.items():
        out = F.when(F.col(name).isin(*names), kind).otherwise(out)
    return out


def line_count(body: str) -> Column:
    """Lines; a last line break ends a line and begins none."""
    n = F.regexp_count(body, F.lit("\n"))
    return F.when(F.length(body) == 0, 0).otherwise(n + F.when(F.col(body).endswith("\n"), 0).otherwise(1))


def is_dense(body: str) -> Column:
    """More than 5000 bytes and more than 500 of them a line: taken for minified and not read."""
    size = F.octet_length(body)
    return (size > 5000) & (F.floor(size / F.greatest(line_count(body), F.lit(1))) > 500)


def changed_files(now: DataFrame, known: DataFrame, full: bool = False, only: list[str] | None = None) -> DataFrame:
    """``path, hash`` of the files (``path, body``) whose content hash is not the known one (``path, hash``)."""
    hashed = now.select("path", F.sha2(F.col("body").cast("binary"), 256).alias("hash"))
    if only is not None:
        return hashed.filter(F.col("path").isin(*only))
    return hashed if full else hashed.join(known.select("path", "hash"), ["path", "hash"], "left_anti")


def stale_files(known: DataFrame, found: DataFrame, unreadable: list[str] | None = None) -> DataFrame:
    """Known files that were not found, but for those below a folder that could not be read."""
    gone = known.select("path").distinct().join(found.select("path"), "path", "left_anti")
    for folder in unreadable or []:
        gone = gone.filter(~F.col("path").startswith(f"{folder}/"))
    return gone


def purge(files: DataFrame, symbols: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, symbols and edges without those of ``gone (path)``; edges go with either end."""
    keep = symbols.join(gone.select(F.col("path").alias("file")), "file", "left_anti")
    ends = keep.select("id")
    left = edges.join(ends.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(ends.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return files.join(gone.select("path"), "path", "left_anti"), keep, left


def reset_outgoing(edges: DataFrame, symbols: DataFrame, changed: DataFrame) -> DataFrame:
    """Edges that do not start in a changed file (``path``)."""
    own = symbols.join(changed.select(F.col("path").alias("file")), "file", "left_semi").select(F.col("id").alias("from_id"))
    return edges.join(own, "from_id", "left_anti")


def reuse_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """``new_id, old_id, change``: within (file, name, kind) the n-th old symbol is the n-th new one, by (line_start, id)."""
    key = ["file", "name", "kind"]
    nth = lambda df, c: df.select(*key, F.col("id").alias(c), F.row_number().over(W.partitionBy(*key).orderBy("line_start", "id")).alias("n"))
    rows = nth(old, "old_id").join(nth(new, "new_id"), [*key, "n"], "full")
    return rows.select("new_id", "old_id", F.when(F.col("old_id").isNull(), "insert").when(F.col("new_id").isNull(), "delete").otherwise("keep").alias("change"))


def upsert_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """The symbols of the files of ``new`` in place of the old ones of these files; a symbol that was there keeps its id,
    others get ids above all there are, in the order (file, line_start, name, kind)."""
    files = new.select("file").distinct()
    same = reuse_ids(old.join(files, "file", "left_semi"), new)
    rows = new.withColumnRenamed("id", "new_id").join(same.filter("new_id is not null").select("new_id", "old_id"), "new_id")
    kept = rows.filter("old_id is not null").withColumnRenamed("old_id", "id").select(*old.columns)
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))  # one row
    fresh = numbered(rows.filter("old_id is null").drop("old_id"), ["file", "line_start", "name", "kind", "new_id"], "_n").crossJoin(F.broadcast(top))
    fresh = fresh.withColumn("id", (F.col("_top") + F.col("_n") + 1).cast("long")).select(*old.columns)
    return old.join(files, "file", "left_anti").select(*old.columns).unionByName(kept).unionByName(fresh)


def embed_plan(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, action, n``: copies to embed or to delete, as a difference of multisets."""
    count = lambda df, c: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(c))
    a, b = count(wanted, "w"), count(stored, "s")
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    rows = a.alias("a").join(b.alias("b"), same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], (F.coalesce("w", F.lit(0)) - F.coalesce("s", F.lit(0))).alias("d"))
    return rows.filter("d != 0").select(*keys, F.when(F.col("d") > 0, "embed").otherwise("delete").alias("action"), F.abs("d").alias("n"))


def resolve_imports(imports: DataFrame, files: DataFrame, normalize: bool = False) -> DataFrame:
    """``import_id, target``: the first indexed file among the candidates of a relative source.

    Folder and source are joined as they stand; ``normalize`` takes ``.`` and ``..`` out of the path.
    """
    rows = imports.filter(F.col("source").startswith(".")).select("import_id", F.concat(F.regexp_replace("file", r"/?[^/]*$", ""), F.lit("/"), "source").alias("at"))
    if normalize:
        step = lambda acc, part: F.when((part == ".") | (part == ""), acc).when(part == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(part)))
        rows = rows.withColumn("at", F.array_join(F.aggregate(F.split("at", "/"), F.array().cast("array<string>"), step), "/"))
    tried = rows.select("import_id", F.posexplode(F.array(*[F.concat("at", F.lit(s)) for s in IMPORT_SUFFIXES])).alias("ord", "path"))
    return tried.join(files.select("path").distinct(), "path").groupBy("import_id").agg(F.min_by("path", "ord").alias("target"))


def resolve_calls(call_sites: DataFrame, symbols: DataFrame, imported: DataFrame) -> DataFrame:
    """One edge ``call_id, from_id, to_id, kind, confidence`` for each call whose caller and callee are known.

    The callee is sought in the same file, then in the file that the name is imported from (``imported``: ``file, name,
    target``), then inside a container named like the receiver, all for 1.0; then anywhere, for 0.5 or, behind a
    receiver, 0.3.
    """
    by_place = symbols.groupBy("file", "name").agg(F.min("id").alias("id"))
    by_name = symbols.groupBy("name").agg(F.min("id").alias("id"))
    place = lambda f, n, c: by_place.select(F.col("file").alias(f), F.col("name").alias(n), F.col("id").alias(c))
    rows = call_sites.join(place("file", "caller", "from_id"), ["file", "caller"]).join(place("file", "callee", "t1"), ["file", "callee"], "left")
    via = imported.groupBy("file", "name").agg(F.max_by("target", "import_id").alias("target")).withColumnRenamed("name", "callee")
    rows = rows.join(via, ["file", "callee"], "left").join(place("target", "callee", "t2"), ["target", "callee"], "left")
    inside = symbols.select(F.col("id").alias("m_id"), F.col("name").alias("callee"), "file", "line_start", "line_end")
    around = symbols.filter(F.col("kind").isin(*CONTAINERS)).select(F.col("name").alias("receiver"), "file", F.col("line_start").alias("c_start"), F.col("line_end").alias("c_end"))
    wanted = call_sites.filter("receiver is not null").select("receiver", "callee").distinct()
    held = around.join(wanted.select("receiver").distinct(), "receiver", "left_semi").join(inside, "file").filter("line_start >= c_start and line_end <= c_end").join(wanted, ["receiver", "callee"], "left_semi")
    rows = rows.join(held.groupBy("receiver", "callee").agg(F.min("m_id").alias("t3")), ["receiver", "callee"], "left")
    rows = rows.join(by_name.select(F.col("name").alias("callee"), F.col("id").alias("t4")), "callee", "left")
    sure = F.coalesce("t1", "t2", "t3")
    confidence = F.when(sure.isNotNull(), 1.0).when(F.col("receiver").isNotNull(), 0.3).otherwise(0.5)
    return rows.select("call_id", "from_id", F.coalesce(sure, "t4").alias("to_id"), "kind", confidence.alias("confidence")).filter("to_id is not null")


def import_edges(imports: DataFrame, symbols: DataFrame, targets: DataFrame) -> DataFrame:
    """``import_id, from_id, to_id, kind``: from the first symbol of the importing file to the one imported."""
    name = F.regexp_replace("name", r"^\* as ", "")
    by_place = symbols.groupBy("file", "name").agg(F.min("id").alias("id"))
    rows = imports.withColumn("name", name).join(targets, "import_id", "left")
    rows = rows.join(by_place.select(F.col("file").alias("target"), "name", F.col("id").alias("t1")), ["target", "name"], "left")
    rows = rows.join(symbols.groupBy("name").agg(F.min("id").alias("t2")), "name", "left").join(symbols.groupBy("file").agg(F.min("id").alias("from_id")), "file")
    return rows.select("import_id", "from_id", F.coalesce("t1", "t2").alias("to_id"), F.lit("imports").alias("kind")).filter("to_id is not null")


# ---------------------------------------------------------------- markdown


def markdown_symbols(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, line_start, line_end, level, name, kind``: headings (up to level 2 as Class, else Type) and their reach.

    A heading reaches to the line before the next one of its rank or a higher one; fenced lines hold no headings.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line"), F.size(F.split(text, "\n")).alias("n"))
    fence = F.regexp_like("line", F.lit(r"^\s*(```|~~~)")).cast("int")
    lines = lines.withColumn("_open", F.sum(fence).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, 0)) % 2)
    heads = lines.filter(r"_open = 0 and line rlike '^#{1,6}\\s+\\S'").select(key, (F.col("i") + 1).cast("long").alias("line_start"), "n", F.length(F.regexp_extract("line", r"^(#+)", 1)).alias("level"), F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s+", ""), r"\s+$", "")).alias("name"))
    later = W.partitionBy(key).orderBy("line_start").rowsBetween(1, W.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("line_start"))).over(later) for k in range(1, 7)]
    nxt = F.element_at(F.array(*ends), F.col("level"))
    return heads.select(key, "line_start", F.coalesce(nxt - 1, F.col("n").cast("long")).alias("line_end"), F.col("level").cast("int").alias("level"), "name", F.when(F.col("level") <= 2, "Class").otherwise("Type").alias("kind"))


def markdown_links(texts: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """``key, target``: different targets of links and wiki links that are no web addresses."""
    plain = F.regexp_extract_all(text, F.lit(r"\[[^\]\n]*\]\(([^)\s]+)\)"), 1)
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#\n]+)"), 1)
    return texts.select(key, F.explode(F.array_distinct(F.concat(plain, wiki))).alias("target")).filter(r"not target rlike '^https?://'")
