"""Text forms of a graph: one line of output a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dot_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = symbols.select(F.concat(F.lit("  n"), "id", F.lit(' [label="'), F.replace("name", F.lit('"'), F.lit('\\"')), F.lit('"];')).alias("line"))
    return nodes.unionByName(edges.select(F.concat(F.lit("  n"), "from_id", F.lit(" -> n"), "to_id", F.lit(' [label="'), "kind", F.lit('"];')).alias("line")))


def mermaid_lines(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    nodes = symbols.select(F.concat(F.lit("  n"), "id", F.lit('["'), F.replace("name", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"))
    return nodes.unionByName(edges.select(F.concat(F.lit("  n"), "from_id", F.lit(" -->|"), "kind", F.lit("| n"), "to_id").alias("line")))


def json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("line"))


def write_text(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)


def page_name(name: str):
    """A name that can be a file name."""
    return F.regexp_replace(F.regexp_replace(name, r"[/\\:<>|?*\"`]", "_"), r"^_+|_+$", "")


def vault_pages(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """``page, body``: one note for each symbol with front matter and links to what it uses and what uses it.

    Names that several symbols share get their file behind them.
    """
    n = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("_n"))
    stem = F.regexp_extract("file", r"([^/.]+)[^/]*$", 1)
    pages = symbols.join(n, "name").withColumn("page", F.when(F.col("_n") > 1, F.concat(page_name("name"), F.lit(" ("), stem, F.lit(")"))).otherwise(page_name("name")))
    names = pages.select("id", "page")
    link = lambda own, other: (
        edges.join(names.select(F.col("id").alias(other), "page"), other).groupBy(F.col(own).alias("id")).agg(F.array_sort(F.collect_set("page")).alias(f"_{other}"))
    )
    rows = pages.join(link("from_id", "to_id"), "id", "left").join(link("to_id", "from_id"), "id", "left")
    part = lambda title, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"\n## {title}\n"), F.array_join(F.transform(c, lambda x: F.concat(F.lit("- [["), x, F.lit("]]"))), "\n"), F.lit("\n"))).otherwise("")
    front = F.concat(F.lit("---\nkind: "), F.coalesce("kind", F.lit("")), F.lit("\nfile: "), F.coalesce("file", F.lit("")), F.lit("\n---\n# "), "name", F.lit("\n"))
    return rows.select("page", F.concat(front, part("Uses", "_to_id"), part("Used by", "_from_id")).alias("body"))
