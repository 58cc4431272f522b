"""Queries of the operators for training data, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trellis.llm.chunking import oversized, split_items
from trellis.llm.docpairs import doc_pairs
from trellis.llm.handwritten import not_handwritten
from trellis.llm.langid import document_languages, fit, language_segments, mislabelled
from trellis.llm.leakage import leaks, without_leaks
from trellis.llm.mixing import mix, shares
from trellis.llm.neighbours import similar_pairs, similar_vectors
from trellis.session import materialize
from trellis.sources import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return similar_pairs(similar_vectors(table(spark, d, "vectors"), k=5, min_cosine=0.9)).select("id_a", "id_b")


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "vectors")
    near = similar_vectors(vectors, k=5, exhaustive=True)
    name = vectors.select("id", "symbol_name").dropDuplicates(["id"])
    return near.join(name, "id").join(name.select(F.col("id").alias("other_id"), F.col("symbol_name").alias("other_name")), "other_id").select("id", "symbol_name", "other_id", "other_name", F.round("cosine", 6).alias("cosine"), "rank")


def p1_search(spark: SparkSession, d: str) -> DataFrame:
    near = similar_vectors(table(spark, d, "vectors"), k=10, tables=12, hashes=1, probes=2, queries="id % 20 = 0")
    return near.select("id", "other_id", F.round("cosine", 6).alias("cosine"), "rank")


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs(table(spark, d, "symbols"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("symbol_id").distinct()


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    return not_handwritten(table(spark, d, "files"), table(spark, d, "file_texts"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_files(spark, d).select("file_id")


def _long_texts(spark: SparkSession, d: str) -> DataFrame:
    symbols = table(spark, d, "symbols").select(F.lit("symbols").alias("ref_table"), F.col("id").alias("row_id"), F.col("content").alias("text"))
    vectors = table(spark, d, "vectors").select(F.lit("vectors").alias("ref_table"), F.col("id").alias("row_id"), "text")
    return symbols.unionByName(vectors)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return oversized(split_items(_long_texts(spark, d), ["ref_table", "row_id"], "text"), ["ref_table", "row_id"])


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_items(_long_texts(spark, d), ["ref_table", "row_id"], "text")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    return without_leaks(table(spark, d, "documents").select("doc_id"), p7_leaks(spark, d))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_segments(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return language_segments(documents, fit(documents))


def p9_languages(spark: SparkSession, d: str) -> DataFrame:
    return document_languages(materialize(p9_segments(spark, d), "segments"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mislabelled(materialize(p9_languages(spark, d), "languages"))


QUERIES = {"p1_found": p1_found, "p1_neighbours": p1_neighbours, "p1_search": p1_search, "p3_found": p3_found, "p3_pairs": p3_pairs, "p4_found": p4_found, "p4_files": p4_files, "p6_found": p6_found, "p6_pieces": p6_pieces, "p7_found": p7_found, "p7_leaks": p7_leaks, "p7_kept": p7_kept, "p8_mix": p8_mix, "p8_shares": p8_shares, "p9_found": p9_found, "p9_segments": p9_segments, "p9_languages": p9_languages}

_GRAMS = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(regexp_replace(text, '[\x{AD}\x{200B}-\x{200F}\x{2060}\x{FEFF}]', '', 'g'))), '[\p{L}\p{Nd}]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{Nd}]+') AS w FROM benchmark),
dg AS (SELECT doc_id, i - 1 AS d, array_to_string(w[i:i + 11], ' ') AS g FROM doc, unnest(range(1, len(w) - 10)) AS r(i)),
ig AS (SELECT item_id, i - 1 AS t, array_to_string(w[i:i + 11], ' ') AS g FROM item, unnest(range(1, len(w) - 10)) AS r(i)),
hit AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""

SQL = {
    "p7_found": _GRAMS + "SELECT doc_id, item_id FROM hit",
    "p7_leaks": _GRAMS
    + """, place AS (SELECT doc_id, item_id, d, t, t - row_number() OVER (PARTITION BY doc_id, item_id, d - t ORDER BY t) AS run FROM dg JOIN ig USING (g)),
    runs AS (SELECT doc_id, item_id, count(*) + 11 AS n_words, min(d) AS doc_word, min(t) AS item_word FROM place GROUP BY doc_id, item_id, d - t, run)
    SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n_words DESC, doc_word, item_word) = 1""",
    "p7_kept": _GRAMS + "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
    "p6_found": """SELECT DISTINCT 'symbols' AS ref_table, id AS row_id FROM symbols WHERE strlen(content) > 2000
      UNION SELECT 'vectors', id FROM vectors WHERE strlen(text) > 2000""",
}
