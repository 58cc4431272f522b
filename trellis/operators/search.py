"""Full-text ranking, exact vector ranking and their fusion."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.text import tokens
from trellis.operators.graph import is_test_path
from trellis.session import materialize

#: Column weights and constants of the ranking function.
WEIGHTS = {"name": 10.0, "signature": 5.0, "doc": 3.0, "content": 1.0}
K1, B, LEAST_IDF, RRF = 1.2, 0.75, 1e-6, 60


def phrases(query: str) -> list[list[str]]:
    """Words of at least two letters, split at ``;`` and white space, each as its folded tokens; the last one is a prefix."""
    out = []
    for word in re.split(r"[;\s]+", query):
        if len(word) < 2:
            continue
        folded = "".join(c for c in unicodedata.normalize("NFD", word.lower()) if not unicodedata.combining(c))
        parts = re.findall(r"[^\W_]+", folded)
        if parts:
            out.append(parts)
    return out


def _hits(text: str, phrase: list[str]) -> Column:
    """Positions at which the phrase begins in tokens that are joined, each behind a blank."""
    return F.regexp_count(text, F.lit("(?= " + " ".join(phrase) + ")"))


def bm25(rows: DataFrame, query: str, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """The rows with a hit of any phrase, with ``score`` (smaller is better).

    One scan scores every row and another counts the rows of each phrase and the mean length; nothing is shuffled but counts.
    """
    wanted = phrases(query)
    if not wanted:
        return rows.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    cols = list(weights)
    worded = rows.select("*", *[F.concat(F.lit(" "), F.array_join(tokens(c), " ")).alias(f"_w_{c}") for c in cols])
    length = sum((F.when(F.length(f"_w_{c}") > 1, F.regexp_count(f"_w_{c}", F.lit(" "))).otherwise(0) for c in cols), F.lit(0)).cast("double")
    f = lambda i: sum((_hits(f"_w_{c}", wanted[i]) * w for c, w in weights.items()), F.lit(0.0))
    counted = worded.select(*rows.columns, length.alias("_len"), *[f(i).alias(f"_f{i}") for i in range(len(wanted))])
    facts = counted.agg(F.count(F.lit(1)).alias("_N"), F.avg("_len").alias("_avg"), *[F.sum((F.col(f"_f{i}") > 0).cast("long")).alias(f"_n{i}") for i in range(len(wanted))])
    scored = counted.filter(sum((F.col(f"_f{i}") for i in range(len(wanted))), F.lit(0.0)) > 0).crossJoin(F.broadcast(facts))  # one row of facts
    score = F.lit(0.0)
    for i in range(len(wanted)):
        n = F.col(f"_n{i}")
        idf = F.greatest(F.log((F.col("_N") - n + 0.5) / (n + 0.5)), F.lit(LEAST_IDF))
        score = score - idf * F.col(f"_f{i}") * (K1 + 1) / (F.col(f"_f{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    return scored.withColumn("score", score).select(*rows.columns, "score")


def search_symbols(symbols: DataFrame, query: str, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Best rows by (score, id); the kind is filtered before the limit, statistics are of the whole table."""
    found = bm25(symbols, query)
    if kind is not None:
        found = found.filter(F.lower("kind") == kind.lower())
    return found.orderBy("score", "id").limit(limit)


# ---------------------------------------------------------------- vectors


def cosine(a: Column, b: Column) -> Column:
    """Over the elements both have, in doubles; 0 where a norm is 0."""
    n = F.least(F.size(a), F.size(b))
    x, y = F.slice(a, 1, n), F.slice(b, 1, n)
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda s, t: s + t)
    norms = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norms == 0, 0.0).otherwise(dot(x, y) / norms)


def usable_vectors(vectors: DataFrame, dim: int = 64) -> DataFrame:
    v = F.col("embedding")
    return vectors.filter(v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))


def nearest(vectors: DataFrame, query: DataFrame, limit: int, kind: str | None = None) -> DataFrame:
    """``id, symbol_name, file, score, rank`` by (score descending, file, name, id); ``query`` is one row ``embedding``."""
    rows = vectors if kind is None else vectors.filter(F.col("symbol_kind") == kind)
    one = F.broadcast(query.select(F.col("embedding").alias("_q")).limit(1))
    scored = rows.crossJoin(one).select("id", "symbol_name", F.coalesce("file", F.lit("")).alias("file"), cosine(F.col("embedding"), F.col("_q")).alias("score"))
    order = [F.desc("score"), "file", "symbol_name", "id"]
    best = scored.orderBy(*order).limit(limit)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)))  # of at most ``limit`` rows


def fuse(lists: list[DataFrame], keys: list[str]) -> DataFrame:
    """Reciprocal rank fusion of lists with a ``rank``: ``keys, score``."""
    rows = lists[0].select(*keys, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select(*keys, "rank"))
    return rows.groupBy(*keys).agg(F.sum(1.0 / (RRF + F.col("rank"))).alias("score"))


def multi_query(vectors: DataFrame, queries: list[DataFrame], limit: int) -> DataFrame:
    """Each query ranks ``2 limit`` rows by (file, name); fused and cut to ``limit``."""
    lists = []
    for q in queries:
        best = nearest(vectors, q, 2 * limit).groupBy("file", "symbol_name").agg(F.min("rank").alias("rank"))
        lists.append(best)
    return fuse(lists, ["file", "symbol_name"]).withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "file", "symbol_name").limit(limit)


def ranked(rows: DataFrame, order: list, limit: int) -> DataFrame:
    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def hybrid(symbols: DataFrame, vectors: DataFrame, text: str, query: DataFrame, limit: int = 20, penalty: bool = True, scores: DataFrame | None = None) -> DataFrame:
    """``name, file, line_start, score``: fused text and vector hits, halved for test files where ``penalty``.

    ``scores (id, score)`` are the text scores where they come from postings.

    A vector hit belongs to the best text hit with its (file, name), else to the first symbol of that (file, name), else it
    stands at line 0.
    """
    # both lists are short and used more than once
    if scores is None:
        best = bm25(symbols, text).orderBy("score", "id").limit(3 * limit)
    else:
        best = symbols.join(F.broadcast(scores.orderBy("score", "id").limit(3 * limit)), "id")
    words = materialize(ranked(best.select("id", "name", "file", "line_start", "score"), ["score", "id"], 3 * limit), "words")
    near = materialize(nearest(vectors, query, 3 * limit), "near").select(F.col("symbol_name").alias("name"), "file", "rank").groupBy("name", "file").agg(F.min("rank").alias("rank"))
    first_hit = words.groupBy("name", "file").agg(F.min_by("line_start", "rank").alias("_hit"))
    first_symbol = symbols.join(F.broadcast(near.select("name", "file")), ["name", "file"], "left_semi").groupBy("name", "file").agg(F.min_by("line_start", "id").alias("_symbol"))
    placed = near.join(first_hit, ["name", "file"], "left").join(first_symbol, ["name", "file"], "left").withColumn("line_start", F.coalesce("_hit", "_symbol", F.lit(0).cast("long")))
    fused = fuse([words, placed], ["name", "file", "line_start"])
    if penalty:
        fused = fused.withColumn("score", F.when(is_test_path("file"), F.col("score") * 0.5).otherwise(F.col("score")))
    return fused.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "file", "line_start", "name").limit(limit)


def boost(hits: DataFrame, edges: DataFrame, symbols: DataFrame, limit: int = 20, doc_files: DataFrame | None = None) -> DataFrame:
    """Adds to hits, or appends, their first three callers (0.3 of the score) and callees of confidence 0.5 (0.15).

    Those in ``doc_files (file)`` are added to hits, but not appended.
    """
    hits = materialize(hits, "hits")
    seeds = F.broadcast(hits.select("name", "score").groupBy("name").agg(F.sum("score").alias("_s")))
    own = symbols.select("id", "name").join(seeds, "name")

    def side(mine: str, other: str, part: float, rows: DataFrame) -> DataFrame:
        ends = rows.join(own.select(F.col("id").alias(mine), F.col("name").alias("_of"), "_s"), mine).select("_of", "_s", F.col("id").alias("_edge"), F.col(other).alias("id"))
        first = F.row_number().over(W.partitionBy("_of").orderBy("_edge", "id"))
        near = ends.withColumn("_n", first).filter("_n <= 3")
        return near.join(symbols.select("id", "name", "file", "line_start"), "id").select("name", "file", "line_start", (F.col("_s") * part).alias("score"))

    extra = side("to_id", "from_id", 0.3, edges).unionByName(side("from_id", "to_id", 0.15, edges.filter("confidence >= 0.5")))
    if doc_files is not None:
        place = ["name", "file", "line_start"]
        kept = extra.join(doc_files.select("file").distinct(), "file", "left_anti")
        extra = kept.select(*extra.columns).unionByName(extra.join(doc_files.select("file").distinct(), "file", "left_semi").join(hits.select(*place), place, "left_semi").select(*extra.columns))
    total = hits.select("name", "file", "line_start", "score").unionByName(extra).groupBy("name", "file", "line_start").agg(F.round(F.sum("score"), 9).alias("score"))
    return total.orderBy(F.desc("score"), "file", "line_start", "name").limit(limit)


def tool_search(scores: DataFrame, symbols: DataFrame, limit: int = 20, kind: str | None = None) -> DataFrame:
    """Text hits where there are no vectors: in the order of the text scores (``id, score``), the score told as 0."""
    rows = scores.join(symbols if kind is None else symbols.filter(F.lower("kind") == kind.lower()), "id")
    best = ranked(rows, ["score", "id"], limit)
    return best.select("rank", "id", "name", "kind", "file", "line_start", F.lit(0.0).alias("score"))


def expand_single(hits: DataFrame, edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """``side, id, name, file, line_start`` of the callers and callees of the hit, if it is the only one (``hits`` are few)."""
    one = hits.limit(2).groupBy().agg(F.count(F.lit(1)).alias("_n"), F.min("id").alias("_id")).filter("_n = 1").select("_id")
    only = F.broadcast(one)
    near = lambda side, own, other: edges.join(only, F.col(own) == F.col("_id")).select(F.lit(side).alias("side"), F.col(other).alias("id"))
    ends = near("caller", "to_id", "from_id").unionByName(near("callee", "from_id", "to_id")).distinct()
    return ends.join(symbols.select("id", "name", "file", "line_start"), "id").select("side", "id", "name", "file", "line_start")
