"""A table of postings kept beside the rows, so that a text query reads only the tokens it names.

``terms``: ``token, id, col, positions, length`` in ranges of the token; ``facts``: one row ``n_rows, mean_length``.
Ids must be unique.  A null text has no tokens; rows without tokens count in the facts alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.functions.text import tokens
from trellis.operators.search import B, K1, LEAST_IDF, WEIGHTS, phrases
from trellis.session import materialize


@dataclass
class Postings:
    terms: DataFrame
    facts: DataFrame
    weights: dict[str, float]


def build_postings(rows: DataFrame, weights: dict[str, float] = WEIGHTS) -> Postings:
    """Both tables, written to the shared folder."""
    cols = list(weights)
    worded = rows.select("id", *[tokens(c).alias(f"w{i}") for i, c in enumerate(cols)])
    placed = lambda i: F.transform(f"w{i}", lambda t, k: F.struct(F.lit(i).alias("col"), k.cast("int").alias("pos"), t.alias("token")))
    each = F.concat(*map(placed, range(len(cols))))
    length = sum((F.size(f"w{i}") for i in range(len(cols))), F.lit(0)).alias("length")
    spread = worded.select("id", length, F.explode(each).alias("e")).select("id", "length", "e.*")
    # positions come together before the tokens are dealt out by ranges
    terms = spread.groupBy("token", "id", "col", "length").agg(F.sort_array(F.collect_list("pos")).alias("positions"))
    terms = materialize(terms.repartitionByRange("token").sortWithinPartitions("token", "id"), "postings")
    facts = materialize(worded.select(length).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("length").alias("mean_length")), "posting_facts")
    return Postings(terms, facts, weights)


def _starts(terms: DataFrame, phrase: list[str]) -> DataFrame:
    """``id, length, col, n``: how often the phrase begins in a column; the last word is a prefix, the others are whole."""
    last = len(phrase) - 1
    of = lambda k: terms.filter(F.col("token") == phrase[k] if k < last else F.col("token").startswith(phrase[k]))
    if not last:
        return of(0).select("id", "length", "col", F.size("positions").alias("n"))
    at = of(0).select("id", "length", "col", F.explode("positions").alias("at"))
    for k in range(1, last + 1):
        at = at.join(of(k).select("id", "col", F.explode(F.transform("positions", lambda p: p - k)).alias("at")), ["id", "col", "at"], "left_semi")
    return at.groupBy("id", "length", "col").agg(F.count(F.lit(1)).alias("n"))


def bm25_postings(index: Postings, query: str) -> DataFrame:
    """``id, score`` (smaller is better) of the rows with a hit of any phrase, as ``search.bm25`` gives them."""
    wanted = phrases(query)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in enumerate(map(float, index.weights.values())) for x in pair]), F.col("col"))
    out = None
    for i, phrase in enumerate(wanted):
        hits = _starts(index.terms, phrase).groupBy("id", "length").agg(F.sum(F.col("n") * weight).alias("f")).withColumn("phrase", F.lit(i))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return index.terms.select("id", F.lit(0.0).alias("score")).limit(0)
    counts = out.groupBy("phrase").agg(F.count(F.lit(1)).alias("_n"))  # one row for each phrase of the query
    rows = out.join(F.broadcast(counts), "phrase").crossJoin(F.broadcast(index.facts))
    idf = F.greatest(F.log((F.col("n_rows") - F.col("_n") + 0.5) / (F.col("_n") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    return rows.groupBy("id").agg((-F.sum(part)).alias("score"))
