"""References to records that do not exist.

Method: references and parent keys are dealt to the same partitions and sorted by key, and one pass merges the two
streams (a sort-merge join; the plan is fixed by a hint).  A parent key carries its validity: from its earliest
loading on, or, if no row has it any more, up to its removal.

A key that very many references name would put them into one task.  Such keys are counted first (with partial counts
on the map side); their references are salted over as many tasks as they fill and the one parent row of each is repeated
there (see ``skew``, which also bounds the number of such keys).

Defined results: a null reference is none; repeated rows count once; a parent without a loading time exists from the
beginning; a reference without one is never late and has no month; removals count only if no row has the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellis.operators.skew import HOT, salted


def orphans(refs: DataFrame, parents: DataFrame, removed: DataFrame, hot: int = HOT) -> DataFrame:
    """``(row_id, loaded_at, state)`` of each reference whose parent is missing, deleted or late.

    ``refs``: ``key, row_id, loaded_at``; ``parents``: ``key, loaded_at``; ``removed``: ``key``.
    """
    refs = refs.select("key", "row_id", "loaded_at").filter("key is not null")
    ends = (
        parents.filter("key is not null").select("key", F.col("loaded_at").alias("since"), F.lit(True).alias("here"))
        .unionByName(removed.filter("key is not null").select("key", F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(False).alias("here")))
        .groupBy("key").agg(F.min("since").alias("since"), F.max("here").alias("here"))
    )
    refs, ends = salted(refs, ends, "key", "row_id", hot)
    state = F.when(F.col("here"), F.when(F.col("since") > F.col("loaded_at"), "late")).when(F.col("here").isNull(), "missing").otherwise("deleted")
    return refs.join(ends.hint("merge"), ["key", "_salt"], "left").withColumn("state", state).filter("state is not null").select("row_id", "loaded_at", "state").distinct()


def _ntz(c: str) -> Column:
    return F.col(c).cast("timestamp_ntz")


def orphan_references(edges: DataFrame, vectors: DataFrame, symbols: DataFrame, files: DataFrame, removals: DataFrame, hot: int = HOT) -> DataFrame:
    """``(ref_table, row_id, ref_month, ref_state)`` over edges.to_id, vectors.symbol_name and symbols.file."""
    gone = lambda table, col: removals.filter(F.col("target_table") == table).select(F.col(col).alias("key"))
    key = lambda df, col, row=None: df.select(F.col(col).alias("key"), *[F.col("id").alias("row_id")] * bool(row), _ntz("loaded_at").alias("loaded_at"))
    named = vectors.filter(F.col("symbol_kind").isNull() | (F.col("symbol_kind") != "memory"))
    parts = [
        ("edges", orphans(key(edges, "to_id", True), key(symbols, "id"), gone("symbols", "target_id"), hot)),
        ("vectors", orphans(key(named, "symbol_name", True), key(symbols, "name"), gone("symbols", "target_name"), hot)),
        ("symbols", orphans(key(symbols, "file", True), key(files, "path"), gone("files", "target_name"), hot)),
    ]
    out = None
    for name, rows in parts:
        rows = rows.select(F.lit(name).alias("ref_table"), "row_id", F.date_format("loaded_at", "yyyy-MM").alias("ref_month"), F.col("state").alias("ref_state"))
        out = rows if out is None else out.unionByName(rows)
    return out.distinct()


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans per table, month and state."""
    return found.groupBy("ref_table", "ref_month", "ref_state").agg(F.count(F.lit(1)).alias("n_refs"))
