"""Mixing sources to target weights.

Method: a low-discrepancy schedule.  The token counts of a public tokenizer give each source its quota: its share of the
total, at most ``max_repeats`` times what it has; what a short source lacks goes to the others in proportion to their
shares.  The documents of a source are shuffled by a hash, laid end to end once for each pass, and cut into blocks of
about ``block_tokens`` tokens.  Slot number i of the mix draws the van der Corput point of i, which falls into one
source's part of the cumulative weights; the n-th slot of a source takes its n-th block.  Any stretch of the mix thereby
holds nearly the target shares.  No table of slots is made: the slots of a source are some arithmetic progressions, in
which the n-th is found by bisection.

Positions are prefix sums in two steps (sums of small hash ranges, then within a range), so that no task holds a source.
``targets`` must be small; it is read to the driver and its size is checked against ``MAX_SOURCES``.

Defined results: a null source, a source without a target or of share or repeats not above zero takes no part; repeated
targets count once (the smallest of each); repeated documents (same id) count once; a null or empty text has no tokens
and no place; a document is whole in one block, so a quota is passed by less than one document; no documents, no rows.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.session import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that cuts a text before the byte pairs of such a vocabulary are merged (a fixed value of it).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_SOURCES = 10_000
#: Hash ranges of a source for prefix sums.
RANGES = 4096


def _counter(path: str) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            batch["n_tokens"] = [sum(len(encoding.encode_ordinary(p)) for p in _parts(t)) for t in batch["text"]]
            yield batch[["doc_id", "source", "n_tokens"]]

    return run


_CUT = re.compile(r"(?<=\S)\s")


def _parts(text: str, size: int = 1 << 20) -> Iterator[str]:
    """A long text in parts that have together the tokens of the whole: no token of the pattern goes on behind a word into
    white space, so a cut before it changes nothing.  A stretch without such a place is not cut, however long."""
    at = 0
    while len(text) - at > size and (m := _CUT.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents that have a source and a text."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").filter("doc_id is not null and source is not null and length(text) > 0")
    counted = rows.mapInPandas(_counter(tokenizer), "doc_id long, source string, n_tokens long")
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("_m")).select("doc_id", "_m.source", "_m.n_tokens").filter("n_tokens > 0")


def quotas(have: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, float]:
    """Tokens of each source; shortfalls are spread over the others in proportion to their shares."""
    cap = {s: have.get(s, 0) * r for s, (_, r) in targets.items()}
    left, open_, out = float(total), {s: w for s, (w, _) in targets.items() if cap[s] > 0}, {}
    while open_:
        weight = sum(open_.values())
        full = [s for s, w in open_.items() if left * w / weight >= cap[s]]
        if not full:
            out |= {s: left * w / weight for s, w in open_.items()}
            break
        for s in full:
            out[s] = float(cap[s])
        left -= sum(cap[s] for s in full)
        open_ = {s: w for s, w in open_.items() if s not in full}
    return out


def prefix_sum(rows: DataFrame, group: list[str], order: Column, tie: str, value: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of the group that come earlier by (order hash, tie)."""
    rows = rows.withColumn("_o", order).withColumn("_r", F.shiftright(F.col("_o"), 64 - int(math.log2(RANGES))))
    sums = rows.groupBy(*group, "_r").agg(F.sum(value).alias("_s"))
    before = sums.withColumn("_b", F.coalesce(F.sum("_s").over(W.partitionBy(*group).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    inner = F.coalesce(F.sum(value).over(W.partitionBy(*group, "_r").orderBy("_o", tie).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_i", inner).join(before, [*group, "_r"]).withColumn(name, F.col("_b") + F.col("_i")).drop("_o", "_r", "_b", "_i")


#: Bits to which the borders of the sources' parts are rounded.
BITS = 48


def progressions(low: int, high: int, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Slots whose van der Corput point lies in [low, high) / 2 ** bits, as residues and moduli.

    A dyadic part of length 2 ** -k holds the points of the slots of one residue modulo 2 ** k, its digits mirrored.
    """
    residues, moduli = [], []
    while low < high:
        size = min(low & -low or 1 << bits, 1 << ((high - low).bit_length() - 1))
        k = bits - (size.bit_length() - 1)
        residues.append(int(format(low >> (bits - k), f"0{k}b")[::-1], 2) if k else 0)
        moduli.append(1 << k)
        low += size
    return np.array(residues, "i8"), np.array(moduli, "i8")


def nth_slots(n: np.ndarray, residues: np.ndarray, moduli: np.ndarray) -> np.ndarray:
    """Number of the n-th slot (from 0) of a source, by bisection over how many of its slots come before a number."""
    share = (1.0 / moduli).sum()
    slack = len(moduli) + 2  # the count up to N is N * share but for one for each progression
    low = np.maximum(0, np.floor((n - slack) / share)).astype("i8")
    high = np.ceil((n + slack) / share).astype("i8") + 1
    while (low < high).any():  # the smallest N with more than n slots up to and with N
        mid = (low + high) // 2
        held = sum(np.maximum(0, (mid - r) // m + 1) for r, m in zip(residues, moduli))
        low, high = np.where(held > n, low, np.minimum(mid + 1, high)), np.where(held > n, mid, high)
    return low


def _slots(parts: dict[str, tuple[int, int]]) -> Callable:
    @F.pandas_udf("long")
    def run(source: pd.Series, block: pd.Series) -> pd.Series:
        out = np.zeros(len(source), "i8")
        for name, at in source.groupby(source).indices.items():
            n, back = np.unique(block.to_numpy()[at], return_inverse=True)
            out[at] = nth_slots(n, *progressions(*parts[name]))[back]
        return pd.Series(out)

    return run


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, block_tokens: int = 8192, seed: int = 7, tokenizer: str = TOKENIZER, with_text: bool = False,
) -> DataFrame:
    """``slot, place, doc_id, copy, source, n_tokens``: the mix in the order (slot, place).

    ``total_tokens`` is the size of the mix, by default that of all documents that may take part.
    """
    counts = materialize(token_counts(documents, tokenizer), "tokens")
    out = _schedule(counts, _plan(counts, targets, total_tokens), block_tokens, seed)
    if with_text:
        text = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        out = out.join(text, "doc_id")
    return out


def _plan(counts: DataFrame, targets: DataFrame, total_tokens: int | None) -> dict[str, tuple[float, int, int, float]]:
    """Share, repeats, tokens there and quota of each source."""
    rows = targets.select("source", F.col("target_share").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r")).filter("source is not null and w > 0 and r > 0")
    rows = rows.groupBy("source").agg(F.min("w").alias("w"), F.min("r").alias("r")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    target = {r.source: (r.w, r.r) for r in rows}
    have = {r.source: r.n for r in counts.filter(F.col("source").isin(list(target))).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if target else {}
    total = sum(have.values()) if total_tokens is None else total_tokens
    quota = quotas(have, target, total)
    return {s: (w, r, have.get(s, 0), quota.get(s, 0.0)) for s, (w, r) in target.items()}


def _schedule(counts: DataFrame, plan: dict[str, tuple[float, int, int, float]], block_tokens: int, seed: int) -> DataFrame:
    spark = counts.sparkSession
    used = {s: p for s, p in plan.items() if p[3] > 0}
    schema = "slot long, place long, doc_id long, copy int, source string, n_tokens long"
    if not used:
        return spark.createDataFrame([], schema)
    blocks = {s: max(1, math.ceil(q / block_tokens)) for s, (_, _, _, q) in used.items()}
    names, total = sorted(used), sum(blocks.values())
    edges = [0]
    for name in names:  # whole numbers, so that the parts leave no gap
        edges.append(edges[-1] + blocks[name])
    parts = {name: ((a << BITS) // total, (b << BITS) // total) for name, a, b in zip(names, edges, edges[1:])}
    facts = F.broadcast(spark.createDataFrame([(s, used[s][2], float(used[s][3]), used[s][1], math.ceil(used[s][3] / used[s][2]), blocks[s]) for s in names], "source string, _have long, _quota double, _repeats int, _passes int, _blocks long"))
    placed = prefix_sum(counts, ["source"], F.xxhash64("doc_id", F.lit(seed)), "doc_id", "n_tokens", "_at").join(facts, "source")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.least("_passes", "_repeats") - 1))).withColumn("_at", F.col("copy") * F.col("_have") + F.col("_at")).filter(F.col("_at") < F.col("_quota"))
    placed = placed.withColumn("_block", F.least(F.floor(F.col("_at") / block_tokens), F.col("_blocks") - 1))
    return placed.select(_slots(parts)("source", F.col("_block").cast("long")).alias("slot"), F.col("_at").alias("place"), "doc_id", "copy", "source", "n_tokens")


def shares(documents: DataFrame, targets: DataFrame, **options) -> DataFrame:
    """``source, target_share, actual_share, tokens_there, tokens_used, documents_used, most_repeats`` of each target."""
    counts = materialize(token_counts(documents, options.pop("tokenizer", TOKENIZER)), "tokens")
    plan = _plan(counts, targets, options.pop("total_tokens", None))
    mixed = _schedule(counts, plan, options.pop("block_tokens", 8192), options.pop("seed", 7))
    used = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), F.countDistinct("doc_id").alias("documents_used"), (F.max("copy") + 1).cast("int").alias("most_repeats"))
    facts = counts.sparkSession.createDataFrame([(s, w, n) for s, (w, _, n, _) in sorted(plan.items())], "source string, target_share double, tokens_there long")
    rows = facts.join(used, "source", "left").na.fill(0, ["tokens_used", "documents_used", "most_repeats"])
    rows = rows.withColumn("_total", F.sum("tokens_used").over(W.partitionBy()))  # one row for each source
    return rows.select("source", "target_share", F.coalesce(F.try_divide(F.col("tokens_used"), F.col("_total")), F.lit(0.0)).alias("actual_share"), "tokens_there", "tokens_used", "documents_used", "most_repeats")
