"""Splitting oversized items at natural boundaries.

Method: byte ranges.  Every text is dealt out in ranges of ``range_bytes``, each with a halo on its left, and the ranges of
one item go to different tasks.  A worker finds the natural boundaries in its range by looking at bytes only.  The border
between two ranges is the best boundary in the halo before it, which both neighbours compute alike from the same bytes;
the boundary tables are thereby stitched.  Between two borders a worker cuts greedily and gives pieces by offset.  A prefix
sum of the counts of pieces numbers them within the item.

``split_items`` takes texts in rows, which a task must hold once to deal them out; ``split_files`` takes files, of which no
worker reads more than its range and halo.

A boundary is, best first: after a blank line, after a line, after a sentence, after a blank, between two characters.

Defined results: a null or short text has no pieces; offsets are bytes of the UTF-8 form; the pieces of an item without
their overlaps are the whole text; repeated rows count once; different texts under one key are cut each for itself; text
without any boundary is cut between characters; a line of up to ``CONTEXT / 2`` blanks is a blank line; bytes of a file that
are no UTF-8 come out as replacement characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.session import materialize

#: Bytes of a range of a text, of a range of a file, and those looked at before them besides the halo to recognise a boundary.
RANGE_BYTES, FILE_RANGE_BYTES = 1 << 13, 1 << 24
CONTEXT = 512

_BLANK = np.zeros(256, bool)
_BLANK[[9, 32, 13]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSE = np.zeros(256, bool)
_CLOSE[[ord(c) for c in "\"')]*_`"]] = True


def ranks(data: bytes) -> np.ndarray:
    """Rank of a cut before each byte and at the end: 4 block, 3 line, 2 sentence, 1 word, 0 character, -1 none."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    out = np.zeros(n + 1, np.int8)
    out[:n][(b & 0xC0) == 0x80] = -1
    space = _BLANK[b] | (b == 10)
    after = np.flatnonzero(space) + 1
    out[after] = 1
    one, two = np.roll(b, 1), np.roll(b, 2)
    stop = _STOP[one] | (_CLOSE[one] & _STOP[two])
    stop[:2] = False
    out[np.flatnonzero(space & stop) + 1] = 2
    lines = np.flatnonzero(b == 10)
    out[lines + 1] = 3
    if len(lines) > 1:
        filled = np.concatenate(([0], np.cumsum(~_BLANK[b])))
        gap = lines[1:] - lines[:-1]
        empty = (filled[lines[1:]] == filled[lines[:-1] + 1]) & (gap <= CONTEXT // 2)
        out[lines[1:][empty] + 1] = 4
    return out


def _best(rank: np.ndarray, low: int, high: int) -> int:
    """Last of the best ranked cuts in [low, high]."""
    part = rank[low : high + 1][::-1]
    return high - int(part.argmax())


def cut(data: bytes, start: int, total: int, index: int, size: int, limit: int, overlap: int) -> list[int]:
    """Flat triples (start, first new byte, end) of the pieces of range ``index``; ``data`` begins at byte ``start``."""
    rank = ranks(data)
    halo = limit // 2

    def border(at: int) -> int:
        if at <= 0 or at >= total:
            return max(0, min(at, total))
        return start + _best(rank, at - halo - start, at - start)

    new, end = border(index * size), border(min(total, (index + 1) * size))
    out: list[int] = []
    while new < end:
        first = new
        if new > 0 and overlap:
            first = start + _best(np.minimum(rank, 1), max(0, new - overlap - overlap // 4 - start), max(0, new - overlap + overlap // 4 - start))
        stop = end
        if end - first > limit:
            stop = start + _best(rank, max(first + limit // 2, new + 1) - start, first + limit - start)
            if stop <= new:
                stop = first + limit
        out += (first, new, stop)
        new = stop
    return out


def _cutter(size: int, limit: int, overlap: int) -> Callable:
    @F.pandas_udf("array<long>")
    def run(data: pd.Series, start: pd.Series, total: pd.Series, index: pd.Series) -> pd.Series:
        return pd.Series([np.array(cut(d, s, t, i, size, limit, overlap), "int64") for d, s, t, i in zip(data, start, total, index)])

    return run


def _checked(limit: int, overlap: int, range_bytes: int) -> int:
    if not (limit >= 16 and 0 <= overlap <= limit // 4 and range_bytes >= 2 * limit):
        raise ValueError("needs limit >= 16, overlap <= limit / 4, range_bytes >= 2 * limit")
    return limit // 2 + overlap + overlap // 4 + CONTEXT


def _numbered(pieces: DataFrame, unit: list[str]) -> DataFrame:
    """``piece_no`` within the item, from the number ``_k`` of a piece within its range."""
    pieces = materialize(pieces, "pieces")
    counts = pieces.groupBy(*unit, "_range").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*unit).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"c.{c}")) for c in [*unit, "_range"]]
    return pieces.alias("p").join(counts.alias("c"), same).select("p.*", (F.col("p._k") + F.col("c._before") + 1).cast("long").alias("piece_no"))


def split_items(items: DataFrame, keys: list[str], text: str, limit: int = 2000, overlap: int = 200, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``keys, piece_no, start_byte, new_byte, end_byte, piece`` for each item of more than ``limit`` bytes.

    A piece is bytes [start_byte, end_byte); those before new_byte repeat the end of the piece before it.
    """
    back = _checked(limit, overlap, range_bytes)
    long_ = items.filter(F.octet_length(text) > limit).select(*keys, F.col(text).cast("binary").alias("_all"), F.octet_length(text).cast("long").alias("_total"))
    unit = [*keys, "_id", "_total"]
    part = long_.withColumn("_id", F.xxhash64("_all")).withColumn("_range", F.explode(F.expr(f"sequence(0L, (_total - 1) div {range_bytes}L)"))).withColumn("_from", F.greatest(F.lit(0), F.col("_range") * range_bytes - back))
    part = part.select(*unit, "_range", "_from", F.expr(f"substring(_all, int(_from + 1), int((_range + 1) * {range_bytes}L - _from + 1))").alias("_data"))
    part = part.dropDuplicates([*unit, "_range"])  # deals the ranges out, too
    part = part.withColumn("_flat", _cutter(range_bytes, limit, overlap)("_data", "_from", "_total", "_range")).filter(F.size("_flat") > 0)
    part = part.withColumn("_k", F.explode(F.expr("sequence(0, int(size(_flat) / 3) - 1)")))
    at = lambda j: F.expr(f"_flat[_k * 3 + {j}]")
    pieces = part.select(
        *unit, "_range", "_k", at(0).alias("start_byte"), at(1).alias("new_byte"), at(2).alias("end_byte"),
        F.expr("decode(substring(_data, int(_flat[_k * 3] - _from + 1), int(_flat[_k * 3 + 2] - _flat[_k * 3])), 'UTF-8')").alias("piece"),
    )
    return _numbered(pieces, unit).select(*keys, "piece_no", "start_byte", "new_byte", "end_byte", "piece")


def _file_cutter(size: int, limit: int, overlap: int, back: int) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            for path, total, index in zip(batch["path"], batch["_total"], batch["_range"]):
                system, inner = fs.FileSystem.from_uri(path)
                start = max(0, index * size - back)
                with system.open_input_file(inner) as f:
                    data = f.read_at(min((index + 1) * size + 1, total) - start, start)
                flat = cut(data, start, total, index, size, limit, overlap)
                rows = [(path, total, index, k, a, b, c, data[a - start : c - start].decode("utf-8", "replace")) for k, (a, b, c) in enumerate(zip(flat[::3], flat[1::3], flat[2::3]))]
                yield pd.DataFrame(rows, columns=["path", "_total", "_range", "_k", "start_byte", "new_byte", "end_byte", "piece"])

    return run


def split_files(spark: SparkSession, folder: str, limit: int = 2000, overlap: int = 200, range_bytes: int = FILE_RANGE_BYTES) -> DataFrame:
    """``path, piece_no, start_byte, new_byte, end_byte, piece`` for each file of more than ``limit`` bytes below ``folder``.

    Only names and lengths are listed; each range is read by itself at its offset, with its halo.
    """
    back = _checked(limit, overlap, range_bytes)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.col("length").alias("_total")).filter(F.col("_total") > limit)
    part = listed.withColumn("_range", F.explode(F.expr(f"sequence(0L, (_total - 1) div {range_bytes}L)"))).repartition("path", "_range")
    schema = "path string, _total long, _range long, _k int, start_byte long, new_byte long, end_byte long, piece string"
    return _numbered(part.mapInPandas(_file_cutter(range_bytes, limit, overlap, back), schema), ["path"]).select("path", "piece_no", "start_byte", "new_byte", "end_byte", "piece")


def oversized(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the items that were cut."""
    return pieces.select(*keys).distinct()
