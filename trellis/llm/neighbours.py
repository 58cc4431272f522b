"""Most similar vectors for every vector.

Method: cross-polytope hashing.  Three rounds of random signs and a fast Hadamard transform rotate the unit vectors; a hash
is the nearest signed axis, and ``hashes`` of them make the code of one table.  Each vector is entered in each of
``tables`` tables under its own code and under the ``probes`` codes next to it, ranked by how much projection they lose, as
long as they lose less than ``probe_gap`` (multiprobe).  Vectors that share a code are compared in blocks by their 8-bit
form, whose error is bounded for each pair; what may be among the ``k`` best of either side within a code, and may reach
``min_cosine``, goes on to exact reranking with the full vectors.

Exact copies are one class while hashing; its members come back at the end.  A code held by more than ``cap`` entries is
dealt out as pairs of blocks over many tasks, so nothing is dropped and no task holds an unbounded group.  ``settings``
takes more hashes for more vectors, so that groups stay comparable.

``exhaustive`` compares all classes in pairs of blocks instead and is exact.  Its work grows with the square of the
classes, its disk with their number times that of the blocks.

Defined results: a vector that is null, of another length than ``dim``, with an element that is null or not finite, or
all zero, takes no part.  Ties in the cosine count as equally near, save that of more than k + 1 exact copies the k + 1
smallest ids stand for all.  Repeated rows (same id) count once.  No usable row, no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.session import materialize

SEED = 20_240_601
#: Entries of one code that one task compares with one another.
CAP = 8192
#: Heavy codes that are broadcast at most; beyond that they are joined by a shuffle.
HOT_LIMIT = 200_000
#: Classes of one block where all are compared.
BLOCK = 32_768
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _hadamard(size: int) -> np.ndarray:
    h = np.ones((1, 1), "f4")
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(size)).astype("f4")


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """A pseudo-random rotation of the rows: three rounds of random signs and a fast Hadamard transform.

    The transform of ``a * b`` numbers is one of ``b`` along the rows of an a x b square and one of ``a`` along its
    columns; it leaves the square turned, which the next signs do not mind.
    """
    size = signs.shape[1]
    a = 1 << ((size.bit_length() - 1) // 2)
    one, two = _hadamard(size // a), _hadamard(a)
    if x.shape[1] < size:
        x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    for s in signs:
        x = (x * s).reshape(-1, size // a) @ one
        x = x.reshape(-1, a, size // a).transpose(0, 2, 1).reshape(-1, a) @ two
        x = x.reshape(-1, size)
    return x


def signs_of(dim: int, count: int, seed: int = SEED) -> np.ndarray:
    size = 1 << max(0, dim - 1).bit_length()
    return np.random.default_rng(seed).choice(np.array([-1.0, 1.0], "f4"), (count, 3, size))


def codes(unit: np.ndarray, signs: np.ndarray, tables: int, hashes: int, probes: int, gap: float) -> np.ndarray:
    """Codes ``(rows, tables, 1 + probes)``: the own one, then the nearest others by the loss of projection, -1 beyond ``gap``."""
    n, size, want = len(unit), signs.shape[2], 1 + probes
    depth = min(want, 2 * size)
    # other choices for each hash; one that is worse in every hash than ``want`` others cannot be among the best
    ranks = [c for c in product(range(depth), repeat=hashes) if np.prod([r + 1 for r in c]) <= want]
    out = np.full((n, tables, want), -1, "i8")
    for t in range(tables):
        axes, losses = [], []
        for h in range(hashes):
            y = rotate(unit, signs[t * hashes + h])
            y = np.concatenate([y, -y], axis=1)
            top = np.argpartition(-y, min(depth, y.shape[1] - 1), axis=1)[:, :depth]
            val = np.take_along_axis(y, top, 1)
            order = np.argsort(-val, axis=1, kind="stable")
            axes.append(np.take_along_axis(top, order, 1))
            val = np.take_along_axis(val, order, 1)
            losses.append(val[:, :1] - val)
        loss = np.stack([sum(losses[h][:, c[h]] for h in range(hashes)) for c in ranks], 1)
        code = np.full((n, len(ranks)), t, "i8")
        for h in range(hashes):
            code = code * (2 * size) + axes[h][:, [c[h] for c in ranks]]
        best = np.argsort(loss, axis=1, kind="stable")[:, :want]
        found = np.take_along_axis(code, best, 1)
        found[(np.take_along_axis(loss, best, 1) >= gap) & (np.arange(found.shape[1]) > 0)] = -1
        out[:, t, : found.shape[1]] = found
    return out


def _binary(column: pa.Array, width: int) -> np.ndarray:
    column = column.cast(pa.binary()) if not pa.types.is_binary(column.type) else column
    at = np.frombuffer(column.buffers()[1], "i4")[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.int8)[at[0] : at[-1]].reshape(-1, width) if len(column) else np.empty((0, width), np.int8)


def _hash(dim: int, tables: int, hashes: int, probes: int, gap: float, seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signs = signs_of(dim, tables * hashes, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
            x = batch.column(2).flatten().to_numpy().reshape(-1, dim).astype("f8")
            unit = x / np.abs(x).max(1, keepdims=True)
            unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype("f4")
            found = codes(unit, signs, tables, hashes, probes, gap)
            found[~asks, :, 1:] = -1  # rows that only are found have their own codes
            step = np.abs(unit).max(1) / 127
            small = np.rint(unit / step[:, None]).astype(np.int8)
            at, t, p = np.nonzero(found >= 0)
            for a in range(0, len(at), 100_000):
                i, code = at[a : a + 100_000], found[at, t, p][a : a + 100_000]
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim), len(i), [None, pa.py_buffer(np.ascontiguousarray(small[i]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(h1[i]), pa.array(h2[i]), pa.array(step[i].astype("f4")), pa.array(asks[i]), data], names=["code", "h1", "h2", "step", "asks", "small"])

    return run


def _pairs_of(v: np.ndarray, step: np.ndarray, block: np.ndarray, cell: np.ndarray, cls: np.ndarray, asks: np.ndarray, k: int, least: float) -> np.ndarray:
    """Index pairs of one group that may be among the k best of a row that asks, and reach ``least``."""
    n, out, rows = len(v), [np.empty((0, 2), "i8")], np.flatnonzero(asks)
    for a in range(0, len(rows), 512):
        r = rows[a : a + 512]
        sims = v[r] @ v.T
        err = np.sqrt(v.shape[1]) * 0.53 * (step[r, None] + step[None])
        bad = (cls[r, None] == cls[None]) | ((block[r, None] == block[None]) & (cell[r, None] < 0))
        sims[bad] = -9
        keep = sims + err >= least
        if n > k:
            low = sims - err
            low[bad] = -9
            keep &= sims + err >= np.partition(low, n - k, axis=1)[:, n - k, None]
        i, j = np.nonzero(keep & ~bad)
        out.append(np.stack([r[i], j], 1))
    return np.concatenate(out)


def _compare(dim: int, k: int, least: float, small_group: int = 24) -> Callable:
    names = ["a1", "a2", "b1", "b2"]

    def work(cols: list[np.ndarray], data: np.ndarray) -> Iterator[pa.RecordBatch]:
        code, cell, block, h1, h2, step, asks = cols
        n = len(code)
        if n < 2:
            return
        v = data.astype("f4") * step[:, None]
        cls = (h1.astype("u8") * _MIX) ^ h2.astype("u8")
        start = np.flatnonzero(np.concatenate(([True], (code[1:] != code[:-1]) | (cell[1:] != cell[:-1]))))
        end = np.append(start[1:], n)
        size = np.repeat(end - start, end - start)
        found = []
        for s in range(1, small_group):
            i = np.flatnonzero((size[:-s] > s) & (size[:-s] <= small_group) & (code[:-s] == code[s:]) & (cell[:-s] == cell[s:])) if n > s else np.empty(0, int)
            if not len(i):
                if s > 1:
                    break
                continue
            j = i + s
            ok = (cls[i] != cls[j]) & (asks[i] | asks[j]) & ~((block[i] == block[j]) & (cell[i] < 0))
            i, j = i[ok], j[ok]
            sims = np.einsum("ij,ij->i", v[i], v[j]) + np.sqrt(dim) * 0.53 * (step[i] + step[j])
            ok = sims >= least
            found.append(np.stack([i[ok], j[ok]], 1))
        for a, b in zip(start, end):
            if b - a > small_group:
                found.append(_pairs_of(v[a:b], step[a:b], block[a:b], cell[a:b], cls[a:b], asks[a:b], k, least) + a)
        if not found:
            return
        p = np.concatenate(found)
        swap = (h1[p[:, 0]] > h1[p[:, 1]]) | ((h1[p[:, 0]] == h1[p[:, 1]]) & (h2[p[:, 0]] > h2[p[:, 1]]))
        i, j = np.where(swap, p[:, 1], p[:, 0]), np.where(swap, p[:, 0], p[:, 1])
        at = np.unique((cls[i] * _MIX) ^ (cls[j] + np.uint64(1)), return_index=True)[1]
        i, j = i[at], j[at]
        for a in range(0, len(i), 50_000):
            x, y = i[a : a + 50_000], j[a : a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h1[x], h2[x], h1[y], h2[y])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[np.ndarray], np.ndarray]] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(7)]
            held.append((cols, _binary(batch.column(7), dim)))
            rows += batch.num_rows
            if rows < 60_000:
                continue
            cols = [np.concatenate([h[0][i] for h in held]) for i in range(7)]
            data = np.concatenate([h[1] for h in held])
            last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            split = int(np.argmax(last))
            if split:
                yield from work([c[:split] for c in cols], data[:split])
            held, rows = [([c[split:] for c in cols], data[split:])], len(data) - split
        if held:
            yield from work([np.concatenate([h[0][i] for h in held]) for i in range(7)], np.concatenate([h[1] for h in held]))

    return run


def _nearest(x: np.ndarray, y: np.ndarray, at: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of y and cosine: the k nearest of y and their ties for each row of x; ``at``: its own row in y."""
    norm = lambda z: (z / np.linalg.norm(z, axis=1, keepdims=True)).astype("f4")
    big_x, big_y = (z / np.abs(z).max(1, keepdims=True) for z in (x, y))
    few_x, few_y, n = norm(big_x), norm(big_y).T.copy(), len(y)
    groups = min(n, max(256, 8 * k))
    whole = n // groups * groups
    out = [(np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0))]
    for a in range(0, len(x), 256):
        sims = few_x[a : a + 256] @ few_y
        rows = np.arange(len(sims))
        if at is not None:
            sims[rows, at[a : a + 256]] = -9
        least = np.full(len(sims), -2.0, "f4")
        if groups > k:  # the k-th best maximum of the groups is not above the k-th best row
            best = sims[:, :whole].reshape(len(sims), -1, groups).max(1)
            least = np.maximum(least, np.partition(best, groups - k, axis=1)[:, groups - k] - np.float32(1e-5))
        i, j = np.divmod(np.flatnonzero(sims >= least[:, None]), n)
        u, v = x[a + i], y[j]
        dot = lambda p, q: np.einsum("ij,ij->i", p, q)
        cosine = dot(u, v) / np.sqrt(dot(u, u) * dot(v, v))
        order = np.lexsort((-cosine, i))
        i, j, cosine = i[order], j[order], cosine[order]
        end = np.searchsorted(i, rows, "right")
        kth = cosine[np.minimum(np.searchsorted(i, rows) + k, end) - 1] if len(i) else np.empty(0)
        keep = cosine >= kth[i] - 1e-12
        out.append((i[keep] + a, j[keep], cosine[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _all_pairs(dim: int, k: int) -> Callable:
    names = ["h1", "h2", "o1", "o2", "cosine"]

    def work(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        _, low, block, asks, h1, h2, v = rows
        one = block == low
        sides = [np.flatnonzero(one), np.flatnonzero(~one)]
        for a, b in [(0, 1), (1, 0)] if len(sides[1]) else [(0, 0)]:
            mine, other = sides[a][asks[sides[a]]], sides[b]
            if not len(mine) or not len(other):
                continue
            i, j, cosine = _nearest(v[mine], v[other], np.searchsorted(other, mine) if a == b else None, k)
            i, j = mine[i], other[j]
            for s in range(0, len(i), 50_000):
                x, y = i[s : s + 50_000], j[s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h1[x], h2[x], h1[y], h2[y], cosine[s : s + 50_000])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        join = lambda: [np.concatenate(c) for c in zip(*held)]
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(6)]
            v = batch.column(6).flatten().to_numpy().reshape(-1, dim).astype("f8")
            cuts = [0, *(np.flatnonzero(np.diff(cols[0])) + 1), len(v)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and held[-1][0][0] != cols[0][a]:
                        yield from work(join())
                        held = []
                    held.append([*(c[a:b] for c in cols), v[a:b]])
        if held:
            yield from work(join())

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim: int, queries: str | None = None) -> DataFrame:
    """``id, h1, h2, v, asks``: the rows that take part, with two hashes that stand for equal vectors."""
    v = F.col(vector_col)
    fine = (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(v.isNotNull() & F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast("float")).alias("v"), F.coalesce(F.expr(queries or "true"), F.lit(False)).alias("asks"))
    return rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(SEED), F.lit("again"), "v").alias("h2"), "v", "asks")


def _every(classes: DataFrame, dim: int, k: int, block: int) -> DataFrame:
    """``h1, h2, ids, cosine``: the k nearest classes within each block, for classes that ask."""
    m = max(1, -(-classes.count() // block))
    rows = classes.select("h1", "h2", "v", F.coalesce("asks", F.lit(False)).alias("asks"), F.pmod("h1", F.lit(m)).alias("block"))
    rows = rows.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))).withColumn("low", F.least("block", "j")).withColumn("cell", F.col("low") * m + F.greatest("block", "j"))
    rows = rows.select("cell", "low", "block", "asks", "h1", "h2", "v").repartition(m * (m + 1) // 2, "cell").sortWithinPartitions("cell")
    near = rows.mapInArrow(_all_pairs(dim, k), "h1 long, h2 long, o1 long, o2 long, cosine double")
    near = near.withColumn("_n", F.rank().over(W.partitionBy("h1", "h2").orderBy(F.desc("cosine")))).filter(F.col("_n") <= k).drop("_n")
    return near.join(classes.select(F.col("h1").alias("o1"), F.col("h2").alias("o2"), "ids"), ["o1", "o2"]).select("h1", "h2", "ids", "cosine")


def _hashed(classes: DataFrame, dim: int, k: int, min_cosine: float, tables: int, hashes: int, probes: int, probe_gap: float, cap: int, seed: int, queries: str | None) -> DataFrame:
    """``h1, h2, ids, cosine``: classes that share a code, both ways."""
    entries = classes.select("h1", "h2", "v", "asks").mapInArrow(_hash(dim, tables, hashes, probes, probe_gap, seed), "code long, h1 long, h2 long, step float, asks boolean, small binary")
    heavy = materialize(entries.groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap), "heavy")
    n_heavy = heavy.count()
    if n_heavy:
        heavy = heavy.select("code", F.ceil(F.col("n") / cap).cast("int").alias("_m"))
        entries = entries.join(F.broadcast(heavy) if n_heavy <= HOT_LIMIT else heavy, "code", "left").withColumn("block", F.pmod("h1", F.coalesce("_m", F.lit(1))).cast("int"))
        # cell i * m + j holds blocks i <= j; where they differ it is numbered below zero and compares across only
        cell = lambda j: F.when(F.col("block") == j, F.col("block") * F.col("_m") + j).otherwise(-1 - (F.least("block", j) * F.col("_m") + F.greatest("block", j)))
        every = F.sequence(F.lit(0), F.coalesce("_m", F.lit(1)) - 1)
        # where few ask, those go to all blocks and the others to their own
        cells = F.transform(every, cell) if queries is None else F.when(F.col("asks"), every).otherwise(F.array("block"))
        cells = F.when(F.col("_m").isNull(), F.array(F.lit(0))).otherwise(cells)
        entries = entries.withColumn("cell", F.explode(cells))
    else:
        entries = entries.withColumn("block", F.lit(0)).withColumn("cell", F.lit(0))
    entries = entries.select("code", "cell", "block", "h1", "h2", "step", "asks", "small")
    pairs = entries.repartition("code", "cell").sortWithinPartitions("code", "cell").mapInArrow(_compare(dim, k, min_cosine), "a1 long, a2 long, b1 long, b2 long").distinct()
    a, b = (classes.select(*[F.col(c).alias(f"{s}{c[1:]}") for c in ("h1", "h2")], F.col("ids").alias(f"{s}_ids"), F.col("v").alias(f"{s}_v")) for s in "ab")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    scored = pairs.join(a, ["a1", "a2"]).join(b, ["b1", "b2"])
    scored = scored.withColumn("cosine", dot("a_v", "b_v") / F.sqrt(dot("a_v", "a_v") * dot("b_v", "b_v"))).filter(F.col("cosine") >= min_cosine)
    there = scored.select(F.col("a1").alias("h1"), F.col("a2").alias("h2"), F.col("b_ids").alias("ids"), "cosine")
    back = scored.select(F.col("b1").alias("h1"), F.col("b2").alias("h2"), F.col("a_ids").alias("ids"), "cosine")
    return there.unionByName(back)


def similar_vectors(
    vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", dim: int = 64, k: int = 5, min_cosine: float = -1.0,
    tables: int | None = None, hashes: int | None = None, probes: int | None = None, probe_gap: float | None = None, cap: int = CAP, seed: int = SEED, queries: str | None = None,
    exhaustive: bool = False, block: int = BLOCK,
) -> DataFrame:
    """``id, other_id, cosine, rank``: for each usable row those of its ``k`` most similar rows with at least ``min_cosine``.

    ``queries`` is a condition on ``vectors``: only rows that meet it ask, against all rows.  Tables, hashes and probes
    are those of ``settings`` where they are not given.  ``exhaustive`` compares all with all in blocks of about ``block`` different vectors and is exact.
    """
    base = usable(vectors, id_col, vector_col, dim, queries)
    # copies: one vector for each class, and its k + 1 smallest ids (a limit that the plan applies before the shuffle)
    vector = base.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.max("asks").alias("asks"))
    few = base.select("h1", "h2", "id").distinct().withColumn("_n", F.row_number().over(W.partitionBy("h1", "h2").orderBy("id"))).filter(F.col("_n") <= k + 1)
    # dealt by (h1, h2) from here on, for the hashing as for both sides of the reranking
    classes = vector.join(few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("id")).alias("ids")), ["h1", "h2"])
    if exhaustive:
        classes = materialize(classes, "classes")
        near = _every(classes, dim, k, block).filter(F.col("cosine") >= min_cosine)
    else:
        chosen = settings(lambda: base.select("h1", "h2").distinct().count(), min_cosine) | {name: x for name, x in (("tables", tables), ("hashes", hashes), ("probes", probes), ("probe_gap", probe_gap)) if x is not None}
        near = _hashed(classes, dim, k, min_cosine, **chosen, cap=cap, seed=seed, queries=queries)
    near = near.withColumn("_n", F.rank().over(W.partitionBy("h1", "h2").orderBy(F.desc("cosine")))).filter(F.col("_n") <= k).drop("_n")
    itself = classes.filter(F.size("ids") > 1).select("h1", "h2", "ids", F.lit(1.0).alias("cosine"))
    near = near.unionByName(itself if min_cosine <= 1 else itself.limit(0))
    own = base.filter("asks").select("id", "h1", "h2").distinct()
    rows = own.join(near, ["h1", "h2"]).select("id", F.explode("ids").alias("other_id"), "cosine").filter("id != other_id")
    return rows.withColumn("rank", F.rank().over(W.partitionBy("id").orderBy(F.desc("cosine")))).filter(F.col("rank") <= k)


def settings(n: int | Callable[[], int], least: float = -1.0) -> dict:
    """Tables, hashes and probes for ``n`` different vectors (counted if need be) and neighbours of at least the cosine ``least``.

    Near neighbours share several hashes, so three of them keep groups small.  Where neighbours may be at any cosine, one
    hash serves as long as its groups of about n / 40 can be compared; beyond a million, two with more probes.
    """
    if least >= 0.85:
        return {"tables": 8, "hashes": 3, "probes": 1, "probe_gap": 0.02}
    n = n() if callable(n) else n
    return {"tables": 8, "hashes": 1, "probes": 1, "probe_gap": 9.0} if n <= 1 << 20 else {"tables": 12, "hashes": 2, "probes": 7, "probe_gap": 9.0}


def similar_pairs(neighbours: DataFrame) -> DataFrame:
    """``id_a < id_b, cosine``: each pair once."""
    return neighbours.groupBy(F.least("id", "other_id").alias("id_a"), F.greatest("id", "other_id").alias("id_b")).agg(F.max("cosine").alias("cosine"))
