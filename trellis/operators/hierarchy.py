"""Parent-child links to full hierarchies.

Method: fragments.  Links are dealt to bounded partitions, ``LEAST`` to ``MOST`` links each; inside each one every parent
chain is contracted to its exit, the first ancestor whose own link is held elsewhere.  Only exits that have a link
themselves form the next, smaller quotient forest, which is solved the same way until one small fragment holds it.  Solutions then expand level by
level.  A loop shows up either inside a fragment (local) or in a quotient (global).

The first level deals by ranges of the id, since ids made together tend to be linked.  Later levels deal by hash, but
put the only child of a parent beside it when two coins say so: leaves and a quarter of the single-child nodes vanish
at each level in expectation, whatever the ids look like, so the number of levels is logarithmic.

Defined results: null ends are dropped; repeated links count once; of two parents the smaller id holds; a node on or
below a loop has depth -1, the smallest id of the loop as root and no path; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.order import numbered
from trellis.session import discard, materialize

#: Links of one fragment: at least, and at most (about 40 bytes each); between them, fragments for ``TASKS`` tasks.
LEAST, MOST, TASKS = 1 << 13, 1 << 20, 2000


def _fragment(child: np.ndarray, parent: np.ndarray, weight: np.ndarray, low: np.ndarray):
    """Index of the last local node of each chain, exit, distance, smallest id up to the exit, loop id or -1 (as mask)."""
    n = len(child)
    at = np.searchsorted(child, parent)
    at[at == n] = 0
    local = child[at] == parent
    jump = np.where(local, at, np.arange(n))
    dist, least = np.where(local, weight, 0), low.copy()
    for _ in range(max(1, int(n).bit_length()) + 1):
        dist, least, jump = dist + dist[jump], np.minimum(least, least[jump]), jump[jump]
    looped = local[jump]
    loop = least[jump]  # after n steps the jump stands on the loop, and its own walk went all the way round
    return jump, parent[jump], dist + weight[jump], np.minimum(least, low[jump]), looped, loop


def _contract(paths: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True).sort_values("child", ignore_index=True)
        child, parent = rows.child.to_numpy(), rows.parent.to_numpy()
        last, exit_, dist, least, looped, loop = _fragment(child, parent, rows.weight.to_numpy(), rows.low.to_numpy())
        out = pd.DataFrame({"child": child, "exit": exit_, "dist": dist, "low": least, "loop": pd.array(np.where(looped, loop, 0), dtype="Int64")})
        out.loc[~looped, "loop"] = pd.NA
        if not paths:
            yield out
            return
        at = np.searchsorted(child, parent)
        at[at == len(child)] = 0
        up = np.where(child[at] == parent, at, -1)
        own = rows.seg.to_list()
        for a in range(0, len(out), 4096):
            part = out.iloc[a : a + 4096].copy()
            segs = []
            for i in range(a, a + len(part)):
                chain = []
                if not looped[i]:
                    j = i
                    while j >= 0:
                        chain.append(own[j])
                        j = up[j]
                segs.append(np.concatenate(chain[::-1]) if chain else np.empty(0, "int64"))
            part["seg"] = segs
            yield part

    return run


def _deal(links: DataFrame, level: int, parts: int) -> DataFrame:
    if parts == 1:
        return links.repartition(1)
    if level == 0:
        return links.repartitionByRange(parts, "child")
    coin = lambda c: F.xxhash64(F.col(c), F.lit(level)).bitwiseAND(F.lit(1)) == 1
    only = links.groupBy("parent").agg(F.count(F.lit(1)).alias("_n")).filter("_n = 1").select("parent", F.lit(True).alias("_only"))
    beside = F.col("_only").isNotNull() & ~coin("child") & coin("parent")
    return (
        links.join(only, "parent", "left")
        .withColumn("_key", F.when(beside, F.col("parent")).otherwise(F.col("child")))
        .repartition(parts, "_key")
        .drop("_key", "_only")
    )


def hierarchy(links: DataFrame, child: str = "child", parent: str = "parent", paths: bool = False, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row ``(node, root, depth[, path])`` for each id that is an end of a link.

    ``path`` is the array of ids from the root to the node.  A fragment holds about ``least`` to ``most`` links.
    """
    pairs = links.select(F.col(child).cast("long").alias("child"), F.col(parent).cast("long").alias("parent")).dropna()
    level_links = pairs.groupBy("child").agg(F.min("parent").alias("parent")).select("child", "parent", F.lit(1).cast("long").alias("weight"), F.col("child").alias("low"))
    if paths:
        level_links = level_links.withColumn("seg", F.array("child"))
    level_links = materialize(level_links, "links")
    schema = "child long, exit long, dist long, low long, loop long" + ", seg array<long>" * paths
    levels: list[DataFrame] = []
    n = level_links.count()
    while True:
        parts = max(1, -(-n // most), min(-(-n // least), TASKS))
        done = materialize(_deal(level_links, len(levels), parts).mapInPandas(_contract(paths), schema), f"fragments{len(levels)}")
        discard(level_links)
        levels.append(done)
        if parts == 1:
            break
        exits = done.filter("loop is null").select(F.col("exit").alias("child")).distinct()
        # an exit on or below a local loop goes on as a loop of one that carries the loop's id
        level_links = done.join(exits, "child", "left_semi").select(
            "child",
            F.when(F.col("loop").isNull(), F.col("exit")).otherwise(F.col("child")).alias("parent"),
            F.when(F.col("loop").isNull(), F.col("dist")).otherwise(0).cast("long").alias("weight"),
            F.coalesce("loop", "low").alias("low"),
            *["seg"] * paths,
        )
        level_links = materialize(level_links, f"quotient{len(levels)}")
        n = level_links.count()
        if n == 0:
            break
    solved = None
    for done in reversed(levels):
        own = [F.col("loop"), F.col("exit"), F.col("dist")]
        if solved is None:
            root, depth, path = F.coalesce(own[0], own[1]), F.when(own[0].isNotNull(), -1).otherwise(own[2]), F.concat(F.array("exit"), "seg") if paths else None
            rows = done
        else:
            known = solved.select(F.col("node").alias("_node"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), *[F.col("path").alias("_path")] * paths)
            rows = done.join(known, (F.col("exit") == F.col("_node")) & F.col("loop").isNull(), "left")
            root = F.coalesce("loop", "_root", "exit")
            depth = F.when(F.col("loop").isNotNull() | (F.col("_depth") < 0), -1).otherwise(F.col("dist") + F.coalesce("_depth", F.lit(0)))
            path = F.concat(F.coalesce("_path", F.array("exit")), "seg") if paths else None
        rows = rows.select(F.col("child").alias("node"), root.alias("root"), depth.cast("long").alias("depth"), *([path.alias("path")] if paths else []))
        if paths:
            rows = rows.withColumn("path", F.when(F.col("depth") >= 0, F.col("path")))
        solved = rows
    tops = levels[0].filter("loop is null").select(F.col("exit").alias("node")).distinct().join(levels[0].select(F.col("child").alias("node")), "node", "left_anti")
    tops = tops.select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("depth"), *[F.array("node").alias("path")] * paths)
    return solved.unionByName(tops)


def descendants(paths: DataFrame) -> DataFrame:
    """``(ancestor, descendant, distance)`` for each node and each of its ancestors, from ``hierarchy(..., paths=True)``."""
    spread = paths.filter("depth > 0").select(F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("pos", "ancestor"))
    return spread.filter("pos < depth").select("ancestor", "descendant", (F.col("depth") - F.col("pos")).cast("long").alias("distance"))


def intervals(paths: DataFrame) -> DataFrame:
    """``(node, root, depth, first, last)``: the descendants of a node are those whose ``first`` lies in (first, last] of it.

    Takes ``hierarchy(..., paths=True)``; nodes on or below a loop are left out.  One row for each node, however many
    pairs of ancestor and descendant there are: beginnings and ends of subtrees are sorted together by their paths, and
    counted beginnings are the numbers.
    """
    trees = paths.filter("depth >= 0").select("node", "root", "depth", "path")
    ends = trees.select("node", "root", "depth", F.concat("path", F.array(F.lit((1 << 63) - 1).cast("long"))).alias("path"), F.lit(0).alias("_begins"))
    both = trees.withColumn("_begins", F.lit(1)).unionByName(ends)
    placed = numbered(both, ["root", "path", "node"], "_at", weight=F.col("_begins")).select("node", "root", "depth", "_begins", "_at")
    return placed.groupBy("node", "root", "depth").agg(F.max(F.when(F.col("_begins") == 1, F.col("_at"))).alias("first"), (F.max(F.when(F.col("_begins") == 0, F.col("_at"))) - 1).alias("last"))
