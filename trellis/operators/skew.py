"""Hot keys: counted first, then salted as often as their rows need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import materialize

#: Rows of one key that may go to one task.
HOT = 1 << 20
#: Hot keys that are broadcast at most.
MOST_KEYS = 100_000


def hot_keys(rows: DataFrame, key: str, hot: int = HOT, most: int = MOST_KEYS) -> DataFrame:
    """``key, _salts`` of the keys with more than ``hot`` rows: ceil(rows / hot) salts each, of at most ``most`` keys.

    No table has more than rows / hot such keys.  Where that is above ``most``, the bar is raised to the count of the
    first key left out, so that the result stays small enough to broadcast whatever the size of the table.
    """
    counts = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot)
    counts = materialize(counts, "hot")
    if counts.count() > most:
        bar = counts.orderBy(F.desc("_n")).limit(most + 1).agg(F.min("_n")).first()[0]
        counts = counts.filter(F.col("_n") > bar)
    return counts.select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_salts"))


def salted(many: DataFrame, one: DataFrame, key: str, spread: str, hot: int = HOT, most: int = MOST_KEYS) -> tuple[DataFrame, DataFrame]:
    """Both sides with a column ``_salt``, to be joined on ``key`` and ``_salt``: ``many`` dealt out by a hash of
    ``spread``, the rows of ``one`` repeated for each salt of their key."""
    few = F.broadcast(hot_keys(many, key, hot, most))
    many = many.join(few, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(spread), "_salts"), F.lit(0)).cast("int")).drop("_salts")
    one = one.join(few, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return many, one
