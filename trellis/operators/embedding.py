"""Texts to vectors: engines, batches that survive failures, and keeping a table of vectors in step with its texts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Texts of a request; a failed request of more than ``LEAST`` is halved.
BATCH, LEAST = 256, 1


class NotConfigured(Exception):
    """Fails alike at any size: a missing key, a provider that is switched off."""


class Engine(Protocol):
    name: str
    dim: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashEngine:
    """Vectors made from a digest of the text: always the same, and of no meaning.  Stands in where no model is at hand."""

    def __init__(self, dim: int = 64):
        self.name, self.dim = f"hash:{dim}", dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode("utf-8", "replace")).digest()[:8], "little")).normal(size=self.dim).tolist() for t in texts]


class Patience:
    """Ends a run after more failures in a row than halving one request down to the smallest can cause."""

    def __init__(self, batch: int):
        self.failed, self.limit = 0, 2
        while batch > LEAST:
            batch, self.limit = -(-batch // 2), self.limit + 1

    @property
    def over(self) -> bool:
        return self.failed >= self.limit


def embed_texts(engine: Engine, texts: list[str], patience: Patience) -> tuple[list[list[float] | None], str | None]:
    """A vector or None for each text, and the first error.  Failed requests are halved; an answer of another length has failed."""
    out: list[list[float] | None] = [None] * len(texts)
    error, todo = None, [(0, len(texts))]
    while todo and not patience.over:
        a, b = todo.pop()
        if a == b:
            continue
        try:
            got = engine.embed(texts[a:b])
            if len(got) != b - a:
                raise ValueError(f"{b - a} vectors expected, {len(got)} came")
            out[a:b], patience.failed = got, 0
        except Exception as e:  # noqa: BLE001
            error = error or str(e)
            patience.failed = patience.limit if isinstance(e, NotConfigured) else patience.failed + 1
            if b - a > LEAST:
                todo += [((a + b) // 2, b), (a, (a + b) // 2)]
    return out, error


def embedded(rows: DataFrame, engine: Callable[[], Engine], batch: int = BATCH) -> DataFrame:
    """``rows`` with ``embedding`` (null where it failed) and ``error``; an engine is made in each task."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, embedding array<float>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, patience = engine(), Patience(batch)
        for part in batches:
            for a in range(0, len(part), batch):
                some = part.iloc[a : a + batch].copy()
                vectors, error = embed_texts(own, some["text"].fillna("").to_list(), patience)
                some["embedding"] = vectors
                some["error"] = [error if v is None else None for v in vectors]
                yield some

    return rows.mapInPandas(run, schema)


KEY = ["file", "symbol_name", "symbol_kind", "text"]


def sync_plan(wanted: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``wanted`` to embed and ``id`` of the rows of ``stored`` to delete: a difference of multisets by ``KEY``."""
    nth = lambda df, order: df.withColumn("_n", F.row_number().over(W.partitionBy(*KEY).orderBy(order)))
    a, b = nth(wanted, F.lit(0)), nth(stored, "id")
    same = lambda x, y: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in [*KEY, "_n"]]
    return a.alias("a").join(b.alias("b"), same("a", "b"), "left_anti").drop("_n"), b.alias("b").join(a.alias("a"), same("b", "a"), "left_anti").select("id")


def synced(wanted: DataFrame, stored: DataFrame, engine: Callable[[], Engine], model: str | None = None, batch: int = BATCH) -> DataFrame:
    """``KEY, embedding``: the vectors that still hold and new ones.  What failed is left out, so the next run tries it again.

    ``model`` names the engine of ``stored``: another one than now means that none of them holds.
    """
    kept = stored.filter(F.lit(model is None or model == engine().name))
    missing, stale = sync_plan(wanted.select(*KEY), kept)
    new = embedded(missing, engine, batch).filter("embedding is not null")
    return kept.join(stale, "id", "left_anti").select(*KEY, "embedding").unionByName(new.select(*KEY, "embedding"))
