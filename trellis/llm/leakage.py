"""Evaluation texts leaking into training text.

Method: suffix arrays.  Each shard of the corpus (documents of up to ``SHARD_WORDS`` words, at least one) gets a suffix
array over its words, made by prefix doubling.  Every suffix of every test item is then found in it by binary search: the
suffixes that share its first ``min_words`` words form one interval.  Matches that lie one behind the other on the same
shift join to the longest verbatim run, which is given with its place in document and item.

Words are runs of letters and digits in lower case and composed form (NFC); invisible characters (Unicode category Cf)
are left out first, so that they do not part words.  Everything else parts words.

A run that holds a word which no item has cannot be an item's, so only runs of ``min_words`` or more words that items know
go into the array.  Equal windows of many items are searched once.  The test items are held by each task, and by the driver,
in blocks of about ``BLOCK_BYTES`` of text, whose number is counted first; each block is one pass over the corpus.

Defined results: null or empty texts and items of fewer than ``min_words`` words match nothing; repeated rows count once.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.session import materialize

SHARD_WORDS = 1 << 20
BLOCK_BYTES = 32 << 20

_WORD = re.compile(r"[^\W_]+")
#: Unicode category Cf, as far as it can stand in running text.
_INVISIBLE = re.compile("[\u00ad\u0600-\u0605\u061c\u06dd\u070f\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff\ufff9-\ufffb]")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their suffixes, as far as their first ``depth`` elements tell."""
    rank, span = np.unique(text, return_inverse=True)[1].astype("i8") + 1, 1
    while span < depth:
        after = np.zeros_like(rank)
        after[:-span] = rank[span:]
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype("i8") + 1
        span *= 2
    return np.argsort(rank, kind="stable")


def interval(text: np.ndarray, order: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``queries`` the bounds in ``order`` of the suffixes that begin with it.  ``text`` is padded at its end."""
    n, m = queries.shape

    def bound(upper: bool) -> np.ndarray:
        low, high = np.zeros(n, "i8"), np.full(n, len(order), "i8")
        while True:
            open_ = low < high
            if not open_.any():
                return low
            mid = (low + high) // 2
            at = order[np.minimum(mid, len(order) - 1)]
            less, equal = np.zeros(n, bool), np.ones(n, bool)
            for k in range(m):
                c = text[at + k]
                less |= equal & (c < queries[:, k])
                equal &= c == queries[:, k]
            right = open_ & (less | equal if upper else less)
            low, high = np.where(right, mid + 1, low), np.where(open_ & ~right, mid, high)

    return bound(False), bound(True)


class Items:
    """Test items as numbers: the vocabulary, the different windows of ``m`` words, and where each of them stands."""

    def __init__(self, items: list[tuple[int, list[str]]], m: int):
        self.ids = np.array([i for i, _ in items], "i8")
        self.known: dict[str, int] = {}
        windows, at = [np.empty((0, m), "i8")], [np.empty((0, 2), "i8")]
        for i, (_, ws) in enumerate(items):
            codes = np.array([self.known.setdefault(w, len(self.known) + 1) for w in ws], "i8")
            if len(codes) >= m:
                windows.append(np.lib.stride_tricks.sliding_window_view(codes, m))
                at.append(np.stack([np.full(len(codes) - m + 1, i), np.arange(len(codes) - m + 1)], 1))
        self.queries, which = np.unique(np.concatenate(windows), axis=0, return_inverse=True)
        at, which = np.concatenate(at), which.ravel()
        order = np.argsort(which, kind="stable")
        self.places, self.starts = at[order], np.searchsorted(which[order], np.arange(len(self.queries) + 1))


def _open_runs(codes: np.ndarray, m: int) -> np.ndarray:
    """Mask of the words that stand in a run of ``m`` or more known ones."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (codes > 0).view("i1"), [0]))))
    mask = np.zeros(len(codes), bool)
    for a, b in zip(edge[::2], edge[1::2]):
        if b - a >= m:
            mask[a:b] = True
    return mask


def _search(items: list[tuple[int, list[str]]], min_words: int, shard_words: int, most: int = 1 << 21) -> Callable:
    def shard(held: Items, docs: np.ndarray, owner: np.ndarray, word: np.ndarray, text: np.ndarray) -> Iterator[pd.DataFrame]:
        order = suffix_array(text, min_words)
        low, high = interval(np.concatenate([text, np.full(min_words, -2)]), order, held.queries)
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        place = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        by_place = np.argsort(place, kind="stable")
        which, place = which[by_place], place[by_place]
        # one place meets each item position of its window; documents are taken together up to ``most`` of them
        times = held.starts[which + 1] - held.starts[which]
        ends = np.flatnonzero(np.diff(owner[place], append=-1)) + 1 if len(place) else np.empty(0, int)
        start = done = 0
        total = np.concatenate(([0], np.cumsum(times)))
        for e, end in enumerate(ends):
            if total[end] - done < most and e + 1 < len(ends):
                continue
            w, t, p = which[start:end], times[start:end], place[start:end]
            at = held.places[np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(held.starts[w], t)]
            yield runs(held, docs, owner, word, np.repeat(p, t), at)
            start, done = end, total[end]

    def runs(held: Items, docs: np.ndarray, owner: np.ndarray, word: np.ndarray, place: np.ndarray, at: np.ndarray) -> pd.DataFrame:
        """The longest run of each document and item."""
        m = pd.DataFrame({"doc": owner[place], "item": at[:, 0], "at": at[:, 1], "word": word[place]})
        m["shift"] = m["word"] - m["at"]
        m = m.sort_values(["doc", "item", "shift", "at"], ignore_index=True)
        new = (m[["doc", "item", "shift"]].diff().abs().sum(axis=1) != 0) | (m["at"].diff() != 1)
        found = m.groupby(new.cumsum()).agg(doc=("doc", "first"), item=("item", "first"), at=("at", "first"), word=("word", "first"), n=("at", "size"))
        best = found.sort_values(["doc", "item", "n", "word", "at"], ascending=[True, True, False, True, True]).drop_duplicates(["doc", "item"])
        return pd.DataFrame({"doc_id": docs[best["doc"]], "item_id": held.ids[best["item"]], "n_words": best["n"].to_numpy() + min_words - 1, "doc_word": best["word"].to_numpy(), "item_word": best["at"].to_numpy()})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Items(items, min_words)
        get = held.known.get
        docs: list[int] = []
        parts: list[list[np.ndarray]] = []
        n = 0

        def flush() -> Iterator[pd.DataFrame]:
            owner, word, text = (np.concatenate(c) for c in zip(*parts))
            yield from shard(held, np.array(docs, "i8"), owner, word, text)

        for batch in batches:
            for doc, text in zip(batch.iloc[:, 0], batch.iloc[:, 1]):
                ws = words(text)
                if len(ws) < min_words or not len(held.queries):
                    continue
                codes = np.array([get(w, 0) for w in ws], "i8")
                # a run with a word that no item has is no item's run: what is left of the text goes into the array
                at = np.flatnonzero(_open_runs(codes, min_words))
                if not len(at):
                    continue
                gap = np.flatnonzero(np.diff(at) > 1) + 1
                at, codes = np.insert(at, gap, -1), np.insert(codes[at], gap, 0)
                parts.append([np.full(len(at) + 1, len(docs)), np.append(at, -1), np.append(codes, 0)])
                docs.append(doc)
                n += len(at) + 1
                if n >= shard_words:
                    yield from flush()
                    docs, parts, n = [], [], 0
        if docs:
            yield from flush()

    return run


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text", min_words: int = 12,
    shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``doc_id, item_id, n_words, doc_word, item_word``: the longest shared run of each document and item that share one."""
    corpus = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    tests = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text is not null")
    total = tests.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    blocks = -(-total // block_bytes) or 1
    out = None
    for b in range(blocks):  # the driver holds one block at a time
        block = [(r.item_id, words(r.text)) for r in tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).collect()]
        found = corpus.mapInPandas(_search(block, min_words, shard_words), "doc_id long, item_id long, n_words long, doc_word long, item_word long")
        found = found if blocks == 1 else materialize(found, "leaks")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("n_words", (-F.col("doc_word")).alias("d"), (-F.col("item_word")).alias("i")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.n_words").alias("n_words"), (-F.col("b.d")).alias("doc_word"), (-F.col("b.i")).alias("item_word"))


def without_leaks(documents: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that give no test item away."""
    return documents.join(found.select(F.col("doc_id").alias(doc_id)).distinct(), doc_id, "left_anti")
