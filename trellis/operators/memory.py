"""A store of remembered facts: search, upkeep and near-duplicates.

Columns: ``id, created, updated, project, global, type, content, tags, priority, promoted, demoted, recall_count, expires_at``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trellis.functions.text import jaccard, word_set
from trellis.operators.components import components
from trellis.operators.order import numbered
from trellis.session import materialize

#: Days that a fact of a type lives; types that are not here live on.
TTL_DAYS = {"bug": 90, "context": 30, "session": 7}
# ---- fixed values: words that carry no meaning in a query, English then French
STOPWORDS = (
    "a about after again all also am an and any are as at be because been before both but by can could did do does doing done each else for from got had has have he her here "
    "him his how i if in into is it its just let lets like may me might more most much must my no not now of ok on one only or other our out over please pls same she should so "
    "some still such than that the their them then there these they this those to too u ur up us very was way we were what when where which while who why will with would yes "
    "you your au aussi avec avoir bien ca ça ce comme dans de deja déjà des dois doit du elle en encore est et être fais faire fait ici il ils jamais je la le les leur ma mais "
    "maintenant mes moi mon ne non nous ont ou où oui par pas peu peut peux plus pour qu qui que rien sa se ses si son sont sur toujours tout trop tu un une veux vous"
).split()
_STOP = frozenset(STOPWORDS)
#: Signs that may be part of a name, and those of them that are cut off its ends.
PARTS, ENDS = r"_\-./:@$", ".:-/@$"


def is_stopword(word: str) -> bool:
    return word in _STOP or ("-" in word and all(not p or p in _STOP for p in word.split("-")))


def looks_like_name(raw: str) -> bool:
    """Written like the name of a thing: a path, snake_case, camelCase, CAPITALS, a dotted, scoped or hyphenated name."""
    if sum(c.isalpha() for c in raw) < 2:
        return False
    lower, upper = any(c.islower() for c in raw), any(c.isupper() for c in raw)
    if any(c in raw for c in "_/.:") or (lower and any(c.isupper() for c in raw[1:])) or (upper and not lower and len(raw.encode()) >= 4):
        return True
    return "-" in raw and all(p and not is_stopword(p.lower()) for p in raw.split("-"))


def words_of(text: str) -> list[str]:
    """Runs of characters that can be part of names and paths."""
    return [w for raw in re.split(rf"[^\w{PARTS}]+", text) if (w := raw.strip(ENDS))]


def query_terms(query: str) -> dict[str, bool]:
    """Different words of two or more letters that are no stopwords, in lower case and their order; whether they are names."""
    out: dict[str, bool] = {}
    for raw in words_of(query):
        word = raw.lower()
        if len(word) >= 2 and not is_stopword(word):
            out[word] = out.get(word, False) or looks_like_name(raw)
    return out


def _occurrences(text: Column, term: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(term), F.lit("")))) / len(term)).cast("int")


def same_thing(a: Column, b: str) -> Column:
    """Equal, or one ends with the other behind a slash or colon, or one begins with the other before a colon."""
    lit = F.lit(b)
    ends = lambda x, y: x.endswith(F.concat(F.lit("/"), y)) | x.endswith(F.concat(F.lit(":"), y))
    return (a == lit) | ends(a, lit) | ends(lit, a) | a.startswith(F.concat(lit, F.lit(":"))) | lit.startswith(F.concat(a, F.lit(":")))


def _words(text: Column) -> Column:
    cut = lambda w: F.regexp_replace(w, r"^[.:\-/@$]+|[.:\-/@$]+$", "")
    return F.filter(F.transform(F.split(text, rf"[^\p{{L}}\p{{N}}{PARTS}]+"), cut), lambda w: w != "")


def _stopword(word: Column) -> Column:
    listed = lambda w: w.isin(*STOPWORDS)
    return listed(word) | (word.contains("-") & F.forall(F.split(word, "-"), lambda p: (p == "") | listed(p)))


def term_score(term: str, name: bool = False) -> Column:
    """Points of a term: occurrences in the content (whole words where it is short), what it names, and the type of that name.

    It names a tag, or, if it is written like a name, a word of the text: that word or one of three letters or more that
    means the same thing and is no stopword.
    """
    text = F.lower("content")
    hits = _occurrences(text, term) if len(term) >= 3 else F.size(F.filter(_words(text), lambda w: w == term))
    score = F.when(hits > 0, 1 + 0.1 * F.least(hits, F.lit(3))).otherwise(0.0)
    names = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: same_thing(F.lower(t), term))
    if name:
        names = names | F.coalesce(F.exists(_words(text), lambda w: (w == term) | ((F.length(w) >= 3) & same_thing(w, term) & ~_stopword(w))), F.lit(False))
    score = score + F.when(names, 2.0).otherwise(0.0)
    return F.coalesce(score + F.when(F.lower("type") == term, 1.5).otherwise(0.0), F.lit(0.0))


def search(entries: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """Best entries by (score descending, newest, id).  Three or more terms need two of them; a blank query lists."""
    if not query.strip():
        return entries.withColumn("score", F.lit(0.0)).orderBy(F.desc("created"), "id").limit(limit)
    terms = query_terms(query)
    if not terms:
        return entries.withColumn("score", F.lit(0.0)).filter(F.lit(False))
    parts = [term_score(t, name) for t, name in terms.items()]
    matched = reduce(lambda a, b: a + b, [(p > 0).cast("int") for p in parts])
    rows = entries.withColumn("score", F.round(reduce(lambda a, b: a + b, parts), 6)).filter(matched >= (2 if len(terms) >= 3 else 1))
    return rows.orderBy(F.desc("score"), F.desc("created"), "id").limit(limit)


def listed(entries: DataFrame, project: str) -> DataFrame:
    return entries.filter(F.col("global") | (F.col("project") == project))


def priorities(entries: DataFrame) -> DataFrame:
    """``ord``: pinned ones first, newest first, then promoted ones by recalls."""
    order = [F.col("promoted").cast("int"), F.desc(F.when(F.col("promoted"), F.col("recall_count")).otherwise(0)), F.desc("created"), "id"]
    return numbered(entries.filter("priority"), order, "ord").withColumn("ord", (F.col("ord") + 1).cast("int"))


def by_prefix(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries whose id begins so (eight letters or more); an exact one beats the rest."""
    if len(prefix) < 8:
        raise ValueError("a prefix needs 8 characters")
    hit = entries.filter(F.col("id").startswith(prefix))
    best = hit.agg(F.coalesce(F.max(F.col("id") == prefix), F.lit(False)).alias("_exact"))  # one row
    return hit.crossJoin(F.broadcast(best)).filter(~F.col("_exact") | (F.col("id") == prefix)).drop("_exact")


def record_recalls(entries: DataFrame, recalled: DataFrame) -> DataFrame:
    once = recalled.select("id").distinct().withColumn("_r", F.lit(1))
    return entries.join(once, "id", "left").withColumn("recall_count", (F.col("recall_count") + F.coalesce("_r", F.lit(0))).cast("int")).drop("_r")


def unexpired(entries: DataFrame, now: str) -> DataFrame:
    at = F.try_to_timestamp("expires_at")
    return entries.filter(at.isNull() | (at > F.lit(now).cast("timestamp")))


def without_commits(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("content").isNull() | ~F.col("content").startswith("[commit]"))


def auto_promote(entries: DataFrame, threshold: int = 3) -> DataFrame:
    """Plain entries recalled often enough become promoted."""
    up = ~F.col("priority") & ~F.col("demoted") & (F.col("recall_count") >= threshold) & F.lit(threshold > 0)
    return entries.withColumn("promoted", F.col("promoted") | up).withColumn("priority", F.col("priority") | up)


def tag_index(entries: DataFrame) -> DataFrame:
    """``tag, n_entries``, tags in lower case."""
    tags = entries.select("id", F.explode("tags").alias("tag")).filter("tag is not null").select("id", F.lower("tag").alias("tag")).distinct()
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n_entries"))


def project_index(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.coalesce("project", F.lit("__global__")).alias("project")).agg(F.count(F.lit(1)).alias("n_entries"))


# ---------------------------------------------------------------- near-duplicates


def words_key(words: Column) -> Column:
    """A digest that equal word sets have in common, and no others."""
    return F.unhex(F.sha2(F.array_join(F.sort_array(words), " "), 256))


def _sizes(threshold: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Least size of each range of sizes, and into how many parts the words of its sets are dealt.

    A set is like none beyond the next range.  Where its range ends with h words, sets that are like it differ from it in
    at most h (1 - threshold) / threshold words, so that at least one of one part more than that is the same in both.
    """
    least, parts = [0, 1], [1]
    while least[-1] <= most:
        last = math.floor(least[-1] / threshold + 1e-9)
        parts.append(math.floor(last * (1 - threshold) / threshold + 1e-9) + 1)
        least.append(last + 1)
    last = math.floor(least[-1] / threshold + 1e-9)
    parts.append(math.floor(last * (1 - threshold) / threshold + 1e-9) + 1)
    return np.array(least), np.array(parts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _signer(threshold: float, steps: dict[int, int], most: int | None):
    """For batches of ``id, key, hashes``: number of words, their parities in 128 bits, and the signs of their parts."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            hashes = batch.column("hashes")
            n = np.diff(hashes.offsets.to_numpy())
            h = _mixed(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            row = np.repeat(np.arange(len(n)), n)
            odd = np.zeros(len(n) * 128, np.uint8)
            np.add.at(odd, row * 128 + (h >> np.uint64(57)).astype(np.int64), 1)
            bits = np.packbits((odd & 1).reshape(-1, 128), axis=1).view(np.int64).reshape(-1, 2)
            least, parts = _sizes(threshold, int(n.max(initial=0)))
            at, signs, rows = np.searchsorted(least, n, "right") - 1, [], []
            for step, role in steps.items():
                size = at + step
                m = np.where(size < 0, 0, parts[np.maximum(size, 0)])
                start = np.cumsum(m) - m
                sums = np.zeros(m.sum(), np.uint64)
                np.add.at(sums, start[row] + ((h & np.uint64(0xFFFFFFFF)) % np.maximum(m, 1)[row].astype(np.uint64)).astype(np.int64), h)
                own = np.repeat(np.arange(len(n)), m)
                part = np.arange(len(own)) - start[own]
                sign = _mixed(sums + _mixed((size[own].astype(np.uint64) << np.uint64(32)) + part.astype(np.uint64) + np.uint64(1)))
                taken = slice(None) if most is None else part < most
                signs.append((((sign >> np.uint64(32)) << np.uint64(1)).astype(np.int64) | role)[taken])
                rows.append(own[taken])
            order = np.argsort(np.concatenate(rows), kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(np.concatenate(rows), minlength=len(n)))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(signs)[order]))
            columns = [batch.column("id"), batch.column("key"), pa.array(n.astype(np.int32)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "n", "s0", "s1", "signs"])

    return run


def signed(rows: DataFrame, threshold: float, steps: dict[int, int], most: int | None = None) -> DataFrame:
    """``id, n, s0, s1, sign`` of the rows (``id, content``), those of equal word sets as the one of the smallest id.

    The words are dealt into parts by their hashes, as many as ``_sizes`` says for the range of the set's size and for those
    that are ``steps`` away; a sign is of the words of one part, of at most ``most`` parts.  Its last bit is what ``steps`` gives, its role.
    """
    words = rows.select("id", word_set("content").alias("w")).select("id", words_key(F.col("w")).alias("key"), F.transform("w", lambda w: F.xxhash64(w)).alias("hashes"))
    kind = dict(rows.dtypes)["id"]
    made = words.mapInArrow(_signer(threshold, steps, most), f"id {kind}, key binary, n int, s0 long, s1 long, signs array<long>")
    once = made.groupBy("key").agg(F.min(F.struct("id", "n", "s0", "s1", "signs")).alias("_r")).select("_r.*")
    return once.select("id", "n", "s0", "s1", F.explode("signs").alias("sign"))


#: Pairs whose texts are found by a broadcast at most.
MOST_PAIRS = 100_000
#: Pairs that are compared at once.
_AT_ONCE = 1 << 20


def _meetings(sign: np.ndarray, both: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row and column numbers of rows to compare, to be broadcast: of each run of equal signs those of role 1 with those of
    role 0 before them and, where ``both``, with those of role 1 before them."""
    run = sign >> 1
    start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    size = np.diff(np.concatenate([start, [len(sign)]]))
    first = np.repeat(start, size)
    ones = np.concatenate([[0], np.cumsum(sign & 1)])
    zeros = size - (ones[start + size] - ones[start])
    before = np.where((sign & 1) == 1, np.arange(len(sign)) - first if both else np.repeat(zeros, size), 0)
    large = (size > 64) & (zeros < size) & (both | (zeros > 0))
    for s, c, z in zip(start[large], size[large], zeros[large]):
        step = max(1, _AT_ONCE // c)
        for i in range(s + z, s + c, step):
            j = min(i + step, s + c)
            yield np.arange(i, j)[:, None], np.arange(s, j if both else s + z)[None, :]
    before[np.repeat(large, size)] = 0
    row = np.flatnonzero(before)
    many = before[row]
    total = np.cumsum(many)
    cuts = np.searchsorted(total, np.arange(0, total[-1] if len(total) else 0, _AT_ONCE), "left").tolist() + [len(row)]
    for i, j in zip(cuts, cuts[1:]):
        if i < j:
            k = many[i:j]
            place = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            yield np.repeat(row[i:j], k), np.repeat(first[row[i:j]], k) + place


def _matcher(threshold: float, both: bool):
    """For batches of ``sign, id, n, s0, s1`` in the order of ``sign``: pairs that may be alike by sizes and parities."""
    import pyarrow as pa

    def pairs(table: pa.Table) -> Iterator:
        sign, n, s0, s1 = (table.column(c).to_numpy() for c in ("sign", "n", "s0", "s1"))
        s0, s1 = s0.view(np.uint64), s1.view(np.uint64)
        differ = n * ((1 - threshold) / (1 + threshold)) + 1e-9
        found = []
        for x, y in _meetings(sign, both):
            odd = np.bitwise_count(s0[x] ^ s0[y]) + np.bitwise_count(s1[x] ^ s1[y])
            near = np.nonzero(odd <= differ[x] + differ[y])
            i, j = (x[near[0], 0], y[0, near[1]]) if x.ndim == 2 else (x[near], y[near])
            fits = (j < i) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9)
            found.append(np.stack([j[fits], i[fits], odd[near][fits]]))
        if found and (at := np.concatenate(found, axis=1)).shape[1]:
            ids = table.column("id").combine_chunks()
            a, b = ids.take(pa.array(at[0])), ids.take(pa.array(at[1]))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(at[2].astype(np.int32))], ["a", "b", "odd"])

    def run(batches: Iterator) -> Iterator:
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sign = batch.column("sign").to_numpy() >> 1
            held.append(batch)
            rows += batch.num_rows
            cut = int(np.searchsorted(sign, sign[-1]))
            whole = len(held) == 1 and cut == 0 or cut == 0 and held[-2].column("sign")[-1].as_py() >> 1 == sign[0]
            if rows < 100_000 or whole:
                continue
            yield from pairs(pa.Table.from_batches([*held[:-1], batch.slice(0, cut)]))
            held, rows = [batch.slice(cut)], batch.num_rows - cut
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def close_texts(signs: DataFrame, threshold: float, both: bool) -> DataFrame:
    """``a, b, odd`` of the rows of ``signed`` that may be alike: none that is alike is missing.

    They share a sign, and no more bits of their parities differ (``odd``) than words may differ.
    """
    kind = dict(signs.dtypes)["id"]
    held = signs.repartition(F.shiftright("sign", 1)).sortWithinPartitions("sign").select("sign", "id", "n", "s0", "s1")
    return held.mapInArrow(_matcher(threshold, both), f"a {kind}, b {kind}, odd int").distinct()


def with_similarity(close: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs with their texts ``_a``, ``_b`` of ``left`` and ``right`` (``id, content``) and the similarity of these."""
    text = lambda rows, k: rows.select(F.col("id").alias(k), F.col("content").alias(f"_{k}"))
    both = close.join(text(left, "a"), "a").join(text(right, "b"), "b")
    words = both.select("a", "b", "_a", "_b", word_set("_a").alias("_v"), word_set("_b").alias("_w"))
    return words.withColumn("similarity", jaccard("_v", "_w")).drop("_v", "_w")


def word_classes(rows: DataFrame, text: str = "content") -> DataFrame:
    """``rep, words, n_rows``: rows of equal word sets as one class, named by the smallest id."""
    return rows.filter(F.col(text).isNotNull()).select("id", F.array_sort(word_set(text)).alias("words")).groupBy("words").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n_rows"))


def near_duplicates(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``a, b, similarity`` between classes of equal word sets."""
    return similar_texts(entries.filter(F.col("content").isNotNull()), threshold)


def new_entries(batch: DataFrame, entries: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Entries of a batch that are not blank and like none that is there already."""
    given = batch.filter(F.length(F.trim("content")) > 0)
    old = entries.filter(F.col("content").isNotNull()).select("id", "content")
    keyed = given.withColumn("_k", words_key(word_set("content")))

    def close(rows: DataFrame, most: int | None = None) -> DataFrame:
        return close_texts(signed(old, threshold, {0: 0}, most).unionByName(signed(rows, threshold, {-1: 1, 0: 1, 1: 1}, most)), threshold, both=False)

    def near(pairs: DataFrame) -> DataFrame:
        pairs = materialize(pairs, "close")
        pairs = F.broadcast(pairs) if pairs.count() <= MOST_PAIRS else pairs
        return materialize(with_similarity(pairs, old, given).filter(F.col("similarity") > threshold).select(words_key(word_set("_b")).alias("_k")).distinct(), "near")

    # a few parts and the closest one of each settle most of them; only the others are compared with all that may be like them
    closest = close(given, 3).groupBy("b").agg(F.min(F.struct("odd", "a")).alias("_c")).select("_c.a", "b")
    rest = keyed.join(near(closest), "_k", "left_anti")
    return rest.join(near(close(rest).select("a", "b")), "_k", "left_anti").drop("_k")


def similar_texts(rows: DataFrame, threshold: float) -> DataFrame:
    """``a, b, similarity`` of the rows (``id, content``) above the threshold, those of equal word sets as the one of the
    smallest id."""
    close = close_texts(signed(rows, threshold, {0: 1, -1: 0}), threshold, both=True)
    close = close.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return with_similarity(close, rows, rows).filter(F.col("similarity") > threshold).select("a", "b", "similarity")


def greedy_merge(entries: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``id`` of the entries that stay when near-duplicates merge, one component of similar entries at a time.

    In the order of ids an entry meets the kept ones before it; of two alike the one of higher rank (pinned or demoted,
    promoted, plain), more recalls, later creation stays.
    """
    import pandas as pd

    rows = entries.withColumn("content", F.coalesce("content", F.lit("")))
    rank = F.when(F.col("demoted") | (F.col("priority") & ~F.col("promoted")), 2).when(F.col("promoted"), 1).otherwise(0)
    ranked = rows.select("id", words_key(word_set("content")).alias("key"), rank.alias("rank"), "recall_count", F.col("created").cast("string").alias("created"))
    best = F.max(F.struct("rank", "recall_count", F.coalesce("created", F.lit("")).alias("created"), "id"))
    classes = ranked.groupBy("key").agg(best.alias("_b"), F.min("id").alias("rep")).select("rep", "_b.*")
    pairs = materialize(similar_texts(rows, threshold).select("a", "b"), "alike")
    label = components(pairs, "labels").select(F.col("node").alias("rep"), F.col("cluster").alias("low"))
    # what is like nothing stays as it is; only components of two or more are walked through
    alone = classes.join(label, "rep", "left_anti").select("id")
    before = pairs.groupBy(F.col("b").alias("rep")).agg(F.collect_list("a").alias("alike"))
    grouped = classes.join(label, "rep").join(before, "rep", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list = []
        place: dict = {}  # of the kept ones
        for r in pdf.sort_values("rep").itertuples():
            met = [place[x] for x in (r.alike if r.alike is not None else ()) if x in place]
            if met:
                i = min(met)
                k = kept[i]
                if (r.rank, r.recall_count) > (k.rank, k.recall_count) or ((r.rank, r.recall_count) == (k.rank, k.recall_count) and r.created >= k.created):
                    kept[i] = r
                    del place[k.rep]
                    place[r.rep] = i
            else:
                place[r.rep] = len(kept)
                kept.append(r)
        return pd.DataFrame({"id": [k.id for k in kept]})

    return alone.unionByName(grouped.groupBy("low").applyInPandas(run, f"id {dict(entries.dtypes)['id']}"))


# ---------------------------------------------------------------- changes


def mark_legacy(entries: DataFrame, cutoff: str, threshold: int = 3) -> DataFrame:
    """Pinned entries of old that were recalled often and changed since count as promoted."""
    old = F.col("priority") & ~F.col("promoted") & (F.col("recall_count") >= threshold) & (F.col("updated") != F.col("created")) & (F.col("updated") < F.lit(cutoff))
    return entries.withColumn("promoted", F.col("promoted") | F.coalesce(old, F.lit(False)))


def upsert(entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Entries with those of ``changes`` (same columns) in place of the ones of their id; ``created`` stays what it was."""
    born = entries.select("id", F.col("created").alias("_born"))
    new = changes.join(born, "id", "left").withColumn("created", F.coalesce("_born", "created")).select(*entries.columns)
    return entries.join(changes.select("id"), "id", "left_anti").select(*entries.columns).unionByName(new)


def delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids.select("id").distinct(), "id", "left_anti")


def retype(entries: DataFrame, kind: str, now: str) -> DataFrame:
    """Entries of another type; the expiry starts anew only where the new type lives for another time."""
    days = F.create_map(*[F.lit(x) for pair in TTL_DAYS.items() for x in pair])
    before, after = F.try_element_at(days, F.col("type")), F.lit(TTL_DAYS.get(kind)).cast("int")
    fresh = F.date_format(F.lit(now).cast("timestamp") + F.make_interval(days=after), "yyyy-MM-dd HH:mm:ss")
    return entries.withColumn("expires_at", F.when(before.eqNullSafe(after), F.col("expires_at")).otherwise(fresh)).withColumn("type", F.lit(kind))


def pin(entries: DataFrame, pinned: bool = True) -> DataFrame:
    """Pinned: priority, neither promoted nor demoted.  Unpinned: demoted, with no recalls."""
    rows = entries.withColumn("priority", F.lit(pinned)).withColumn("promoted", F.lit(False)).withColumn("demoted", F.lit(not pinned))
    return rows if pinned else rows.withColumn("recall_count", F.lit(0))


def not_shown(entries: DataFrame, shown: DataFrame) -> DataFrame:
    """Priority entries whose first eight id letters the session (``shown: id8``) has not seen."""
    return entries.filter("priority").withColumn("id8", F.substring("id", 1, 8)).join(shown.select("id8").distinct(), "id8", "left_anti").drop("id8")


def current_hits(hits: DataFrame, entries: DataFrame) -> DataFrame:
    """Vector hits (``id, text``) whose text is still the entry's content."""
    return hits.join(entries.select("id", F.col("content").alias("text")), ["id", "text"], "left_semi")


def fused_search(entries: DataFrame, query: str, near: DataFrame, limit: int = 10) -> DataFrame:
    """Term search fused with a ranked vector list (``id, rank``), ties by id; the order of terms where that list is empty."""
    words = search(entries, query, 3 * limit)
    order = W.orderBy(F.desc("score"), F.desc("created"), "id")
    words = words.withColumn("rank", F.row_number().over(order)).select("id", "rank")
    both = words.unionByName(near.filter(F.col("rank") <= 3 * limit).select("id", "rank"))
    rows = both.groupBy("id").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("score"))
    return rows.orderBy(F.desc("score"), "id").limit(limit)
