import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.llm.leakage import interval, leaks, suffix_array, without_leaks, words


def test_words():
    assert words("// **The** que\u00adry_plan\u200b's été, 12x") == ["the", "query", "plan", "s", "été", "12x"]
    assert words(None) == words("") == words(" .. ") == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.lists(st.integers(0, 3), min_size=3, max_size=3))
def test_interval(text, query):
    t = np.array(text)
    order = suffix_array(t, 3)
    low, high = interval(np.concatenate([t, np.full(3, -2)]), order, np.array([query]))
    assert sorted(order[low[0] : high[0]]) == [i for i in range(len(text) - 2) if text[i : i + 3] == query]


def brute(docs, items, n):
    out = {}
    for d, t in docs:
        a = words(t)
        for i, u in items:
            b = words(u)
            best = 0
            for x in range(len(a)):
                for y in range(len(b)):
                    k = 0
                    while x + k < len(a) and y + k < len(b) and a[x + k] == b[y + k]:
                        k += 1
                    best = max(best, k)
            if best >= n:
                out[d, i] = best
    return out


def test_against_brute_force(spark):
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choices(vocab, k=r.randrange(3, 30)))) for i in range(8)] + [(99, None), (98, "")]
    docs = [(i, "  ".join(r.choices(vocab, k=r.randrange(0, 60)))) for i in range(60)]
    docs += [(100, items[3][1] + " , " + items[3][1]), (101, None), (102, ""), (103, "x " * 5000 + items[4][1].upper())]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs[:-1] + [(103, items[4][1])], [i for i in items if i[1]], 6)
    for shard, block in ((200, 40), (1 << 20, 1 << 20)):
        rows = leaks(d.union(d), b, min_words=6, shard_words=shard, block_bytes=block).collect()
        assert len(rows) == len(want) and {(r.doc_id, r.item_id): r.n_words for r in rows} == want
    found = leaks(d, b, min_words=6)
    assert {x.doc_id for x in without_leaks(d, found).collect()} == {i for i, _ in docs} - {i for i, _ in want}
    assert leaks(d.limit(0), b).count() == 0 and leaks(d, b.limit(0)).count() == 0
