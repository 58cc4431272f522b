import random

import pytest

from trellis.operators.hierarchy import descendants, hierarchy, intervals
from trellis.session import materialize


def brute(pairs):
    up = {}
    for c, p in pairs:
        if c is not None and p is not None:
            up[c] = min(p, up.get(c, p))
    out = {}
    for x in set(up) | set(up.values()):
        seen, y = [x], x
        while y in up and up[y] not in seen:
            y = up[y]
            seen.append(y)
        if y in up:
            out[x] = (min(seen[seen.index(up[y]) :]), -1, None)
        else:
            out[x] = (y, len(seen) - 1, seen[::-1])
    return out


def forest(seed, n):
    r = random.Random(seed)
    ids = r.sample(range(10 * n), n)
    pairs = []
    for i, x in enumerate(ids):
        if i and r.random() < 0.95:
            pairs.append((x, ids[i - 1] if r.random() < 0.6 else ids[r.randrange(max(0, i - 50), i)] if r.random() < 0.7 else ids[0]))
    for k in range(5):  # loops of several lengths, and chains below them
        loop = [10 * n + 100 * k + j for j in range(1 + 7 * k)]
        pairs += [(a, b) for a, b in zip(loop, loop[1:] + loop[:1])]
        pairs += [(10 * n + 5000 + 100 * k + j, loop[0] if j == 0 else 10 * n + 5000 + 100 * k + j - 1) for j in range(9)]
    pairs += pairs[::7] + [(None, 1), (2, None)]
    r.shuffle(pairs)
    return pairs


@pytest.mark.parametrize("least", [60, 400, 1 << 13])
def test_against_walk(spark, least):
    pairs = forest(3, 700)
    rows = hierarchy(spark.createDataFrame(pairs, "child long, parent long"), paths=True, least=least).collect()
    got = {r.node: (r.root, r.depth, r.path) for r in rows}
    assert len(rows) == len(got)
    assert got == brute(pairs)


def test_empty_and_descendants(spark):
    assert hierarchy(spark.createDataFrame([], "child long, parent long")).count() == 0
    assert hierarchy(spark.createDataFrame([(None, None), (1, None)], "child long, parent long")).count() == 0
    d = spark.createDataFrame([(2, 1, "a"), (3, 2, "b"), (4, 4, "c")], "child long, parent long, path string")
    full = hierarchy(d, paths=True)
    assert {tuple(r) for r in descendants(full).collect()} == {(1, 2, 1), (1, 3, 2), (2, 3, 1)}
    assert {tuple(r)[:3] for r in full.collect()} == {(1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 4, -1)}


def test_intervals(spark):
    pairs = forest(5, 300)
    full = hierarchy(spark.createDataFrame(pairs, "child long, parent long"), paths=True, least=50)
    rows = {r.node: (r.first, r.last) for r in intervals(full).collect()}
    want = {(a, d) for a, d, _ in descendants(full).collect()}
    assert {(a, d) for a, (x, y) in rows.items() for d, (z, _) in rows.items() if x < z <= y} == want
    assert sorted(x for x, _ in rows.values()) == list(range(len(rows)))
    assert intervals(full.limit(0)).count() == 0


def test_several_levels_at_every_size(spark, monkeypatch):
    from trellis.operators import hierarchy as h

    seen = []
    monkeypatch.setattr(h, "materialize", lambda df, name: seen.append(name) or materialize(df, name))
    pairs = [(i, i // 2) for i in range(1, 3 * h.LEAST)]
    rows = hierarchy(spark.createDataFrame(pairs, "child long, parent long"))
    assert rows.count() == 3 * h.LEAST and rows.agg({"depth": "max"}).first()[0] == (3 * h.LEAST - 1).bit_length()
    assert "fragments1" in seen


def test_components(spark):
    from trellis.operators.components import components

    pairs = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("x", "y"), ("z", "y"), ("q", "q")]
    got = dict(components(spark.createDataFrame(pairs, "a string, b string")).collect())
    assert {got[f"{i:03}"] for i in range(41)} == {"000"} and got["z"] == got["y"] == got["x"] == "x" and "q" not in got
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0
