import os

import numpy as np
import pytest

from trellis.llm.neighbours import codes, rotate, settings, signs_of, similar_pairs, similar_vectors, usable
from trellis.llm.plans import p1_neighbours
from trellis.sources import table

DIM = 16


def _data(seed=0, n=240, groups=30, noise=0.12):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, DIM))
    return (centres[r.integers(0, groups, n)] + noise * r.normal(size=(n, DIM)) * np.linalg.norm(centres, axis=1).mean() / np.sqrt(DIM) * 1.5) * r.uniform(0.2, 5, (n, 1))


def brute(vectors, k, least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], "f4").astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    out = set()
    for a in range(len(ids)):
        kth = np.sort(s[a])[-k]
        for b in np.flatnonzero((s[a] >= max(least, -1)) & (s[a] >= kth - 1e-12)):
            out.add((min(ids[a], ids[b]), max(ids[a], ids[b])))
    return out


def test_rotations_keep_lengths():
    x = np.random.default_rng(1).normal(size=(5, 24)).astype("f4")
    for signs in signs_of(24, 3):
        y = rotate(x, signs)
        assert y.shape == (5, 32) and np.allclose(y @ y.T, x @ x.T, atol=1e-3)
    signs = signs_of(24, 4)
    found = codes(x, signs, 2, 2, 5, 9.0)
    assert found.shape == (5, 2, 6) and (found >= 0).all() and all(len(set(c)) == 6 for row in found for c in row)
    assert (codes(2 * x, signs, 2, 2, 0, 9.0)[:, :, 0] == found[:, :, 0]).all() and (codes(x, signs, 2, 2, 5, 0.0)[:, :, 1:] == -1).all()


def test_probes_are_ranked_by_what_they_lose():
    x = np.random.default_rng(2).normal(size=(20, 16)).astype("f4")
    signs = signs_of(16, 2)
    sides = [np.concatenate([y, -y], axis=1) for y in (rotate(x, s) for s in signs)]
    every = sides[0][:, :, None] + sides[1][:, None]
    best = np.argsort(-every.reshape(20, -1), axis=1)[:, :8]
    assert (codes(x, signs, 1, 2, 7, 9.0)[:, 0] == best).all()


def _rows(spark, vectors, extra=()):
    rows = [(i, [float(x) for x in v], "clash") for i, v in vectors.items()]
    return spark.createDataFrame(rows + list(extra), "id long, embedding array<float>, code string")


BAD = [(9001, None, "x"), (9002, [], "x"), (9003, [1.0] * 5, "x"), (9004, [0.0] * DIM, "x"), (9005, [float("nan")] + [1.0] * (DIM - 1), "x"), (9006, [float("inf")] + [1.0] * (DIM - 1), "x"), (9007, [None] + [1.0] * (DIM - 1), "x"), (None, [1.0] * DIM, "x")]


def test_recall_and_hot_codes(spark):
    vectors = {i: v for i, v in enumerate(_data())}
    want = brute(vectors, 5, 0.9)
    df = _rows(spark, vectors, BAD)
    opts = dict(dim=DIM, k=5, min_cosine=0.9, hashes=2, tables=10, probes=1, probe_gap=0.2)
    plain = similar_vectors(df.union(df.limit(20)), **opts).collect()
    got = {(min(r.id, r.other_id), max(r.id, r.other_id)) for r in plain}
    assert len(got & want) >= 0.97 * len(want) and len(want) > 100
    assert len({(r.id, r.other_id) for r in plain}) == len(plain) and all(r.cosine >= 0.9 and 1 <= r.rank <= 5 for r in plain)
    split = similar_vectors(df, cap=6, **opts)  # nearly every code is heavy: the same pairs from blocks
    assert {(r.id_a, r.id_b) for r in similar_pairs(split).collect()} == got
    assert similar_vectors(df.limit(0), **opts).count() == 0


def test_copies(spark):
    base = _data(3, 4, 4, 0.0)
    vectors = {i: base[0] for i in range(40)} | {100: base[1], 101: base[1] * 1.0, 102: base[0] + 1e-3}
    rows = similar_vectors(_rows(spark, vectors), dim=DIM, k=3, min_cosine=0.9).collect()
    near = {}
    for r in rows:
        near.setdefault(r.id, set()).add(r.other_id)
    assert near[100] == {101} and near[101] == {100}
    assert near[102] == {0, 1, 2, 3}  # the four smallest ids stand for forty copies
    assert near[30] >= {0, 1, 2} and near[0] >= {1, 2, 3} and len(rows) < 40 * 6


def test_search_of_some_rows(spark):
    vectors = {i: v for i, v in enumerate(_data(7, 400, 12, 0.8))}
    df = _rows(spark, vectors, BAD)
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], "f4")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for cap in (2048, 16):
        rows = similar_vectors(df, dim=DIM, k=10, tables=12, hashes=1, probes=1, probe_gap=9.0, queries="id % 20 = 0", cap=cap).collect()
        got = {}
        for r in rows:
            got.setdefault(r.id, set()).add(r.other_id)
        assert set(got) == {i for i in ids if i % 20 == 0}
        hits = [len(got[q] & set(np.argsort(-np.where(np.arange(len(ids)) == q, -9, x @ x[q]))[:10])) for q in got]
        assert np.mean(hits) >= 9


def test_all_rows_get_their_far_neighbours(spark):
    vectors = {i: v for i, v in enumerate(np.random.default_rng(11).normal(size=(300, DIM)))}
    df = _rows(spark, vectors, BAD)
    for block in (1000, 60):
        rows = similar_vectors(df.union(df.limit(20)), dim=DIM, k=5, exhaustive=True, block=block).collect()
        assert {(min(r.id, r.other_id), max(r.id, r.other_id)) for r in rows} == brute(vectors, 5, -1)
        assert len(rows) == 5 * len(vectors)
    some = similar_vectors(df, dim=DIM, k=5, exhaustive=True, block=60, queries="id % 20 = 0").collect()
    assert {(r.id, r.other_id) for r in some} == {(r.id, r.other_id) for r in rows if r.id % 20 == 0}
    assert similar_vectors(df.limit(0), dim=DIM, exhaustive=True).count() == 0
    base = _data(3, 4, 4, 0.0)
    copies = {i: base[0] for i in range(9)} | {100: base[1], 101: base[2], 102: base[0] + 1e-3}
    pairs = [similar_vectors(_rows(spark, copies), dim=DIM, k=2, exhaustive=e, hashes=1, tables=24, probes=2, probe_gap=9.0).select("id", "other_id", "rank").collect() for e in (True, False)]
    assert sorted(pairs[0]) == sorted(pairs[1])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query_leaves_no_row_out(spark):
    d = "/root/testdata/sf0.001"
    rows = usable(table(spark, d, "vectors"), "id", "embedding", 64)
    near = p1_neighbours(spark, d).groupBy("id").count().collect()
    assert {r.id for r in near} == {r.id for r in rows.collect()} and min(r["count"] for r in near) >= 5


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_recall_of_the_index_over_all_rows(spark):
    rows = table(spark, "/root/testdata/sf0.01", "vectors")
    exact = similar_vectors(rows, exhaustive=True).select("id", "other_id").collect()
    assert settings(2000)["hashes"] == 1 and settings(1 << 24)["hashes"] == 2
    for given in ({}, settings(1 << 24)):  # the latter is made for more vectors, which have nearer neighbours
        found = set(map(tuple, similar_vectors(rows, **given).select("id", "other_id").collect()))
        assert len(found & set(map(tuple, exact))) >= 0.9 * len(exact)


def test_replayed_rows_take_no_place(spark):
    vectors = {i: v for i, v in enumerate(_data(9, 60, 2, 0.3))}
    df = _rows(spark, vectors)
    opts = dict(dim=DIM, k=5, min_cosine=0.5, hashes=1, tables=8, probes=3, probe_gap=9.0)
    many = df
    for _ in range(12):
        many = many.union(df.filter("id < 3"))
    assert sorted(similar_vectors(many.repartition(9), **opts).collect()) == sorted(similar_vectors(df, **opts).collect())
