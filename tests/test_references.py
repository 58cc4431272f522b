import datetime as dt
import random

from trellis.operators.references import orphan_references, orphan_report, orphans
from trellis.operators.skew import hot_keys

DAY = [dt.datetime(2025, 1, 1) + dt.timedelta(days=i) for i in range(60)]
REF, PARENT, GONE = "key string, row_id long, loaded_at timestamp_ntz, state string", "key string, loaded_at timestamp_ntz, row_id long", "key string, loaded_at string"


def brute(refs, parents, gone):
    since = {}
    for k, t, _ in parents:
        since.setdefault(k, []).append(t)
    out = set()
    for k, i, t, _ in refs:
        if k is None:
            continue
        if k in since:
            times = [x for x in since[k] if x]
            if times and t and min(times) > t:
                out.add((i, t, "late"))
        else:
            out.add((i, t, "deleted" if k in {g[0] for g in gone} else "missing"))
    return out


def test_against_brute_force(spark):
    r = random.Random(4)
    keys = [f"k{i}" for i in range(30)] + ["K1", "k1 ", "é", "é", ""]
    refs = [(r.choice(keys + [None]) if r.random() < 0.6 else "hot", i, r.choice(DAY + [None]), "clash") for i in range(600)]
    parents = [(k, r.choice(DAY + [None]), 1) for k in r.sample(keys, 20) for _ in range(r.randrange(1, 3))] + [("hot", DAY[30], 2), (None, DAY[0], 3)]
    gone = [(k, "x") for k in r.sample(keys, 15)] + [(None, None)]
    refs += refs[::5]
    frames = spark.createDataFrame(refs, REF), spark.createDataFrame(parents, PARENT), spark.createDataFrame(gone, GONE)
    for hot in (10, 1 << 20):
        rows = orphans(*frames, hot=hot).collect()
        assert len(rows) == len({tuple(x) for x in rows}) and {tuple(x) for x in rows} == brute(refs, parents, gone)
    assert orphans(frames[0].limit(0), *frames[1:]).count() == 0
    assert {x.state for x in orphans(frames[0], frames[1].limit(0), frames[2].limit(0)).collect()} == {"missing"}


def test_three_tables(spark):
    symbols = spark.createDataFrame([(1, "f", "a.py", DAY[5]), (2, "g", "gone.py", DAY[5]), (3, "h", None, DAY[5])], "id long, name string, file string, loaded_at timestamp")
    files = spark.createDataFrame([("a.py", DAY[9])], "path string, loaded_at timestamp")
    edges = spark.createDataFrame([(10, 1, DAY[1]), (10, 1, DAY[1]), (11, 9, DAY[40]), (12, None, DAY[1]), (13, 2, DAY[9])], "id long, to_id long, loaded_at timestamp")
    vectors = spark.createDataFrame([(20, "f", "Function", DAY[9]), (21, "zz", None, DAY[9]), (22, "m-1", "memory", DAY[9]), (23, None, "Class", DAY[9])], "id long, symbol_name string, symbol_kind string, loaded_at timestamp")
    removals = spark.createDataFrame([("symbols", 9, "zz"), ("files", None, "gone.py"), ("files", 11, "zz")], "target_table string, target_id long, target_name string")
    found = orphan_references(edges, vectors, symbols, files, removals)
    assert {tuple(r) for r in found.collect()} == {
        ("edges", 10, "2025-01", "late"), ("edges", 11, "2025-02", "deleted"), ("vectors", 21, "2025-01", "deleted"), ("symbols", 1, "2025-01", "late"), ("symbols", 2, "2025-01", "deleted"),
    }
    assert {tuple(r) for r in orphan_report(found).collect()} == {("edges", "2025-01", "late", 1), ("edges", "2025-02", "deleted", 1), ("vectors", "2025-01", "deleted", 1), ("symbols", "2025-01", "late", 1), ("symbols", "2025-01", "deleted", 1)}


def test_the_number_of_hot_keys_is_bounded(spark):
    rows = spark.createDataFrame([(f"k{i % 7}" if i % 3 else "top", i) for i in range(300)] + [(None, i) for i in range(50)], "key string, row_id long")
    assert {r.key for r in hot_keys(rows, "key", hot=5).collect()} == {"top", *(f"k{i}" for i in range(7))}
    few = hot_keys(rows, "key", hot=5, most=1).collect()
    assert [(r.key, r._salts) for r in few] == [("top", 20)]
    assert hot_keys(rows.limit(0), "key").count() == 0
