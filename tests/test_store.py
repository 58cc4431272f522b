import json
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trellis.functions.payload import NOTE, fit
from trellis.functions.text import new_id, one_line
from trellis.operators import embedding as em
from trellis.operators import graph as g
from trellis.operators.build import upsert_symbols
from trellis.operators.order import numbered
from trellis.operators.postings import bm25_postings, build_postings
from trellis.operators.search import bm25
from trellis.sources.changes import changed_paths, read_changes
from trellis.store import Busy, GraphStore

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import the tests


def test_versions_and_snapshots(spark, tmp_path):
    a, b = GraphStore(spark, f"file://{tmp_path}/a"), GraphStore(spark, f"file://{tmp_path}/b")
    assert a.version is None and not b.seed_from(a)
    with pytest.raises(FileNotFoundError):
        a.read("files")
    for n in (3, 5, 7):
        with a.lock():
            a.write({"files": spark.range(n), "edges": spark.range(1)})
    assert a.read("files").count() == 7 and len([p for p in (tmp_path / "a").iterdir() if p.name.startswith("v")]) == 2
    with pytest.raises(Exception):  # a table fails: readers keep the old version
        a.write({"files": spark.range(9), "edges": spark.range(1).select(F.raise_error(F.lit("no")).alias("x"))})
    assert a.read("files").count() == 7
    with a.lock():
        with pytest.raises(Busy):
            with a.lock(wait=0.1):
                pass
        assert not b.seed_from(a)
    assert b.seed_from(a) and b.read("files").count() == 7 and not b.seed_from(a) and not a.seed_from(a)


class Picky:
    """Fails where a text is bad, and for all requests of more than ``most`` texts."""

    name, dim = "picky", 1

    def __init__(self, most=99):
        self.most, self.calls = most, 0

    def embed(self, texts):
        self.calls += 1
        if len(texts) > self.most or "bad" in texts:
            raise RuntimeError("refused")
        return [[float(len(t))] for t in texts]


def test_failed_requests_are_halved():
    texts = [f"t{i}" for i in range(16)]
    assert em.embed_texts(Picky(4), texts, em.Patience(16)) == ([[float(len(t))] for t in texts], "refused")
    got, error = em.embed_texts(Picky(), [*texts[:5], "bad", *texts[5:]], em.Patience(17))
    assert [i for i, v in enumerate(got) if v is None] == [5] and error == "refused"
    engine = Picky(0)
    assert em.embed_texts(engine, texts, em.Patience(16))[0] == [None] * 16 and engine.calls == em.Patience(16).limit
    engine.embed = lambda texts: [[1.0]] * (len(texts) - 1)
    assert "expected" in em.embed_texts(engine, ["a", "b"], em.Patience(2))[1]

    class Off(Picky):
        def embed(self, texts):
            self.calls += 1
            raise em.NotConfigured("no key")

    off = Off()
    assert em.embed_texts(off, texts, em.Patience(16)) == ([None] * 16, "no key") and off.calls == 1
    assert em.embed_texts(off, [], em.Patience(1)) == ([], None)


def test_sync(spark):
    schema = "file string, symbol_name string, symbol_kind string, text string"
    wanted = spark.createDataFrame([("a", "f", "Function", "x"), ("a", "f", "Function", "x"), ("a", "g", "Function", "new"), (None, "h", "Class", "y"), ("a", "z", "Class", "bad")], schema)
    stored = spark.createDataFrame([(1, "a", "f", "Function", "x", [1.0]), (2, "a", "g", "Function", "old", [2.0]), (3, None, "h", "Class", "y", [3.0]), (4, None, "h", "Class", "y", [4.0])], f"id long, {schema}, embedding array<float>")
    missing, stale = em.sync_plan(wanted, stored)
    assert sorted(r.text for r in missing.collect()) == ["bad", "new", "x"] and sorted(r.id for r in stale.collect()) == [2, 4]
    rows = em.synced(wanted, stored, Picky, batch=2).collect()
    assert sorted((r.symbol_name, r.embedding[0]) for r in rows) == [("f", 1.0), ("f", 1.0), ("g", 3.0), ("h", 3.0)]
    assert len(em.synced(wanted, stored, Picky, model="another").collect()) == 4 and len(em.synced(wanted.limit(0), stored, Picky).collect()) == 0
    a, b = em.HashEngine(8).embed(["x", "x"])
    assert a == b and len(a) == 8 and em.HashEngine(8).embed(["y"])[0] != a


def test_upsert_keeps_ids(spark):
    cols = "id long, file string, name string, kind string, line_start long"
    old = spark.createDataFrame([(1, "a", "f", "F", 1), (2, "a", "f", "F", 9), (5, "b", "g", "F", 1)], cols)
    new = spark.createDataFrame([(70, "a", "f", "F", 4), (71, "a", "h", "F", 8), (72, "a", "i", "F", 2)], cols)
    assert sorted(map(tuple, upsert_symbols(old, new).collect())) == [(1, "a", "f", "F", 4), (5, "b", "g", "F", 1), (6, "a", "i", "F", 2), (7, "a", "h", "F", 8)]
    assert upsert_symbols(old, new.limit(0)).count() == 3 and upsert_symbols(old.limit(0), new).count() == 3


def test_numbers_over_ranges(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 37 % 1009).alias("k"))
    rows = numbered(df, ["k"], "n").collect()
    assert {r.n: r.k for r in rows} == dict(enumerate(sorted(r.k for r in rows))) and numbered(df.limit(0), ["k"], "n").count() == 0


def test_postings_score_like_a_scan(spark):
    rows = [(1, "queryPlan", "fn queryPlan(a)", "Plans the query plan", "query plan query"), (2, "étude", None, None, "plan b; Etude"), (3, None, None, None, None), (4, "x", "", "no", "query-planner planning")]
    df = spark.createDataFrame(rows, "id long, name string, signature string, doc string, content string")
    index = build_postings(df)
    for text in ("query", "query plan", "query-plan", "etude; none", "plan-b zzz"):
        want = {r.id: round(r.score, 9) for r in bm25(df, text).collect()}
        assert {r.id: round(r.score, 9) for r in bm25_postings(index, text).collect()} == want and want
    assert bm25_postings(index, "a ;").count() == 0 and bm25_postings(build_postings(df.limit(0)), "query").count() == 0


def test_changes(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    assert changed_paths(str(tmp_path)) == []
    run("init", "-q")
    (tmp_path / "a é.txt").write_text("1")
    run("add", ".")
    run("commit", "-qm", "one")
    (tmp_path / "a é.txt").write_text("2")
    (tmp_path / "b.txt").write_text("1")
    run("add", "b.txt")
    assert changed_paths(str(tmp_path)) == ["a é.txt", "b.txt"] and changed_paths(str(tmp_path), staged=True) == ["b.txt"]
    run("commit", "-qam", "two")
    assert changed_paths(str(tmp_path)) == [] and changed_paths(str(tmp_path), between=("HEAD~1", "HEAD")) == ["a é.txt", "b.txt"]
    assert read_changes(spark, str(tmp_path), between=("HEAD~1", "HEAD")).count() == 2 and read_changes(spark, str(tmp_path)).count() == 0


def test_payloads_and_lines(spark):
    assert json.loads(fit({"a": [1, 2]})) == {"a": [1, 2]}
    cut = json.loads(fit({"rows": list(range(400)), "n": 1}, 1000))
    assert cut["rows"] == list(range(100)) and cut["rows_pagination"]["next_offset"] == 100 and cut["rows_pagination"]["total"] == 400 and cut["n"] == 1
    assert fit("é" * 900, 1000).endswith(NOTE) and len(fit({"a": "é" * 900}, 1000).encode()) <= 1000 + len(NOTE.encode())
    df = spark.createDataFrame([("a \n b  c",), ("x" * 20,), (None,)], "c string")
    assert [r[0] for r in df.select(one_line("c", 5)).collect()] == ["a b c", "xxxxx…", None]
    assert len({r[0] for r in spark.range(5).select(new_id()).collect()}) == 5


def test_context_bundle(spark):
    files = spark.createDataFrame([("a.py", "python"), ("b.go", "go"), ("c.go", "go")], "path string, language string")
    symbols = spark.createDataFrame([(1,)], "id long")
    entries = spark.createDataFrame([(f"m{i}", f"2025-01-{i + 1:02}", "p" if i % 2 else None, i % 2 == 0, f"text {i}") for i in range(14)] + [("o", "2026-01-01", "other", False, "no")], "id string, created string, project string, global boolean, content string")
    links = spark.createDataFrame([("p", "q", "uses"), ("x", "y", "uses")], "from_project string, to_project string, type string")
    one = json.loads(g.context_bundle(files, symbols, symbols.limit(0), entries, links, "p").first().payload)
    assert one["stats"] == {"n_files": 3, "n_symbols": 1, "n_edges": 0} and one["languages"] == [{"language": "go", "n_files": 2}, {"language": "python", "n_files": 1}]
    assert [x["id"] for x in one["memory"]] == [f"m{i}" for i in range(13, 3, -1)] and [x["direction"] for x in one["links"]] == ["out"]
    empty = json.loads(g.context_bundle(files.limit(0), symbols.limit(0), symbols.limit(0), entries.limit(0), links.limit(0), "p").first().payload)
    assert empty["languages"] == empty["memory"] == empty["links"] == []
