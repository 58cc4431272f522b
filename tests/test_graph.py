from trellis.operators import build as b
from trellis.operators import graph as g

SYMBOL = "id long, name string, kind string, file string, line_start long, line_end long, signature string, doc string, content string"
EDGE = "id long, from_id long, to_id long, kind string, confidence double, file string"


def _symbols(spark, rows):
    return g.clean_symbols(spark.createDataFrame([(i, n, k, f, a, z, None, None, None) for i, n, k, f, a, z in rows], SYMBOL))


ROWS = [(1, "A", "class", "a.ts", 1, 20), (2, "run", "METHOD", "a.ts", 2, 9), (3, "inner", "Function", "a.ts", 3, 5), (4, "use", "Function", "b.ts", 1, 4), (5, "x.use", "Function", "c.ts", 1, 4), (6, None, None, None, None, None)]
EDGES = [(1, 4, 2, " Calls", 0.3, None), (1, 4, 2, " Calls", 0.3, None), (2, 2, 4, "calls", None, None), (3, 4, 4, "calls", 1.0, None), (4, None, 2, "calls", 1.0, None), (5, 5, 4, "imports", 1.0, None)]


def test_graph(spark):
    s, e = _symbols(spark, ROWS), g.clean_edges(spark.createDataFrame(EDGES, EDGE))
    assert e.count() == 4
    assert {r.id for r in g.find_symbol(s, "use").collect()} == {4} and {r.id for r in g.find_symbol(s.filter("id != 4"), "USE").collect()} == {5}
    assert {r.id for r in g.callers(e, s, "run").collect()} == {4} and {r.id for r in g.callees(e, s, "use").collect()} == {4}
    assert {(r.src, r.dst) for r in g.mutual_files(e, s).collect()} == {("a.ts", "b.ts"), ("b.ts", "a.ts")}
    assert {r.id: r.qualified for r in g.qualified_names(s).collect()} == {1: "A", 2: "A#run", 3: "A#inner", 4: "use", 5: "x.use", 6: None}
    assert {r.id: r.parent_id for r in g.outline(s).collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}
    assert {r.id: r.n_edges for r in g.connections(e, s).collect()} == {1: 0, 2: 2, 3: 0, 4: 4, 5: 1, 6: 0}
    assert {(r.file, r.depth) for r in g.impact(e, s, ["a.ts"], 3).collect()} == {("b.ts", 1), ("c.ts", 2)}
    one = {r.file for r in g.impact(e, s, ["a.ts"], 1).collect()}
    assert one <= {r.file for r in g.impact(e, s, ["a.ts"], 2).collect()}
    empty_s, empty_e = s.limit(0), e.limit(0)
    assert g.impact(empty_e, empty_s, ["a.ts"], 2).count() == 0 and g.outline(empty_s).count() == 0 and g.stats(empty_s, empty_s, empty_e).first().n_edges == 0


def test_nesting_against_pairs(spark):
    import random

    r = random.Random(4)
    rows = []
    for i in range(400):
        a = r.randrange(1, 60)
        rows.append((i, f"n{i}", r.choice(["Class", "Function", "Module", "Type"]), r.choice(["a", "b", "c", None]), a, a + r.randrange(0, 25)))
    rows += [(1000, "z", "Class", "a", None, 4)]
    s = _symbols(spark, rows)
    places = sorted((x for x in rows if x[4] is not None), key=lambda x: (x[4], -x[5], x[0]))
    parent, chain = {}, {}
    for k, x in enumerate(places):
        before = [p for p in places[:k] if p[3] == x[3] and x[3] is not None and p[5] >= x[5]]
        parent[x[0]] = before[-1][0] if before else None
        around = sorted((p[4], p[0], p[1]) for p in places if p[3] == x[3] and x[3] is not None and p[2] in ("Class", "Module") and p[4] < x[4] and p[5] > x[5])
        chain[x[0]] = [n for _, _, n in around]
    got = {x.id: x for x in g.nesting(s).collect()}
    assert {i: x.parent_id for i, x in got.items()} == parent and {i: x.chain for i, x in got.items()} == chain
    for f in ("a", "b", "c", None):
        assert sorted(got[x[0]].ord for x in places if x[3] == f) == list(range(1, 1 + sum(x[3] == f for x in places)))


def test_links_and_changed_files(spark):
    links = spark.createDataFrame([("a", "b", "calls", 1), ("b", "c", "uses", 2), ("c", "a", "uses", 3)], "from_project string, to_project string, type string, n int")
    new = spark.createDataFrame([("a", "b", "calls", 9), ("a", "b", "calls", 9), ("x", "y", "calls", 8)], links.schema)
    assert sorted(map(tuple, g.add_links(links, new).collect())) == [("a", "b", "calls", 9), ("b", "c", "uses", 2), ("c", "a", "uses", 3), ("x", "y", "calls", 8)]
    assert sorted(x.n for x in g.delete_links(links, spark.createDataFrame([("a", "c")], "from_project string, to_project string")).collect()) == [1, 2]
    s, e = _symbols(spark, ROWS), g.clean_edges(spark.createDataFrame(EDGES, EDGE))
    assert {x.file for x in g.diff_impact(e, s, ["a.ts", "b.ts"], keep_changed=True).collect()} == {"a.ts", "b.ts", "c.ts"}
    assert {x.file for x in g.diff_impact(e, s, ["a.ts", "b.ts"]).collect()} == {"c.ts"}


def test_incremental_build_keeps_callers(spark):
    old = _symbols(spark, [(1, "f", "Function", "a.py", 1, 2), (2, "f", "Function", "a.py", 5, 6), (3, "g", "Function", "a.py", 8, 9)])
    new = _symbols(spark, [(10, "f", "Function", "a.py", 3, 4), (11, "h", "Function", "a.py", 8, 9)])
    assert {(r.new_id, r.old_id, r.change) for r in b.reuse_ids(old, new).collect()} == {(10, 1, "keep"), (None, 2, "delete"), (None, 3, "delete"), (11, None, "insert")}


def test_imports(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("src/b/index.ts",), ("src/a/y.js",)], "path string")
    imports = spark.createDataFrame([(1, "src/a/m.ts", "./x", "n"), (2, "src/a/m.ts", "../b", "n"), (3, "src/a/m.ts", "react", "n"), (4, "src/a/m.ts", "./none", "n")], "import_id long, file string, source string, name string")
    assert b.resolve_imports(imports, files).count() == 0
    assert {(r.import_id, r.target) for r in b.resolve_imports(imports, files, normalize=True).collect()} == {(1, "src/a/x.ts"), (2, "src/b/index.ts")}


def test_markdown(spark):
    text = "# One\ntext [a](x.md) [[Page|p]] [b](http://z)\n## Two\n```\n# no\n```\n### Three\n# Four"
    d = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, text string")
    rows = b.markdown_symbols(d).orderBy("line_start").collect()
    assert [(r.line_start, r.line_end, r.level, r.name, r.kind) for r in rows] == [(1, 7, 1, "One", "Class"), (3, 7, 2, "Two", "Class"), (7, 7, 3, "Three", "Type"), (8, 8, 1, "Four", "Class")]
    assert {r.target for r in b.markdown_links(d).collect()} == {"x.md", "Page"}
