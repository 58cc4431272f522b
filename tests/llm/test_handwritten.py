import hashlib
import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from trellis.llm.handwritten import SKETCH, _chains, closing, clusters, core, jaccard, layout, literal_share, masked, not_handwritten, sketch

R = random.Random(2)


def code(n, seed):
    r = random.Random(seed)
    line = lambda: r.choice([f"let w{r.random()} = {'abcde'[r.randrange(5)]}call(x{r.randrange(99)});", f"if (a{r.randrange(99)} > {r.randrange(999)}) {{ return b; }}", f"for (const k of q{r.randrange(9)}) {{ use(k, 'text'); }}", f"obj.{r.choice('xyz')}[{r.randrange(99)}] += 1;"])
    return "\n".join(line() for _ in range(n)) + "\n"


def test_core_and_masks():
    assert core("/* a */\n// b\n\nx = 1\n") == ("/* a */\n// b\n\n", "x = 1")
    assert core("// only") == ("", "// only") and core("") == ("", "")
    assert (masked("foo('a', 1) # c\n") == masked('bar("b//", 22)')).all()
    a, b = sketch(masked(code(60, 1))), sketch(masked(code(60, 1).replace("call", "other")))
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_jaccard_of_small_sets_is_exact():
    def low(values):
        out = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
        out[: len(values)] = sorted(values)
        return out

    pairs = [(set(range(50)), set(range(10, 60))), ({1}, {2}), ({1, 2}, {1, 2}), (set(), {1})]
    got = jaccard(np.stack([low(a) for a, _ in pairs]), np.stack([low(b) for _, b in pairs]))
    assert got.tolist() == [len(a & b) / len(a | b) for a, b in pairs]


def test_layout():
    assert layout(code(60, 1))[1:] == (0.0, 0.0) and layout("") == (0, 0.0, 0.0)
    assert layout("\n".join(f"  get{i}() {{ return this.f[{i}]; }}" for i in range(40)))[1] == 1
    assert layout(code(40, 3) + "const t = '" + "long text, " * 400 + "';")[2] == 0
    assert layout("a=b(c);d.e=f||{g:1};if(!h){i=j[k]}" * 60)[2] == 1


def test_literal_shingles():
    assert literal_share(masked("X = [\n" + "  1, -2, 0x3f, 'four', null,\n" * 30 + "]")) > 0.9
    assert literal_share(masked(code(60, 1))) < 0.1 and literal_share(masked("1")) == literal_share(masked("")) == 0
    assert literal_share(masked("[{(,)}] " * 40)) == 0  # no literal


def test_closing_notice():
    assert closing("x = 1\n# a\n\n/* b\n * c\n */\n") == "# a\n\n/* b\n * c\n */\n" and closing("# only") == closing("") == ""
    assert closing("a\nb // not this").strip() == ""


CASES = {
    "generated by path": ("packages/a/src/generated/x.ts", code(30, 1), "generated"),
    "generated by notice": ("packages/a/src/x1.py", "# Copyright the a authors.\n\n# Code generated by t. DO NOT EDIT.\n\n" + code(30, 2), "generated"),
    "generated by closing notice": ("packages/a/src/x5.ts", code(30, 12) + "\n/*\n * Code generated by t. DO NOT EDIT.\n */\n", "generated"),
    "numbered": ("packages/a/src/x2.ts", "import x\n" + "".join(f"  case S{i}: return next({i});\n" for i in range(40)), "generated"),
    "minified by path": ("lib/a/x.min.js", "var a=1", "minified"),
    "minified by text": ("lib/a/x3.js", "a=b(c);d.e=f||{g:1};if(!h){i=j[k]}" * 60, "minified"),
    "vendored": ("vendor/q/x.go", "// Origin: q (1.2.3), imported without changes\n" + code(30, 4), "vendored"),
    "copy": ("services/b/y.go", code(30, 4).strip(), "vendored"),
    "blob": ("apps/c/app/t.py", "# lookup values\nX = [\n" + "  1, 2, 3,\n" * 40 + "]\n", "blob"),
    "hand": ("apps/c/app/h.ts", "/* This file is not generated; edit it freely. */\n" + code(30, 5), None),
    "hand 2": ("apps/c/app/vendor_portal/h.ts", '/* Copyright the c authors. */\nconst MARK = "@generated";\n' + code(30, 6), None),
    "hand 3": ("apps/c/app/generated_names_check/h.ts", "/** Auto-generated method stub. */\nfunction f() {}\n" + code(30, 7) + "const T = [\n 1, 2,\n 3, 4,\n];\n", None),
    "empty": ("apps/c/app/e.ts", "", None),
    "null": ("apps/c/app/n.ts", None, None),
    "null in vendor": ("third_party/c/n.ts", None, "vendored"),
}


def test_cases(spark):
    files, texts, want = [], [], {}
    for i, (name, (path, body, kind)) in enumerate(CASES.items()):
        files.append((i, path, "x", name))
        texts.append((i, body, "clash"))
        want[name] = kind
    for j in range(4):  # a family: one template, other names, no notice
        files.append((100 + j, f"packages/fam/src/f{j}.ts", "x", f"family {j}"))
        texts.append((100 + j, code(40, 9).replace("call", f"call{chr(97 + j)}"), "clash"))
        want[f"family {j}"] = "generated"
    files += files[:3]
    texts += texts[:3]
    f = spark.createDataFrame(files, "id long, path string, text string, name string")
    t = spark.createDataFrame(texts, "file_id long, body string, path string")
    rows = not_handwritten(f, t).collect()
    names = {i: n for i, _, _, n in files}
    got = {names[r.file_id]: [k for k in ("generated", "minified", "vendored", "blob") if r[k]] for r in rows}
    assert len(rows) == len(got)
    assert {n: got.get(n, [None])[0] for n in want} == want
    assert not_handwritten(f.limit(0), t.limit(0)).count() == 0


def test_every_similar_pair_of_a_band_is_linked(spark):
    r, rows, sets = random.Random(5), [], {}
    for i in range(60):  # chains within one band, whose least member "00" is like none of the others
        sets[f"{i:02}"] = set(range(900, 1000)) if i == 0 else set(range(10 * (i // 6), 10 * (i // 6) + 100)) - set(r.sample(range(500), 8))
    sets["61"] = set(sets["07"])
    for text, values in sets.items():
        low = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
        low[: len(values)] = sorted(values)
        rows.append((text, "07" if text == "61" else text, 50, [1], low.tobytes(), len(values)))
    parent = {t: t for t in sets}
    find = lambda t: t if parent[t] == t else find(parent[t])
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(rows, "text string, order string, n_tokens long, bands array<long>, low binary, size long")
    for cap in (4096, 9):
        got = {t: c for t, c in clusters(df, cap=cap).collect()}
        assert got == {t: find(t) for t in sets} and got["00"] == "00"


def test_short_copies(spark):
    f = spark.createDataFrame([(1, "deps/q-1.0/x.java"), (2, "apps/c/app/x.java"), (3, "deps/q-1.0/e.java"), (4, "apps/c/app/e.java")], "id long, path string")
    t = spark.createDataFrame([(1, "// Copyright q\ninterface X {\n}\n"), (2, "interface X {\n}"), (3, ""), (4, "\n")], "file_id long, body string")
    assert {r.file_id for r in not_handwritten(f, t).collect() if r.vendored} == {1, 2, 3}


def test_families_are_counted_exactly(spark):
    bodies = [code(40, 9).replace("call", f"call{i}") for i in range(400)]
    digests = [(i, hashlib.blake2b(core(b)[1].encode(), digest_size=16).hexdigest()) for i, b in enumerate(bodies)]
    register = dict(spark.createDataFrame(digests, "i int, text string").select("i", F.shiftrightunsigned(F.xxhash64("text"), 52)).collect())
    a, b = next(p for p in combinations(register, 2) if register[p[0]] == register[p[1]])  # a sketch counts these as one
    three = [a, b, next(i for i in register if i not in (a, b))]
    f = spark.createDataFrame([(i, f"packages/fam/src/f{i}.ts") for i in three], "id long, path string")
    t = spark.createDataFrame([(i, bodies[i]) for i in three], "file_id long, body string")
    assert sorted(r.file_id for r in not_handwritten(f, t).collect() if r.generated) == sorted(three)


def test_the_clusters_decide(spark):
    files, texts = [(1, "vendor/q/x.go"), (2, "services/b/y.go")], [(1, code(30, 4)), (2, code(30, 4).strip())]
    crud = "".join(f"export class {w} extends Row<{w}> {{\n  static {v}: {w}[] = [];\n  async {v}(row: Row) {{ return (await this.db.{v}<{w}>(row)) || super.{v}(row); }}\n}}\n" for w, v in [("Acct", "load"), ("Team", "save"), ("Plan", "drop"), ("Seat", "find")])
    for j in range(6):  # one template in several folders; two of the files do not say so
        files.append((10 + j, f"packages/p{j}/src/f{j}.ts"))
        texts.append((10 + j, "// Code generated by t. DO NOT EDIT.\n" * (j < 4) + crud.replace("Row", f"Row{chr(97 + j)}") + f"let z = {j};\n" * (j % 3)))
    files += [(20, "apps/c/h1.ts"), (21, "apps/d/h2.ts")]  # alike, by hand
    texts += [(20, code(60, 30)), (21, code(60, 30) + "let z = 1;\n")]
    f, t = spark.createDataFrame(files, "id long, path string"), spark.createDataFrame(texts, "file_id long, body string")
    assert {r.file_id for r in not_handwritten(f, t).collect()} == {1, 2, *range(10, 16)}
    alone = lambda profile: profile.select("text").distinct().withColumn("cluster", F.col("text"))
    assert {r.file_id for r in not_handwritten(f, t, group=alone).collect()} == {1, 2, 10, 11, 12, 13}
    one = lambda profile: profile.select("text").distinct().withColumn("cluster", F.lit("c"))
    got = {r.file_id for r in not_handwritten(spark.createDataFrame(files + [(30, "apps/c/t.py")], f.schema), spark.createDataFrame(texts + [(30, "X = [\n" + "  1, 2, 3,\n" * 40 + "]\n")], t.schema), group=one).collect()}
    assert 30 not in got


def test_ways_of_counting_agree():
    r, rows = np.random.default_rng(3), []
    base = r.integers(0, 1 << 31, (5, 400)).astype(np.uint32)
    for i in range(60):
        one = base[i % 5].copy()
        one[r.integers(0, 400, r.integers(0, 60))] = r.integers(0, 1 << 31, 1)
        rows.append((np.unique(one)[:SKETCH], len(np.unique(one))))
    low, size = np.stack([x for x, _ in rows]), np.array([n for _, n in rows])
    parts = []
    for dense in (0, 1 << 40):
        head = np.arange(60)
        for i, near in _chains(low, size, 0.8, dense):
            head[np.isin(head, head[near])] = head[i]
        parts.append({frozenset(np.flatnonzero(head == h).tolist()) for h in head})
    assert parts[0] == parts[1] and len(parts[0]) >= 5
