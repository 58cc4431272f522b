import os

import pytest

from trellis import pipeline
from trellis.operators import graph as g
from trellis.sources import project
from trellis.sources.parse import PARSERS
from trellis.store import GraphStore

TS = """import { check, Log as Logger } from './util/check';
import * as path from 'path';

/** Keeps accounts. */
export class Bank<T extends object> extends Base implements IBank {
  private log = new Logger("{");

  constructor(private db: Db) {
    super();
    this.log = new Logger();
  }

  // Opens one.
  public async open(name: string, opts: { deep: boolean } = { deep: true }): Promise<Account> {
    if (check(name)) { return this.save(`${name} }`); }
    for (const x of opts.list) { this.log.info(x); }
    return null;
  }

  save = async (a: Account) => {
    store(a);
  };

  private static get size(): number { return 1; }
}

export interface Account {
  name: string;
  close(): void;
}
export enum Color { Red, Green }
type Pair = [string, number];
export const twice = (n: number): number => {
  return n * 2;
};
const plain = 3;
export default async function main() {
  const helper = function inner() { return twice(1); };
  return new Bank(null).open('x');
}
"""

CASES = {
    "typescript": (TS, {("Bank", "Class", 5, 25), ("constructor", "Method", 8, 11), ("open", "Method", 14, 18), ("save", "Method", 20, 22), ("size", "Method", 24, 24), ("Account", "Interface", 27, 30), ("Color", "Type", 31, 31), ("Pair", "Type", 32, 32), ("twice", "Function", 33, 35), ("main", "Function", 37, 40)}),
    "go": ("package a\n\nimport (\n\t\"fmt\"\n\tx \"a/b\"\n)\n\ntype S struct {\n\tn int\n}\n\ntype I interface {\n\tDo()\n}\n\ntype N int\n\n// Do does.\nfunc (s *S) Do() {\n\tfmt.Println(\"}\")\n}\n\nfunc Make() *S { return wrap(&S{}) }\n", {("S", "Class", 8, 10), ("I", "Interface", 12, 14), ("N", "Type", 16, 16), ("Do", "Method", 19, 21), ("Make", "Function", 23, 23)}),
    "rust": ("use crate::a::{b, c as d};\npub struct P<'a> {\n    s: &'a str,\n}\n\npub enum E { A }\n\npub trait T {\n    fn need(&self);\n    fn have(&self) -> char { '}' }\n}\n\nimpl<'a> P<'a> {\n    pub fn new(s: &'a str) -> Self { P { s } }\n}\n\nfn main() {\n    let p = P::new(\"{\");\n    println!(\"x\");\n    p.have();\n}\n", {("P", "Class", 2, 4), ("E", "Type", 6, 6), ("T", "Interface", 8, 11), ("have", "Method", 10, 10), ("have", "Function", 10, 10), ("new", "Method", 14, 14), ("new", "Function", 14, 14), ("main", "Function", 17, 21)}),
    "ruby": ("require_relative 'a/b'\n# Keeps.\nmodule M\n  class K\n    def run(x)\n      if x\n        log.info(x)\n      end\n    end\n\n    def self.make\n      K.new(1)\n    end\n  end\nend\n", {("M", "Module", 3, 15), ("K", "Class", 4, 14), ("run", "Function", 5, 9), ("make", "Function", 11, 13)}),
    "java": ("package a;\nimport a.b.C;\n\npublic class K {\n    private int n;\n\n    public K(int n) {\n        this.n = n;\n    }\n\n    /** Runs. */\n    public <T> List<T> run(final String s) throws X {\n        if (s.isEmpty()) { return help(s); }\n        return new C().go();\n    }\n}\n\ninterface I {\n    void a();\n}\n", {("K", "Class", 4, 16), ("K", "Method", 7, 9), ("run", "Method", 12, 15), ("I", "Interface", 18, 20)}),
}


@pytest.mark.parametrize("language", CASES)
def test_declarations(language):
    text, want = CASES[language]
    symbols, calls, imports = PARSERS[language](text)
    assert {s[:4] for s in symbols} == want and len(symbols) == len(want)


def test_calls_imports_and_odd_texts():
    symbols, calls, imports = PARSERS["typescript"](TS)
    got = {(caller, callee, owner, kind) for caller, callee, owner, _, kind in calls}
    assert {("open", "check", None, "calls"), ("open", "save", "this", "calls"), ("open", "info", "log", "calls"), ("constructor", "Logger", None, "instantiates"), ("save", "store", None, "calls"), ("main", "Bank", None, "instantiates"), ("main", "open", None, "calls")} <= got
    assert [(a, n) for a, n, _ in imports] == [("./util/check", "check"), ("./util/check", "Logger"), ("path", "*")]
    assert {s[0]: s[5] for s in symbols}["open"] == "// Opens one." and {s[0]: s[5] for s in symbols}["Bank"] == "/** Keeps accounts. */"
    assert ("main", "new", "P", "calls") in {(c[0], c[1], c[2], c[4]) for c in PARSERS["rust"](CASES["rust"][0])[1]}
    assert ("make", "new", "K", "instantiates") in {(c[0], c[1], c[2], c[4]) for c in PARSERS["ruby"](CASES["ruby"][0])[1]}
    for parser in PARSERS.values():
        for text in ("", "{{{{", "}}}}", "class", "func (", "\x00 é {", "'" * 50, "class A {" * 300, "def x\n" * 50):
            parser(text)


FILES = {
    "src/bank.ts": TS,
    "src/util/check.ts": "export function check(s: string) {\n  return s.length > 1;\n}\nexport class Logger {\n  info(m: string) {\n    console.log(m);\n  }\n}\n",
    "src/app.py": "from bank import open\n\ndef start():\n    open(1)\n    stop()\n\ndef stop():\n    pass\n",
    "node_modules/x.js": "function no() {}",
}


def _write(root, files):
    for path, text in files.items():
        at = os.path.join(root, path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "w") as f:
            f.write(text)


def test_build_and_rebuild(spark, tmp_path, monkeypatch):
    root, store = str(tmp_path / "p"), GraphStore(spark, f"file://{tmp_path}/graph")
    _write(root, FILES)
    assert pipeline.build(spark, root, store) == {"changed": 3, "removed": 0, "files": 3}
    s, e = store.read("symbols"), store.read("edges")
    named = lambda e, s: {(r.a, r.b, r.kind, r.confidence) for r in e.join(s.selectExpr("id as from_id", "name as a"), "from_id").join(s.selectExpr("id as to_id", "name as b"), "to_id").collect()}
    edges = named(e, s)
    assert {("open", "check", "calls", 1.0), ("open", "save", "calls", 1.0), ("start", "stop", "calls", 1.0), ("open", "info", "calls", 0.3), ("constructor", "Logger", "instantiates", 1.0), ("main", "Bank", "instantiates", 1.0)} <= edges
    assert ("start", "open", "calls", 0.5) in edges and not any(b == "console" for _, b, _, _ in edges)
    assert {r.name for r in g.callers(e, s, "check").collect()} >= {"open"}
    before = {(r.file, r.name, r.kind): r.id for r in s.collect()}
    assert pipeline.build(spark, root, store) == {"changed": 0, "removed": 0, "files": 3}
    assert named(store.read("edges"), store.read("symbols")) == edges
    _write(root, {"src/util/check.ts": "// moved\n\n" + FILES["src/util/check.ts"].replace("class Logger", "class Journal")})
    os.remove(os.path.join(root, "src/app.py"))
    assert pipeline.build(spark, root, store) == {"changed": 1, "removed": 1, "files": 2}
    after = {(r.file, r.name, r.kind): r.id for r in store.read("symbols").collect()}
    check = ("src/util/check.ts", "check", "Function")
    assert after[check] == before[check] and ("src/util/check.ts", "Logger", "Class") not in after and not any(f == "src/app.py" for f, _, _ in after)
    now = named(store.read("edges"), store.read("symbols"))
    assert ("open", "check", "calls", 1.0) in now and not any("Logger" in x[:2] or "start" in x[:2] for x in now)
    # an unreadable folder keeps what it had, an unreadable root changes nothing
    real = os.scandir
    monkeypatch.setattr(project.os, "scandir", lambda p: real(p) if not str(p).endswith("util") else (_ for _ in ()).throw(PermissionError(p)))
    assert pipeline.build(spark, root, store) == {"changed": 0, "removed": 0, "files": 2}
    version = store.version
    monkeypatch.setattr(project.os, "scandir", lambda p: (_ for _ in ()).throw(PermissionError(p)))
    with pytest.raises(PermissionError):
        pipeline.build(spark, root, store)
    assert store.version == version and not (tmp_path / "graph" / "lock").exists()
