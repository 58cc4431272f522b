import os

from trellis.sources.parse import parse_files
from trellis.sources.project import list_files, read_indexed, read_json_lines, read_project


def _write(root, files):
    for name, body in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)


SERVICE = '''from .log import info as say


class Service:
    """Keeps things."""

    def make(self, a):
        """Make one."""
        say(a)
        return self._store(a)

    def _store(self, a):
        return a


def main():
    Service().make(1)
'''


def test_walk_and_parse(spark, tmp_path):
    _write(tmp_path, {"src/service.py": SERVICE, "src/log.py": "def info(x):\n    pass\n", "node_modules/x.js": "1", ".hidden/a.py": "1", "made/a.py": "1", "made/keep/b.py": "1", "a.tmp.py": "1", "sub/.gitignore": "/c.py\nd/\n", "sub/c.py": "1", "sub/x/c.py": "1", "sub/d/e.py": "1", ".gitignore": "*.tmp.py\nmade/*\n!made/keep\n# no\n", "readme.txt": "x", "min.js": "x" * 6000})
    os.symlink(tmp_path / "src/log.py", tmp_path / "link.py")
    os.symlink("/etc/passwd", tmp_path / "evil.py")
    assert list_files(str(tmp_path)) == ["link.py", "made/keep/b.py", "min.js", "readme.txt", "src/log.py", "src/service.py", "sub/x/c.py"]
    files = read_project(spark, str(tmp_path)).cache()
    assert {r.path for r in files.collect()} == {"link.py", "made/keep/b.py", "src/log.py", "src/service.py", "sub/x/c.py"}
    assert read_indexed(files, str(tmp_path), "src/log.py") == "def info(x):\n    pass\n"
    assert read_indexed(files, str(tmp_path), "../x.py") is None and read_indexed(files, str(tmp_path), "readme.txt") is None
    symbols, calls, imports = parse_files(files.filter("path = 'src/service.py'"))
    assert [(r.name, r.kind, r.line_start, r.line_end) for r in symbols.orderBy("line_start", "kind").collect()] == [
        ("Service", "Class", 4, 13), ("make", "Function", 7, 10), ("make", "Method", 7, 10), ("_store", "Function", 12, 13), ("_store", "Method", 12, 13), ("main", "Function", 16, 17),
    ]
    assert {(r.caller, r.callee, r.receiver) for r in calls.collect()} == {("make", "say", None), ("make", "_store", "self"), ("main", "make", "Service()"), ("main", "Service", None)}
    assert [(r.source, r.name, r.line) for r in imports.collect()] == [(".log", "say", 1)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"id": "a", "n": 1}\n\nnot json\n{"id": "b"}\n')
    rows = read_json_lines(spark, str(tmp_path / "m.jsonl"), "id string, n long").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("a", 1), ("b", None)]
