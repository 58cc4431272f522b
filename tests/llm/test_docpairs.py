import pytest

from trellis.llm.docpairs import describe, doc_pairs, documentation
from trellis.llm.peg import ahead, first, many, parse, ref, rx, seq, span


def test_packrat_is_linear_and_exact():
    calls = []

    def counted(run, pos):
        calls.append(pos)
        return rx("a")(run, pos)

    rules = {"A": counted, "S": first(seq(many(ref("A")), rx("x")), seq(many(ref("A")), rx("y")), seq(many(ref("A")), ahead(rx("$"))))}
    assert parse(rules, "S", "a" * 50) is not None
    assert len(calls) == 51  # each position once, though three alternatives pass over it
    assert parse({"S": seq(span("n", rx(r"\d+")), ref("S2")), "S2": first(seq(rx("-"), ref("S")), rx("$"))}, "S", "12-3") == [("n", 0, 2), [[("n", 3, 4)]]]


@pytest.mark.parametrize(
    "file, text, docs, code",
    [
        ("a.ts", "/** One. */\n// two\nfunction f(a) {\n // no\n}", ["/** One. */", "// two"], "function f(a) {\n // no\n}"),
        ("a.rs", "  /// x\r\n  #[inline]\r\n  fn f() {}", ["/// x"], "fn f() {}"),
        ("a.py", "# lead\n@cached(1)\ndef f(a=')', b: int = (1, 2)) -> str:\n    '''Doc: it's.'''\n    return 1", ["# lead", "'''Doc: it's.'''"], None),
        ("a.py", "def f(a):\n    'x'.join(a)\n", [], None),
        ("a.py", 'async def f(self):\n\n    """open', ['"""open'], None),
        ("a.rb", "=begin\nhi\n=end\ndef f\nend", ["=begin\nhi\n=end"], "def f\nend"),
        (None, "-- sql\ncreate function", ["-- sql"], "create function"),
        ("a.go", "", [], ""),
    ],
)
def test_grammars(file, text, docs, code):
    got = documentation(text, file)
    assert [text[a:b] for a, b in got["docs"]] == docs
    if code is not None:
        assert text[slice(*got["code"])] == code


REAL = [
    "Returns the open TODO entries of a session, newest first.",
    "/**\n * Emits the header of a generated file and tells how many bytes were written.\n * @param x\n */",
    "Deprecated callers still come through here, so keep accepting a bare string as the key.",
    "# noqa: E501\n# Looks up the author of a commit and falls back to the branch owner.",
    "La table des symboles renvoie les titres des notes.\nTODO: revisit once the store is shared.",
    "Compares two lists of edges by age.",
    "ファイルの一覧を新しい順に返します。",
]
EMPTY = [
    "", "/** */", "// ~~~~~~~~", "TODO", "FIXME: write real documentation for this once the interface has settled down.", "See {@link other} for more about it all.",
    "This method will load a row batch", "@param {string} a\n@returns {void}", "Args:\n    a\n    b\nReturns:", "Copyright the project authors. All rights reserved.\nUse is subject to the terms in the licence file.",
    "Author: graph team\nSince: 0.9", "// const key = load(next); return key;", "if (buf == null) { return key; }", "for x in out: print(x)", "eslint-disable-next-line no-unused-vars, no-console, no-undef, no-eval",
    "loads the row", "Generated by the scaffold tool, replace with your own text.", "à documenter",
]


@pytest.mark.parametrize("text", REAL)
def test_real(text):
    assert describe(text, "load_row_batch", "def load_row_batch(a, b)")[1]


@pytest.mark.parametrize("text", EMPTY)
def test_not_real(text):
    assert not describe(text, "load_row_batch", "def load_row_batch(a, b)")[1]


def test_table(spark):
    real = "Drops the rows that carry no owner."
    rows = [
        (1, "f", "Method", "a.py", 3, "def f()", real, "def f(): pass"),
        (2, "f", "Function", "a.py", 3, "def f()", real, "def f(): pass"),
        (3, "g", "FUNCTION", None, None, None, "  ", f"# {real}\ndef g(): pass"),
        (4, "h", "Class", "a.py", 1, "", real, "class h"),
        (5, "i", "method", "a.py", 1, "", real, None),
        (6, "j", "Method", "a.py", 9, "", real, "  "),
        (7, None, "Method", "a.ts", 9, None, None, f"/* {'x' * 300000} {real} */ f() {{}}"),
        (None, "k", "Method", "a.ts", 99, None, real, "k() {}"),
        (8, "l", None, "a.ts", 98, None, real, "l() {}"),
    ]
    df = spark.createDataFrame(rows, "id long, name string, kind string, file string, line_start long, signature string, doc string, content string")
    got = {r.symbol_id: r for r in doc_pairs(df).collect()}
    assert set(got) == {1, 3, 7}
    assert got[3].description == real and got[3].source == "comment" and rows[2][7][got[3].doc_start : got[3].doc_end] == f"# {real}"
    assert doc_pairs(df.limit(0)).count() == 0
