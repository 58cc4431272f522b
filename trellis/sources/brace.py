"""Reading of languages with braces, and of Ruby, by their declarations.

Strings and comments are blanked out first, so that braces pair up in one pass over the text; a table for each language
tells what begins a declaration, and its body reaches to the brace that closes it.  Calls belong to the innermost function
around them.  Everything is linear in the text but for the sorting of declarations.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable

_NO_CODE = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"\"\"[\s\S]*?(?:\"\"\"|\Z)|\"(?:[^\"\\\n]|\\.)*\"|`(?:[^`\\]|\\[\s\S])*`|'(?:[^'\\\n]|\\.)'|'(?:[^'\\\n]|\\.)*'")
_NO_RUST = re.compile(r"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|r(#*)\"[\s\S]*?\"\1|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\\n]|\\.[^'\n]{0,8})'")
_NO_RUBY = re.compile(r"^=begin\b[\s\S]*?(?:^=end[^\n]*|\Z)|#[^\n]*|\"(?:[^\"\\]|\\[\s\S])*\"|'(?:[^'\\]|\\[\s\S])*'", re.M)
_WORD = r"[A-Za-z_$][\w$]*"
_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|virtual|async|readonly|export|default|declare|data|partial|inline|suspend|fileprivate|unsafe|synchronized|native|case|implicit|lazy|const|extern|factory)\s+)*"
_KEYWORDS = frozenset("if for while switch catch return function func fn def class await async typeof sizeof match when unless elsif until and or not in of do else try super defer go yield throw raise assert import require use let var const self this constructor".split())
#: Words that begin a statement with a bracket, and so look like a method.
_CONTROL = frozenset("if for while switch catch return function func fn else do try match when unless".split())
_CALL = re.compile(rf"(?:(\bnew)\s+)?(?:({_WORD}|\)|\])\s*(?:\?\.|\.|::|->)\s*)?(?<![\w$])({_WORD})\s*(?:::\s*<[^<>()]*>|<[\w\s,.\[\]]*>)?(!?)\(")

Decl = tuple[str, re.Pattern, bool]  # kind, pattern with the name as group 1, only in the body of a container


def _rows(*rows: tuple) -> list[Decl]:
    return [(r[0], re.compile(r"^[ \t]*" + r[1], re.M), len(r) > 2) for r in rows]


_TYPED_METHOD = _MODS + r"(?:<[^<>()]*>\s*)?[\w$<>\[\],.?]+(?:\s*[*&])?\s+[*&]?(" + _WORD + r")\s*\([^;{}]*\)[^;{}=]*(?=\{)"
_SCRIPT = _rows(
    ("Class", _MODS + rf"class\s+({_WORD})"), ("Interface", _MODS + rf"interface\s+({_WORD})"), ("Type", _MODS + rf"(?:enum|type)\s+({_WORD})(?=[^\n]*[={{])"),
    ("Function", _MODS + rf"function\s*\*?\s+({_WORD})"), ("Function", _MODS + rf"(?:let|var)?\s*({_WORD})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:\([^()]*\)|{_WORD})\s*(?::[^=\n{{]+)?=>(?=\s*\{{)"),
    ("Method", _MODS + rf"(?:(?:get|set)\s+)?\*?(#?{_WORD})\s*(?:<[^<>()]*>)?\((?:[^(){{}}]|\([^()]*\)|\{{[^{{}}]*\}})*\)\s*(?::[^{{;\n]+(?:\{{[^{{}}]*\}}[^{{;\n]*)?)?(?=\{{)", True),
)
_TYPED = _rows(
    ("Class", _MODS + rf"(?:class|struct|record|object)\s+({_WORD})"), ("Interface", _MODS + rf"@?(?:interface|trait|protocol)\s+({_WORD})"), ("Type", _MODS + rf"enum\s+(?:class\s+)?({_WORD})"), ("Module", _MODS + rf"(?:namespace)\s+([\w.:]+)(?=\s*\{{)"),
    ("Function", _MODS + rf"(?:fun|func|function|def)\s+(?:<[^<>()]*>\s*)?(?:[\w<>]+\.)?({_WORD})"), ("Method", _TYPED_METHOD, True), ("Method", _MODS + rf"({_WORD})\s*\([^;{{}}()]*\)[^;{{}}=()]*(?=\{{)", True), ("Function", _TYPED_METHOD),
)
DECLARATIONS: dict[str, list[Decl]] = {
    **dict.fromkeys(("typescript", "javascript"), _SCRIPT),
    "go": _rows(("Method", rf"func\s+\([^()]*\)\s*({_WORD})"), ("Function", rf"func\s+({_WORD})"), ("Class", rf"type\s+({_WORD})(?:\[[^\]]*\])?\s+struct\b"), ("Interface", rf"type\s+({_WORD})(?:\[[^\]]*\])?\s+interface\b"), ("Type", rf"type\s+({_WORD})\s+=?\s*(?!struct\b|interface\b)[\w\[\]*.(]")),
    "rust": _rows(
        ("Class", rf"(?:pub(?:\([^)]*\))?\s+)?(?:struct|union)\s+({_WORD})"), ("Interface", rf"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+({_WORD})"), ("Type", rf"(?:pub(?:\([^)]*\))?\s+)?(?:enum|type)\s+({_WORD})"), ("Module", rf"(?:pub(?:\([^)]*\))?\s+)?mod\s+({_WORD})(?=\s*\{{)"),
        ("impl", rf"(?:unsafe\s+)?impl\b[^{{;]*?({_WORD})(?:<[^{{]*)?(?=\s*(?:where[^{{]*)?\{{)"), ("Function", rf"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\S+\s+)?fn\s+({_WORD})"),
    ),
    **dict.fromkeys(("java", "csharp", "kotlin", "scala", "swift", "php", "dart", "c", "cpp", "objc"), _TYPED),
}
CONTAINERS = ("Class", "Interface", "impl", "Type")
IMPORTS: dict[str, list[re.Pattern]] = {
    **dict.fromkeys(("typescript", "javascript"), [re.compile(r"^\s*(?:import|export)\s+(?:type\s+)?(?P<names>[^;'\"]*?)\s+from\s+['\"](?P<source>[^'\"\n]+)['\"]", re.M), re.compile(r"(?:const|let|var)\s+(?P<names>[^=;]+?)\s*=\s*require\(\s*['\"](?P<source>[^'\"\n]+)['\"]")]),
    "rust": [re.compile(r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+?)::(?P<names>\{[^{}]*\}|\w+|\*)(?:\s+as\s+\w+)?\s*;", re.M)],
    "go": [re.compile(r"^\s*(?:import\s+)?(?P<names>[\w.]+\s+)?\"(?P<source>[\w./-]+)\"\s*$", re.M)],
    **dict.fromkeys(("java", "kotlin", "scala", "csharp"), [re.compile(r"^\s*(?:import|using)\s+(?:static\s+)?(?P<source>[\w.]+)\.(?P<names>[\w*]+)\s*;?\s*$", re.M)]),
    **dict.fromkeys(("c", "cpp", "objc"), [re.compile(r"^\s*#\s*(?:include|import)\s*[\"<](?P<source>[^\">\n]+)(?P<names>)[\">]", re.M)]),
    "ruby": [re.compile(r"^\s*require(?:_relative)?\s*\(?\s*['\"](?P<source>[^'\"\n]+)(?P<names>)['\"]", re.M)],
}


def _blank(text: str, pattern: re.Pattern) -> str:
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _pairs(code: str) -> dict[int, int]:
    """Offset of the closing brace of each opening one; one that nothing closes reaches to the end."""
    open_, out = [], {}
    for m in re.finditer(r"[{}]", code):
        if m.group() == "{":
            open_.append(m.start())
        elif open_:
            out[open_.pop()] = m.start()
    return out | {a: max(len(code) - 1, 0) for a in open_}


def _doc(lines: list[str], first: int) -> str | None:
    """Comment lines directly above a declaration."""
    at = first - 2
    while at >= 0 and re.match(r"\s*(?://|/\*|\*|#(?!\[|include|define|if|end))", lines[at]):
        at -= 1
    found = "\n".join(s.strip() for s in lines[at + 1 : first - 1])
    return found or None


def _names(text: str) -> list[str]:
    """Names that an import binds: ``a, { b as c, d }``, ``* as e``."""
    parts = re.split(r"[,{}]", text)
    out = [re.split(r"\s+as\s+|\s*:\s*", p.strip())[0 if p.strip().startswith("*") else -1] if " as " in p or ":" in p else p.strip() for p in parts]
    return [re.sub(r"^type\s+", "", p) for p in out if p]


def _lay_out(text: str, code: str, found: list[tuple[int, int, int, str, str]], language: str) -> tuple[list, list, list]:
    """Symbols, calls and imports of declarations ``(start, end, name offset, kind, name)``."""
    starts = [0, *(m.end() for m in re.finditer("\n", text))]
    line = lambda at: bisect_right(starts, at)
    lines = text.split("\n")
    found.sort(key=lambda d: (d[0], -d[1]))
    symbols, functions, open_ = [], [], []
    for a, b, at, kind, name in found:
        while open_ and open_[-1][1] < a:
            open_.pop()
        around = open_[-1] if open_ else None
        open_.append((a, b, kind))
        if kind == "impl":
            continue
        signature = lines[line(at) - 1].strip().rstrip("{").rstrip()
        kinds = ("Method", "Function") if language == "rust" and kind == "Function" and around and around[2] in ("impl", "Interface") else (kind,)
        if language not in ("rust", "ruby", "go") and kind == "Function" and around and around[2] in CONTAINERS:
            kinds = ("Method",)
        symbols += [(name, k, line(a), line(b), signature, _doc(lines, line(a))) for k in kinds]
        if kind in ("Function", "Method"):
            functions.append((a, b, name))
    decls = {at for _, _, at, _, _ in found}
    calls, open_, k = [], [], 0
    for m in _CALL.finditer(code):
        at = m.start(3)
        while k < len(functions) and functions[k][0] <= at:
            open_.append(functions[k])
            k += 1
        while open_ and open_[-1][1] < at:
            open_.pop()
        if at in decls or m.group(3) in _KEYWORDS or m.group(4) or not open_:
            continue
        owner = m.group(2) if m.group(2) not in (")", "]") else None
        kind = "instantiates" if m.group(1) or (language == "ruby" and m.group(3) == "new") else "calls"
        calls.append((open_[-1][2], m.group(3), owner, line(at), kind))
    imports = [(m.group("source"), name, line(m.start("source"))) for p in IMPORTS.get(language, []) for m in p.finditer(text) for name in _names(m.group("names") or "") or [re.split(r"[/.]", m.group("source"))[-1]]]
    return symbols, calls, imports


def parse_braces(text: str, language: str):
    code = _blank(text, _NO_RUST if language == "rust" else _NO_CODE)
    pairs = _pairs(code)
    opens = sorted(pairs)
    found: dict[int, tuple[int, int, int, str, str]] = {}
    inner: list[tuple[int, int, int, str, str]] = []
    for kind, pattern, nested in DECLARATIONS[language]:
        for m in pattern.finditer(code):
            at, name = m.start(1), m.group(1)
            if name in _CONTROL or at in found:
                continue
            start = m.start() + len(m.group()) - len(m.group().lstrip())
            k = bisect_right(opens, m.end() - 1)
            body = opens[k] if k < len(opens) else None
            stop = re.compile(r";|\n[ \t]*\n").search(code, m.end())
            if body is None or (stop and stop.start() < body):  # no body
                end = code.find("\n", m.end())
                end = len(code) - 1 if end < 0 else end - 1
                if kind in ("Function", "Method", "impl"):
                    continue
            else:
                end = pairs[body]
            row = (start, end, at, kind, name)
            if nested:
                inner.append(row)
            else:
                found[at] = row
    holders = sorted((r for r in found.values() if r[3] in CONTAINERS), key=lambda r: r[0])
    depth_of = [0]
    marks = [m.start() for m in re.finditer(r"[{}]", code)]
    for at in marks:
        depth_of.append(depth_of[-1] + (1 if code[at] == "{" else -1))
    depth = lambda at: depth_of[bisect_right(marks, at)]
    begins = [r[0] for r in holders]
    for row in inner:  # directly in the body of a container
        k = bisect_right(begins, row[0]) - 1
        while k >= 0 and holders[k][1] < row[0]:
            k -= 1
        if k >= 0 and depth(row[0]) == depth(holders[k][0]) + 1 and row[2] not in found:
            found[row[2]] = row
    return _lay_out(text, code, list(found.values()), language)


_RUBY = re.compile(r"^([ \t]*)(?:(class|module)\s+([\w:]+)|def\s+(?:self\.)?([\w]+[?!=]?))", re.M)


def parse_ruby(text: str):
    """Bodies reach to the ``end`` that is indented like their beginning."""
    code = _blank(text, _NO_RUBY)
    found = []
    ends: dict[str, list[int]] = {}
    for m in re.finditer(r"^([ \t]*)end\b", code, re.M):
        ends.setdefault(m.group(1), []).append(m.end() - 1)
    for m in _RUBY.finditer(code):
        closing = ends.get(m.group(1), [])
        k = bisect_right(closing, m.end())
        end = closing[k] if k < len(closing) else code.find("\n", m.end()) if "\n" in code[m.end() :] else len(code) - 1
        kind = {"class": "Class", "module": "Module"}.get(m.group(2), "Function")
        found.append((m.start() + len(m.group(1)), end, m.start(3) if m.group(3) else m.start(4), kind, m.group(3) or m.group(4)))
    return _lay_out(text, code, found, "ruby")


PARSERS: dict[str, Callable] = {**{lang: (lambda text, lang=lang: parse_braces(text, lang)) for lang in DECLARATIONS}, "ruby": parse_ruby}
