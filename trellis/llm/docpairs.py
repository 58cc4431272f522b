"""Functions paired with their documentation.

Method: a parsing-expression grammar for each family of languages (see ``peg``) reads the comments that open a function,
its header and, in Python, the string that opens the body, and keeps the offsets of all of them.  Its semantic action
emits the pair of code and documentation.  A second grammar-free step then judges whether the description says anything.

The description is ``doc``; only where that has no words it is what the grammar found inside ``content``.  Either is read by
a grammar of remarks, which parts comment marks from text line by line.

Defined results: rows of another kind or without content give nothing; a null name, file or signature counts as empty;
of rows with the same file, name and line_start (nulls alike) the smallest id counts; an unknown file type is read with
the comment marks of all families.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.llm.peg import act, ahead, first, many, maybe, parse, ref, rx, seq, span

# ---------------------------------------------------------------- grammars


def _pair(text: str, value: object) -> dict:
    spans = [x for x in _flat(value) if isinstance(x, tuple)]
    docs = [(a, b) for kind, a, b in spans if kind in ("comment", "docstring")]
    code = next(((a, b) for kind, a, b in spans if kind == "header"), (0, len(text)))
    return {"docs": docs, "kinds": [k for k, _, _ in spans if k != "header"], "code": (code[0], len(text))}


def _flat(value: object) -> Iterator:
    if isinstance(value, list):
        for x in value:
            yield from _flat(x)
    elif value is not None:
        yield value


_SLASH = rx(r"//[^\r\n]*")
_BLOCK = rx(r"/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)")
_HASH = rx(r"#(?!\[)[^\r\n]*")
_RUBY_BLOCK = rx(r"=begin\b[\s\S]*?(?:\n=end[^\n]*|\Z)")
_DASHES = rx(r"--[^\r\n]*")
_STRING = first(rx(r"[rRbBuUfF]{0,2}\"\"\"[\s\S]*?(?:\"\"\"|\Z)"), rx(r"[rRbBuUfF]{0,2}'''[\s\S]*?(?:'''|\Z)"), rx(r"[rRuUbB]?\"(?:[^\"\\\n]|\\.)*\""), rx(r"[rRuUbB]?'(?:[^'\\\n]|\\.)*'"))
_GAP = rx(r"[ \t\r\n\f\ufeff]+")
_ATTRIBUTE = rx(r"(?:#!?\[[^\n]*\]|@[\w.]+(?:\([^\n]*\))?)[ \t]*(?=\r?\n)")
_HEADER = rx(r"[^\r\n]+")
_PY_HEADER = rx(r"[ \t]*(?:async[ \t]+)?(?:def|class)\b[^\n(:]*(?:\((?:[^()\"']|\"[^\"\n]*\"|'[^'\n]*'|\((?:[^()]|\([^()]*\))*\))*\))?[^:\n]*:[ \t]*")


def _grammar(*comments, python: bool = False) -> dict:
    """Unit <- Gap? (Comment Gap?)* Attribute* Header Docstring?"""
    opening = many(seq(maybe(_GAP), first(ref("Comment"), ref("Attribute"))))
    body = maybe(seq(maybe(rx(r"(?:[ \t]*#[^\n]*)?[ \t\r\n]+")), span("docstring", _STRING), ahead(rx(r"[ \t]*(?:;|#|\r?\n|\r?\Z)"))))
    header = first(seq(span("header", _PY_HEADER), body), span("header", _HEADER)) if python else span("header", _HEADER)
    return {
        "Comment": span("comment", first(*comments)),
        "Attribute": _ATTRIBUTE,
        "Unit": act(seq(opening, maybe(_GAP), maybe(header)), _pair),
    }


_C_LIKE = _grammar(_SLASH, _BLOCK)
_PYTHON = _grammar(_HASH, python=True)
_RUBY = _grammar(_HASH, _RUBY_BLOCK)
_ANY = _grammar(_SLASH, _BLOCK, _HASH, _DASHES, _RUBY_BLOCK, python=True)
GRAMMARS = {
    **dict.fromkeys(("ts", "tsx", "js", "jsx", "mjs", "cjs", "java", "go", "rs", "c", "h", "cc", "cpp", "hpp", "cs", "kt", "kts", "scala", "swift", "dart", "php", "m"), _C_LIKE),
    **dict.fromkeys(("py", "pyi"), _PYTHON),
    **dict.fromkeys(("rb", "sh", "bash", "pl", "r", "ex", "exs", "jl"), _RUBY),
}


def documentation(content: str, file: str | None) -> dict:
    """``docs``: offsets of comments and docstring; ``code``: offsets of the function without what precedes it."""
    return parse(GRAMMARS.get((file or "").rpartition(".")[2].lower(), _ANY), "Unit", content) or {"docs": [], "kinds": [], "code": (0, len(content))}


# ---------------------------------------------------------------- informativeness

_WORD = re.compile(r"[^\W\d_][\w'’]*")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_MARK = rx(r"(?:[rRuUbBfF]{0,2}(?:\"\"\"|''')|/\*+!?|\*+/|\*+(?=\s|\Z|/)|//[/!]*|#+!?|--+|<!--|=begin\b|=end\b|;+|%+)[^\S\r\n]*")
_CLOSING = ('"""', "'''", "*/", "-->")
_TAG = re.compile(r"^(?:[@\\](?:param|arg|argument|return|returns|throws?|exception|raises?|type|typeparam|template|yields?|default|see|link|override|inheritdoc|deprecated|since|version|author|copyright|license|internal|private|public|protected|readonly|async|static|abstract|example|todo|ignore|hidden|api|name|function|method|memberof|callback|implements|extends|suppress\w*)\b|:(?:param|type|returns?|rtype|raises?|arg|argument|keyword|var|ivar|cvar|meta)\b[^:]*:)", re.I)
_SECTION = re.compile(r"^(?:args|arguments|parameters|params|returns?|raises|throws|yields|attributes|kwargs|keyword args|see also|references)\s*:?\s*$", re.I)
_RULE = re.compile(r"^[\W_]*$")
_TOOL = re.compile(
    r"^(?:@ts-\w|eslint\b|tslint:|jshint\b|jslint\b|prettier-ignore|biome-ignore|deno-lint|noqa\b|nolint\b|type:\s*ignore|pylint:|mypy:|pyright:|ruff:|flake8[:=]|isort:|fmt:\s*(?:on|off|skip)|yapf:|nosec\b|pragma\b|"
    r"rubocop:|sorbet:|typed:|frozen_string_literal|noinspection\b|nosonar\b|checkstyle[:.]|spotless:|@formatter:|@suppress|clang-format|clang-tidy|clippy::|rustfmt|cargo\b.*:|istanbul\b|c8 ignore|v8 ignore|webpack\w*:|@vite-ignore|"
    r"go:\w|\+build\b|lint:|cspell:|spell-checker:|codecov|coverage:|sourcery\b|region\b|endregion\b|vim?:|-\*-|eslint-|@flow|@jsx|@generated)",
    re.I,
)
_CODE = re.compile(
    r"^(?:if|while|for|switch|match)\s*\([^;{}]*[;{}]|^for \w+ in [^:]*:|^(?:const|let|var|final|auto|mut|val)\s+[\w{\[][^=]*=|^(?:else|try|do|end|begin|finally)\b\s*[{:]?$|"
    r"^[\w.$@\[\]'\"]+\s*(?:[-+*/|&?:]{0,2}=)(?!=)\s*\S|^[})\];,]+$"
)
_CONTROL = re.compile(r"(?:if|while|for|switch|catch|elsif|elif|unless|match)\b")
_STATEMENT = re.compile(r"(?:return|raise|throw|yield|await|defer|go|import|from|use|require|include|package|export|public|private|static|def|fn|func|function|class|struct|impl|assert|print|echo|del)\b")
_CALL = re.compile(r"[\w.$:\[\]&*]*\w[!?]?\(")
_OPERATOR = re.compile(r"===?|!==?|=>|->|&&|\|\||:=")
_ENDED = re.compile(r"(?<=[.!?。])[\"')\]»]*\s+|[。]\s*|\n")
_PLACEHOLDER = re.compile(
    r"^\W*(?:todo|fixme|xxx|tbd|hack|wip|tbc|n/?a|none|nothing|empty|untitled|undocumented|placeholder|dummy|stub)\b(?!\s+(?:entries|entry|items?|lists?|comments?|of)\b)|lorem ipsum|\bauto-?\s?generated\b.*\b(?:stub|method|code|comment|by)\b|"
    r"^\W*(?:this (?:comment|text|doc\w*|file|method|function|stub) (?:was|is) )?(?:automatically |auto-?)?generated (?:by|from|with|using)\b|\b(?:description|documentation|docs?|comment|summary|text|explanation) (?:goes|go|comes?|belongs) here\b|"
    r"\b(?:documentation|docs?|description|docstring) (?:is |are )?(?:pending|missing|tbd|to follow|to come|coming soon|needed)\b|\b(?:add|write|insert|put|needs?|fill in|provide|missing|supply)\b(?: \w+){0,3} (?:docs?|documentation|docstring|description|comment)\b(?: \w+){0,2} (?:here|later|soon|for this|please)\b|"
    r"\bneeds (?:docs?|documentation)\b|\breplace (?:this |it |me )?with (?:your|real|actual|own)\b|\bnothing to (?:see|say|do) here\b|^\W*(?:for )?internal use(?: only)?\W*$|^\W*(?:default|empty|trivial|simple|basic|generic|standard|stub|dummy) (?:implementation|constructor|method|function|stub)\W*$|"
    r"^\W*(?:ask|contact) \w+(?: \w+)? (?:team|author)|\bto be (?:documented|written|done|defined|filled in|completed|added)\b|^\W*(?:not|un)[ -]?(?:yet )?(?:documented|implemented)\b|"
    r"^\W*(?:à (?:documenter|compléter|faire|rédiger)|zu dokumentieren|noch zu dokumentieren|doku(?:mentation)? (?:fehlt|folgt)|por documentar|sin documentar|pendiente de documentar|a documentar|por fazer|documentar depois|da documentare|nog te documenteren|задокументировать|нет описания|описание отсутствует)\b",
    re.I,
)
_LEGAL = re.compile(
    r"^\W*(?:copyright\b|copr\.|\(c\)|©|all rights reserved|alle rechte vorbehalten|tous droits réservés|spdx-|licensed (?:under|to)\b|(?:this (?:file|code|program|software) is )?(?:released|distributed|provided|free software|available) (?:under|as is|\"as is\"|subject)|"
    r"(?:use|usage|redistribution)\b.*\b(?:subject to|governed by|permitted)\b|see (?:the )?licen[cs]e\b|no warranty|without warranty|permission is hereby|(?:mit|bsd|apache|gpl|mpl|isc)\W+licen[cs]e)|\bgoverned by .* licen[cs]e\b|\bterms (?:found )?(?:in|of) (?:the )?licen[cs]e\b.*\b(?:file|warranty|root)\b|"
    r"^\W*(?:authors?|maintainers?|maintained by|owner|contributors?|written by|since|version|rev(?:ision)?|date|created(?: (?:on|by|at))?|last (?:modified|changed|updated|edited)|modified|updated|history|autor(?:en)?|auteur|fecha|datum)\s*(?::|=|(?<=by)\s|(?<=on)\s|(?<=at)\s)|"
    r"^\W*(?:since|version|v)\s*\d[\d.]*\W*$|^\W*\d{4}-\d\d-\d\d\W*$|^\W*(?:created|written|added|modified|updated|changed) (?:by|on) [\w. -]{1,40}(?:\W+\d{2,4}\W.*)?$",
    re.I,
)
_POINTER = re.compile(
    r"^\W*(?:(?:please )?(?:see|refer to|cf)\b(?!\s+(?:if|whether|that|how)\b)|same as\b|(?:as|like|ditto|see) (?:above|below|before)\b|siehe\b|s\.\s?o\b|vgl\b|voir\b|véase\b|ver (?:también|tambem|também)\b|vedi\b|zie\b|см\b|inherit(?:s|ed)? (?:from|doc)|inheritdoc|copied from|overrides? (?:the )?(?:base|super|parent)|defined in|documented (?:in|at|on)|"
    r"https?://\S+\W*$|\{@(?:inheritdoc|link|see|code)\b)",
    re.I,
)
_FILLER = frozenset(
    "a an the this that these those it its is are was be to of for from in on at by with and or as if method function func procedure routine helper utility util class constructor getter setter accessor wrapper implementation simple basic "
    "will would shall can does do did done just only simply used use uses using given which what when then here there all any some new own default main internal based perform performs performing handle handles handling thing stuff value values object instance "
    "cette ce le la les une un des du de et fonction méthode pour qui est diese dieser dieses der die das ein eine funktion methode und für zum zur wird esta este el los las una unos función método para que es y".split()
)
_PIECE = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[^\W\dA-Z_]+|\d+")


def _stem(word: str) -> str:
    word = word.lower()
    for end in ("ations", "ation", "ating", "ings", "ing", "ates", "ated", "ies", "ied", "ises", "izes", "ised", "ized", "ise", "ize", "es", "ed", "er", "ors", "or", "e", "s", "y"):
        if word.endswith(end) and len(word) - len(end) >= 3:
            return word[: -len(end)]
    return word


@lru_cache(maxsize=50_000)
def _name_stems(name: str) -> frozenset:
    pieces = _PIECE.findall(name)
    return frozenset(_stem(p) for p in [*pieces, name])


def _parameters(signature: str) -> set[str]:
    inside = signature.partition("(")[2]
    return {w.lower() for w in _WORD.findall(inside)} | {"self"} if inside else set()


def _text(text: str, value: object) -> list[tuple[int, int]]:
    """Offsets of the text of each line, without closing marks."""
    out = []
    for _, a, b in _flat(value):
        line = text[a:b].rstrip()
        while line.endswith(_CLOSING):
            line = line[:-2].rstrip("* \t") if line.endswith("*/") else line[:-3].rstrip()
        out.append((a, a + len(line)))
    return out


#: Remark <- Line (Break Line)*;  Line <- Mark* Text
_REMARKS = {
    "Remark": act(seq(ref("Line"), many(seq(rx(r"\r?\n|\r"), ref("Line")))), _text),
    "Line": seq(rx(r"[^\S\r\n]*"), many(ref("Mark")), span("text", rx(r"[^\r\n]*"))),
    "Mark": _MARK,
}


def _is_code(line: str) -> bool:
    """A line of code, by how it begins and ends; each test reads the line once."""
    s = line.strip()
    if not s:
        return False
    if s[-1] in ";{" or _CODE.search(s):
        return True
    if _CONTROL.match(s) and s[-1] in "{):":
        return True
    if _STATEMENT.match(s) and (s[-1] in ";{}()=" or s.endswith("::")):
        return True
    if _CALL.match(s):
        head = s.rstrip(";{:?.)")
        if ")" in s[len(head) :] or head.rstrip().endswith(")"):
            return True
    return s[-1] in ")}" and (m := _OPERATOR.search(s, 1)) is not None and m.end() < len(s)


def _lines(text: str) -> list[str]:
    """The lines of a remark without comment marks."""
    return [text[a:b] for a, b in parse(_REMARKS, "Remark", text)]


def describe(text: str, name: str = "", signature: str = "") -> tuple[str, bool]:
    """The description without marks, and whether it says anything."""
    lines = _lines(text)
    clean = "\n".join(lines).strip()
    kept: list[str] = []
    in_tag = in_section = False
    params = None
    for line in lines:
        if not line:
            in_tag = in_section = False
            kept.append("")
            continue
        if _RULE.match(line):
            continue
        if _TAG.match(line):
            in_tag = True
            continue
        if _SECTION.match(line):
            in_section = True
            continue
        if in_section or in_tag:
            if params is None:
                params = _parameters(signature)
            ws = [w.lower() for w in _WORD.findall(line)]
            if in_section and (not ws or ws[0] in params or len(ws) < 3):
                continue
            if in_tag and len(ws) < 3:
                continue
            in_tag = in_section = False
        if _TOOL.match(line) or _is_code(line):
            continue
        kept.append(line)
    body = re.sub(r"(?<=[^\n])\n(?=[^\n])", " ", "\n".join(kept))
    left = []
    for sentence in _ENDED.split(body):
        if not sentence or _RULE.match(sentence) or _PLACEHOLDER.search(sentence) or _LEGAL.search(sentence) or _POINTER.search(sentence):
            continue
        left.append(sentence)
    rest = " ".join(left)
    ws = [w for w in _WORD.findall(rest)]
    count = len(ws) + len(_CJK.findall(rest)) // 2
    if count < 5:
        return clean, False
    if params is None:
        params = _parameters(signature)
    stems = _name_stems(name)
    told = [w for w in ws if w.lower() not in _FILLER and _stem(w) not in stems]
    if count - sum(w.lower() in params and ("_" in w or w != w.lower()) for w in ws) < 5:
        return clean, False
    return clean, len(told) >= 2 or bool(_CJK.search(rest))


_HAS_WORD = re.compile(r"[^\W_]")


def pair(name: str | None, file: str | None, signature: str | None, doc: str | None, content: str) -> tuple[str, str, str, int, int, bool]:
    """``(source, description, code, doc_start, doc_end, real)``; offsets are in ``content`` and -1 if it comes from doc."""
    if doc and _HAS_WORD.search(doc) and _WORD.search(doc):
        text, real = describe(doc, name or "", signature or "")
        return "doc", text, content, -1, -1, real
    found = documentation(content, file)
    a, b = found["code"]
    best = ("", "", content[a:b], -1, -1, False)
    groups: dict[str, list[tuple[int, int]]] = {}
    for kind, at in zip(found["kinds"], found["docs"]):
        groups.setdefault(kind, []).append(at)
    for kind in ("comment", "docstring"):
        if kind not in groups:
            continue
        spans = groups[kind]
        text, real = describe("\n".join(content[x:y] for x, y in spans), name or "", signature or content[a : content.find("\n", a) if content.find("\n", a) > 0 else b])
        if real or not best[0]:
            best = (kind, text, content[a:b], spans[0][0], spans[-1][1], real)
        if real:
            break
    return best


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = [(i, *pair(n, f, s, d, c)) for i, n, f, s, d, c in zip(batch["id"], batch["name"], batch["file"], batch["signature"], batch["doc"], batch["content"])]
        rows = [r[:-1] for r in rows if r[-1]]
        yield pd.DataFrame(rows, columns=["symbol_id", "source", "description", "code", "doc_start", "doc_end"])


def doc_pairs(symbols: DataFrame) -> DataFrame:
    """``symbol_id, source, description, code, doc_start, doc_end`` for each function or method with a real description."""
    functions = symbols.filter(F.lower(F.trim("kind")).isin("function", "method") & F.col("id").isNotNull())
    first_ids = functions.groupBy("file", "name", "line_start").agg(F.min("id").alias("symbol_id")).select("symbol_id").distinct()
    text = functions.filter(F.col("content").isNotNull() & (F.length(F.trim("content")) > 0)).select("id", "name", "file", "signature", "doc", "content")
    parsed = text.mapInPandas(_pairs, "symbol_id long, source string, description string, code string, doc_start long, doc_end long")
    return parsed.join(first_ids, "symbol_id", "left_semi")
