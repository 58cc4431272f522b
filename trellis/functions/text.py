"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the basic plane that are a base letter with marks, and that letter (made by the rule, not listed).
_MARKED = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in range(0xC0, 0x2000) if len(unicodedata.normalize("NFD", chr(c))) > 1 and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and all(unicodedata.combining(x) for x in unicodedata.normalize("NFD", chr(c))[1:])}
_FROM, _TO = "".join(_MARKED), "".join(_MARKED.values())


def fold(c: str | Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), _FROM, _TO)


def tokens(c: str | Column) -> Column:
    """Runs of letters and digits, folded; null gives none."""
    return F.regexp_extract_all(F.coalesce(fold(c), F.lit("")), F.lit(r"[\p{L}\p{N}]+"), 0)


def word_set(c: str | Column) -> Column:
    """Different words between white space, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def jaccard(a: str | Column, b: str | Column) -> Column:
    """Of two arrays without repeats; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both))


def slug(c: str | Column) -> Column:
    """Last part of a path in lower case, blanks and underscores as hyphens, nothing but letters, digits and hyphens."""
    base = F.regexp_replace(F.lower(F.regexp_extract(c, r"([^/]*)/*$", 1)), r"[ _]", "-")
    return F.regexp_replace(base, r"[^\p{L}\p{N}-]", "")


def one_line(c: str | Column, length: int, more: str = "…") -> Column:
    """White space as single blanks, and ``more`` behind the first ``length`` characters where there are more."""
    text = F.trim(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(text) > length, F.concat(F.rtrim(F.substring(text, 1, length)), F.lit(more))).otherwise(text)


def new_id() -> Column:
    """A random id (UUID version 4)."""
    return F.uuid()
