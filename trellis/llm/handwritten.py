"""Generated, minified or vendored source files, and blocks of data in the form of code.

Method: notices are the comments before the first code and behind the last.  Every text without its opening notice is masked (identifiers, numbers and strings become one token each), cut
into shingles of five tokens and clustered by MinHash bands; any two of one band with a Jaccard similarity of the shingles
of 0.8 or more come to be in one cluster.  The clusters decide, a text that is like no other being a cluster of its own:

* ``generated``: a family, that is, a cluster of which ``SEEDED`` of the texts and at least two have a path or notice that
  says so, or whose texts are mostly numbered runs (lines alike but for counting up), or that has ``FAMILY`` or more
  different texts of one masked sequence in one folder; and each file that says so of itself;
* ``vendored``: a cluster across repositories: a file with the same text, but for notice and last line break, as a member
  of its cluster that path or notice show to come from another project; and each file that says so of itself;
* ``blob``: a cluster of literals only, that is, most shingles of its texts hold nothing but literals and their separators;
* ``minified``: a cluster whose texts are mostly dense lines of short names; and each file whose path says so.

A folder of a family is the first two parts of a path.  Texts with the same masked sequence are one class while clustering,
so a text that is there very often costs one row; facts of a cluster are sums over its different texts.

Defined results: a null or empty text is judged by its path alone, a null path by its text alone; repeated rows count
once; texts of fewer than ``MIN_TOKENS`` tokens are in no cluster but that of their equals.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trellis.operators.components import components
from trellis.operators.skew import salted
from trellis.session import materialize

SHINGLE, BANDS, ROWS, SKETCH = 5, 16, 4, 128
SIMILAR, FAMILY, SEEDED, MIN_TOKENS, MIN_LINES, MOST = 0.8, 3, 0.5, 20, 10, 0.5
#: Lines alike but for counting up that make a run.
RUN = 8
#: Nodes of one band that one task compares with one another.
CAP = 4096

# ---- fixed values: what paths and notices look like
GENERATED_PATH = r"(?i)(^|/)(generated|__generated__|_generated|autogen|auto-generated|gen|gensrc|generated-sources)/|\.(pb\.(go|cc|h|rs|swift|dart|ts|js)|g\.\w+|gen\.\w+|generated\.\w+|designer\.(cs|vb)|freezed\.dart)$|(_pb2(_grpc)?\.pyi?|_pb\.(js|ts|rb)|_grpc_pb\.(js|ts)|_generated\.\w+|\.generated)$|(^|/)zz_generated[^/]*$"
MINIFIED_PATH = r"(?i)([.-]min|\.bundle|\.chunk|\.packed|\.prod)\.(js|mjs|cjs|jsx|ts|tsx|css|py|rb)$"
VENDORED_PATH = r"(?i)(^|/)(vendor|vendors|vendored|_vendor|third[-_]?party|3rd[-_]?party|node_modules|bower_components|jspm_packages|externals?|extern|deps|godeps|pods|carthage|site-packages|dist-packages|dist|upstream)/"
GENERATED_NOTICE = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?generated file\b|\b(?:auto-?|machine[- ]|automatically |tool[- ])?generated\b[^\n]{0,80}\b(?:do not|don'?t|never|not to be) (?:edit|modif|change|touch)|\b(?:do not|don'?t|never) (?:edit|modify|change|touch)\b[^\n]{0,80}\bgenerated\b|"
    r"^\W*machine[- ]generated\b|^\W*auto-?generated[,;:. ]+(?:run|by|from|with|using|on|file|code)\b|\b(?:changes|edits|modifications)\b[^\n]{0,40}\b(?:overwritten|lost|discarded)\b|\b(?:this )?(?:file|code|source|module) (?:was|is|has been) (?:auto-?|automatically |machine[- ])?(?:generated|produced|created|emitted|written) by (?:a |an |the )?(?:tool|compiler|generator|script|program|machine|\w*gen\w*)\b|"
    r"\b(?:code|file|source|module) generated (?:by|from|with|using)\b|^\W*generated by [^\n]{0,60}(?:compiler|generator|codegen|protoc|schema)|\b(?:automatically|auto-?|machine[- ])\s?(?:created|produced|written|emitted|built)\b|"
    r"\b(?:automatisch|maschinell) (?:erzeugt|erstellt|generiert|aangemaakt|gegenereerd)|\b(?:généré|produit|créé)e? automatiquement|\b(?:generado|creado|producido) automáticamente|\b(?:gerado|criado|produzido) automaticamente|\b(?:generato|creato|prodotto) automaticamente|"
    r"\bавтоматически (?:создан|сгенерирован)|(?:создан|сгенерирован)\w* автоматически|\b(?:ne pas (?:modifier|éditer)|nicht (?:bearbeiten|ändern|editieren)|no (?:editar|modificar)|não (?:editar|edite|modificar|modifique)|non (?:modificare|editare)|niet (?:bewerken|wijzigen)|не (?:редактировать|изменять|править))\b",
    re.I | re.M,
)
NOT_GENERATED = re.compile(r"\b(?:not|isn't|is not|never|nicht|pas|no) (?:\w+ )?generated\b|maintained by hand|generated (?:method|function|constructor)\b|method stub|scaffold", re.I)
VENDORED_NOTICE = re.compile(
    r"\b(?:copied|taken|adapted|borrowed|imported|forked|synced|mirrored)\b[^\n]{0,30}\bfrom (?:the )?(?:upstream|original|project|library|package|repo|http|\w+ v?\d+\.\d)|\bvendored (?:from|copy|in from)\b|\bbundled (?:copy|version|with) of\b|^\W*(?:origin|upstream|source):\s*\S+ \(?v?\d+[.\d]*\)?|"
    r"\bthird[- ]party (?:code|library|source|software|file|module)\b|\b(?:report|send|file) (?:bugs|issues|patches|changes) (?:to )?upstream\b|\bimported without changes\b|\bupstream (?:project|release|version|repository)\b[^\n]{0,40}\d|@preserve\b|@license\b[^\n]*\d+\.\d+|"
    r"^[\W]*!?\s*[\w.-]+(?:\.js)? v\d+\.\d+[.\d]*[^\n]*\n\W*(?:\(c\)|copyright|©|licen[cs]e|released under)",
    re.I | re.M,
)

_OPENING = re.compile(r"\ufeff?\s*(?:(?:(?://|#(?!\[|include|define|if|pragma|!\[)|--)[^\n]*(?:\n|\Z)|/\*(?:[^*]|\*(?!/))*\*/[ \t]*(?:\n|\Z)|<!--[\s\S]*?-->[ \t]*(?:\n|\Z))\s*)+")
_QUOTED = re.compile(r"//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z)|#(?<!\S#)[^\[\n][^\n]*|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")
_STRING = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`")
_NAME = re.compile(r"[^\W\d]\w*")
_DIGIT = re.compile(r"\d")
_REMARK = re.compile(r"\s*(?://|#(?!\[)|--|/\*|\*|<!--)")
_SKELETON = {i: None for i in range(128) if chr(i).isalnum() or chr(i) in "_ \t\r"}
_KEYWORDS = (
    "if else for while return def class import from function const let var fn func struct impl match pub public private static new throw raise try catch except finally async await yield in of is not and or "
    "end do then type interface enum use require package go defer select case switch break continue with as lambda self this None null nil true false"
).split()
_CODES = {w: 200 + i for i, w in enumerate(_KEYWORDS)} | {chr(i): i for i in range(33, 127) if not (chr(i).isalnum() or chr(i) in "_\"'`")}
_VALUE, _PLAIN = np.zeros(512, bool), np.zeros(512, bool)
_VALUE[[2, 3, *(_CODES[w] for w in ("None", "null", "nil", "true", "false"))]] = True
_PLAIN[[*np.flatnonzero(_VALUE), *map(ord, "[]{}(),;:+-*.")]] = True
_WORD_BYTE = np.array([i >= 128 or chr(i).isalnum() or i == 95 for i in range(256)])
_DIGIT_BYTE = np.array([48 <= i < 58 for i in range(256)])
#: Code of a byte that is in no word: white space 0, what stands for a string 3, a sign its own, a lone quote 4.
_SIGN = np.array([3 if i == 0 else 0 if i <= 32 or i >= 127 else _CODES.get(chr(i), 4) for i in range(256)], np.uint64)
_P = np.array([pow(0x100000001B3, k, 1 << 64) for k in range(SHINGLE)], np.uint64)
_HASHES = np.random.default_rng(41).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def core(body: str) -> tuple[str, str]:
    """Opening notice (all comments before the first code) and the rest without its last line break."""
    body = body.replace("\r\n", "\n")
    m = _OPENING.match(body)
    cut = m.end() if m and m.end() < len(body) else 0
    return body[:cut], body[cut:].strip()


def closing(text: str) -> str:
    """The comments behind the last code."""
    lines, out = text.split("\n"), []
    while lines and (not lines[-1].strip() or _REMARK.match(lines[-1])):
        out.append(lines.pop())
    return "\n".join(out[::-1]) if lines else ""


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2 ** 64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        one = np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64)
        back = np.full(2 * n, pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)
        one[0] = back[0] = 1
        _POWERS = np.cumprod(one), np.cumprod(back)
    return _POWERS


_POWERS = (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    one, back = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(data.astype(np.uint64) * one[: len(data)])))
    return (sums[end] - sums[start]) * back[start]


def masked(text: str) -> np.ndarray:
    """Codes of the tokens: names 1, numbers 2, strings 3, keywords and signs their own; comments are left out."""
    flat = _QUOTED.sub(lambda m: " " if m.group()[0] in "/#" else "\0", text)
    data = np.frombuffer(flat.encode("utf-8", "replace"), np.uint8)
    word = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(word.view("i1"), prepend=0, append=0))
    start, end = edge[::2], edge[1::2]
    number = _DIGIT_BYTE[data[start]] if len(start) else np.empty(0, bool)
    # a dot behind a number, and what is behind the dot, belong to it
    point = end[number & (end < len(data)) & (np.append(data, 0)[end] == 46)]
    code = np.where(number, 2, 1).astype(np.uint64)
    key = _word_hashes(data, start, end)
    at = np.minimum(np.searchsorted(_KEYWORD_HASHES, key), len(_KEYWORD_HASHES) - 1)
    code = np.where(_KEYWORD_HASHES[at] == key, _KEYWORD_CODES[at], code)
    out = np.where(word, 0, _SIGN[data]).astype(np.uint64)
    out[start] = code
    out[point] = 0
    behind = point[point + 1 < len(data)] + 1
    out[behind[word[behind]]] = 0
    return out[out > 0]


_WORDS = sorted((int(_word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0]), _CODES[w]) for w in _KEYWORDS)
_KEYWORD_HASHES, _KEYWORD_CODES = (np.array(c, np.uint64) for c in zip(*_WORDS))


def literal_share(codes: np.ndarray) -> float:
    """Share of the shingles that hold literals and their separators only, and a literal at least."""
    if len(codes) < SHINGLE:
        return 0.0
    sums = lambda mask: np.cumsum(np.concatenate(([0], mask)))
    plain, value = sums(_PLAIN[codes]), sums(_VALUE[codes])
    plain, value = plain[SHINGLE:] - plain[:-SHINGLE] == SHINGLE, value[SHINGLE:] > value[:-SHINGLE]
    return float((plain & value).mean())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sketch(codes: np.ndarray) -> tuple[list[int], np.ndarray, int]:
    """Band keys, the ``SKETCH`` smallest shingle hashes, padded (all of them if there are few), and the number of different shingles."""
    windows = np.lib.stride_tricks.sliding_window_view(codes, SHINGLE) if len(codes) >= SHINGLE else codes[None]
    hashed = np.unique(_mix((windows * _P[: windows.shape[1]]).sum(1, dtype=np.uint64)))
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(hashed), 4096):
        least = np.minimum(least, _mix(hashed[a : a + 4096, None] * _HASHES[0] + _HASHES[1]).min(0))
    bands = _mix((least.reshape(BANDS, ROWS) * _P[:ROWS]).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    low = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    least_all = np.unique((hashed >> np.uint64(32)).astype(np.uint32))[:SKETCH]
    low[: len(least_all)] = least_all
    return bands.view("i8").tolist(), low, len(hashed)


def layout(text: str) -> tuple[int, float, float]:
    """Lines, the share of lines in numbered runs, and the share of the text in dense lines."""
    lines = [s for s in text.split("\n") if s.strip()]
    if not lines:
        return 0, 0.0, 0.0
    run = dense = 0
    counted = [bool(_DIGIT.search(s)) for s in lines]
    at = 0
    while at < len(lines):  # only long stretches of lines with digits can hold a run
        end = at
        while end < len(lines) and counted[end]:
            end += 1
        if end - at >= RUN:
            for _, same in groupby(s.translate(_SKELETON) for s in lines[at:end]):
                n = sum(1 for _ in same)
                run += n if n >= RUN else 0
        at = end + 1
    for s in lines:
        if len(s) >= 120:
            bare = _STRING.sub("", s)
            names = _NAME.findall(bare)
            if len(bare) > 60 and names and sum(map(len, names)) / len(names) < 4 and sum(bare.count(c) for c in ";{}(),=[].") > 0.15 * len(bare):
                dense += len(s)
    return len(lines), run / len(lines), dense / max(1, sum(map(len, lines)))


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for i, body in zip(batch["file_id"], batch["body"]):
            notice, text = core(body or "")
            codes = masked(text)
            n, run, dense = layout(text)
            bands, low, size = sketch(codes) if len(codes) else ([], np.empty(0, np.uint32), 0)
            said = None
            for remark in (notice, closing(text)):
                if said is None and remark:
                    said = "generated" if any(GENERATED_NOTICE.search(s) and not NOT_GENERATED.search(s) for s in remark.split("\n")) else "vendored" if VENDORED_NOTICE.search(remark) else None
            digest = hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).hexdigest()
            order = hashlib.blake2b(codes.astype("u2").tobytes(), digest_size=16).hexdigest()
            rows.append((i, said, len(codes), n, run, literal_share(codes), dense, digest, order, bands, low.tobytes(), size))
        yield pd.DataFrame(rows, columns=["file_id", "notice", "n_tokens", "n_lines", "run", "literal", "dense", "text", "order", "bands", "low", "size"])


def jaccard(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of the sets behind pairs of sketches (rows): exact for small sets, else over the smallest of the union."""
    none = np.iinfo(np.uint32).max
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    twice[:, 1:] = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
    rank = np.cumsum(~twice & (both != none), axis=1)
    return (twice & (rank <= SKETCH)).sum(1) / np.maximum(1, np.minimum(rank[:, -1], SKETCH))


def profiles(texts: DataFrame) -> DataFrame:
    """What the text of each file shows, by ``file_id``."""
    schema = "file_id long, notice string, n_tokens long, n_lines long, run double, literal double, dense double, text string, order string, bands array<long>, low binary, size long"
    return texts.filter("file_id is not null").select("file_id", "body").mapInPandas(_profile, schema)


def _may_be(both: np.ndarray, kept: np.ndarray, other: np.ndarray, similarity: float) -> np.ndarray:
    """Shared values bound the similarity of two sketches from above."""
    return both >= similarity * np.minimum(kept + other - both, SKETCH)


def _together(low: np.ndarray, both: np.ndarray, kept: np.ndarray, size: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """``_chains`` where the shared values of all pairs are known."""
    fits = _may_be(both, kept[:, None], kept[None], similarity) & (np.minimum(size[:, None], size[None]) >= similarity * np.maximum(size[:, None], size[None]))
    np.fill_diagonal(fits, False)
    alone = np.ones(len(low), bool)
    for start in np.flatnonzero(fits.any(1)):
        if not alone[start]:
            continue
        alone[start] = False
        queue = [start]
        while queue:
            i = queue.pop()
            near = np.flatnonzero(fits[i] & alone)
            if len(near):
                near = near[jaccard(np.broadcast_to(low[i], (len(near), SKETCH)), low[near]) >= similarity]
                if len(near):
                    alone[near] = False
                    queue.extend(near)
                    yield i, near


#: Rows times shared values up to which the pairs of a cell are counted by one product of matrices.
DENSE = 1_000_000


def _chains(low: np.ndarray, size: np.ndarray, similarity: float, dense: int = DENSE) -> Iterator[tuple[int, np.ndarray]]:
    """A row and the rows that join it: each is compared with all rows that are in no chain yet, so no similar pair is left.

    ``size`` is the whole number of shingles: sets that differ too much in it cannot be similar.
    """
    none = np.iinfo(np.uint32).max
    values, ids, times = np.unique(low, return_inverse=True, return_counts=True)
    ids, kept = ids.reshape(low.shape).astype(np.int32), (low != none).sum(1)
    shared = np.flatnonzero((times > 1) & (values != none))
    if len(low) * len(shared) <= dense:
        at = np.zeros(len(values), np.int32)
        at[shared] = np.arange(1, len(shared) + 1)
        holds = np.zeros((len(low), len(shared) + 1), "f4")
        holds[np.repeat(np.arange(len(low)), SKETCH), at[ids.ravel()]] = 1
        holds = holds[:, 1:]
        yield from _together(low, holds @ holds.T, kept, size, similarity)
        return
    real, seen = values != none, np.zeros(len(values), np.uint8)
    rest, queue = np.argsort(size, kind="stable"), []
    ranked, held = size[rest], ids[rest]
    while len(rest):
        if not queue:
            queue, rest, ranked, held = [rest[0]], rest[1:], ranked[1:], held[1:]
        i = queue.pop()
        first, last = np.searchsorted(ranked, similarity * size[i]), np.searchsorted(ranked, size[i] / similarity, "right")
        if first == last:
            continue
        seen[ids[i]] = real[ids[i]]
        both = seen.take(held[first:last]).sum(1, dtype=np.uint8).astype(np.int64)  # at most SKETCH
        seen[ids[i]] = 0
        j = np.flatnonzero(_may_be(both, kept[i], kept[rest[first:last]], similarity))
        if len(j):
            near = rest[first + j]
            fits = jaccard(np.broadcast_to(low[i], (len(j), SKETCH)), low[near]) >= similarity
            if fits.any():
                queue.extend(near[fits])
                yield i, near[fits]
                left = np.ones(len(rest), bool)
                left[first + j[fits]] = False
                rest, ranked, held = rest[left], ranked[left], held[left]


def _links(similarity: float) -> Callable:
    def work(held: list[tuple[list, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        nodes, low, size = sum((h[0] for h in held), []), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        found = [(nodes[i], nodes[j]) for i, more in _chains(low, size, similarity) for j in more]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            band, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            nodes, low, size = batch.column(2).to_pylist(), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, SKETCH), batch.column(4).to_numpy()
            cuts = [0, *(np.flatnonzero((band[1:] != band[:-1]) | (cell[1:] != cell[:-1])) + 1), len(band)]
            for a, b in zip(cuts, cuts[1:]):
                if last != (band[a], cell[a]):
                    yield from work(held) if held else ()
                    held, last = [], (band[a], cell[a])
                held.append((nodes[a:b], low[a:b], size[a:b]))
        if held:
            yield from work(held)

    return run


def clusters(profile: DataFrame, similarity: float = SIMILAR, cap: int = CAP) -> DataFrame:
    """``text, cluster``: classes of equal texts (by digest) and their cluster, the smallest digest in it.

    Texts of one masked sequence are one node.  A band of more than ``cap`` nodes is dealt out as pairs of blocks.
    """
    big = profile.filter(F.col("n_tokens") >= MIN_TOKENS)
    classes = materialize(big.groupBy("order").agg(F.min("text").alias("node"), F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("size").alias("size")), "classes")
    bands = classes.select("node", F.explode("bands").alias("band"))
    held = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("band", F.when(F.col("n") > cap, F.ceil(2 * F.col("n") / cap)).otherwise(1).cast("int").alias("m"))
    rows = bands.join(held, "band").withColumn("block", F.pmod(F.xxhash64("node"), "m").cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).filter("m = 1 or j != block")
    rows = rows.select("node", "band", (F.least("block", "j") * F.col("m") + F.greatest("block", "j")).alias("cell")).join(classes.select("node", "low", "size"), "node")
    close = rows.select("band", "cell", "node", "low", "size").repartition("band", "cell").sortWithinPartitions("band", "cell", "node").mapInArrow(_links(similarity), "a string, b string")
    joined = components(close, "clusters")
    nodes = classes.select("order", "node").join(joined, "node", "left").select("order", F.coalesce("cluster", "node").alias("cluster"))
    return big.select("text", "order").distinct().join(nodes, "order").select("text", "cluster")


def families(members: DataFrame) -> DataFrame:
    """``cluster, n_texts, seeded, run, literal, dense`` of the clusters of more than one text; shares of their texts."""
    share = lambda c: F.avg(F.col(c).cast("double")).alias(c)
    facts = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_texts"), F.sum(F.col("said").cast("int")).alias("n_said"), share("said"), share("run"), share("literal"), share("dense")).filter("n_texts > 1")
    return facts.select("cluster", "n_texts", ((F.col("said") >= SEEDED) & (F.col("n_said") > 1)).alias("seeded"), "run", "literal", "dense")


def not_handwritten(files: DataFrame, texts: DataFrame, group=clusters) -> DataFrame:
    """``file_id, cluster, generated, minified, vendored, blob`` of each file that nobody of the project wrote by hand.

    ``group`` gives the clusters (``text, cluster``) of profiles.
    """
    paths = files.select(F.col("id").alias("file_id"), "path").filter("file_id is not null").groupBy("file_id").agg(F.min("path").alias("path"))
    paths = paths.select(
        "file_id", F.substring_index("path", "/", 2).alias("folder"), F.col("path").rlike(GENERATED_PATH).alias("p_gen"), F.col("path").rlike(MINIFIED_PATH).alias("p_min"), F.col("path").rlike(VENDORED_PATH).alias("p_ven")
    )
    yes = lambda c: F.coalesce(c, F.lit(False))
    profile = materialize(profiles(texts), "profiles")
    seen = paths.join(profile.drop("bands", "low", "size"), "file_id", "full").join(group(profile), "text", "left")
    seen = seen.select(
        "file_id", "folder", "order", "n_tokens", "n_lines", "run", "literal", "dense", F.when(F.col("n_lines") > 0, F.col("text")).alias("text"), F.coalesce("cluster", "text").alias("cluster"),
        yes(F.col("p_min")).alias("p_min"), (yes(F.col("p_gen")) | yes(F.col("notice") == "generated")).alias("says_gen"), (yes(F.col("p_ven")) | yes(F.col("notice") == "vendored")).alias("says_ven"),
    )
    seen = materialize(seen, "seen")
    # the different texts of each cluster, with what any file of that text in the cluster says of itself
    members = seen.filter("text is not null").groupBy("cluster", "text").agg(
        *[F.first(c).alias(c) for c in ("n_lines", "run", "literal", "dense")], F.max("says_gen").alias("said"), F.max("says_ven").alias("copied")
    )
    members = materialize(members, "members")
    many, facts = salted(members.select("cluster", "text", "n_lines", "copied", *[F.col(c).alias(f"own_{c}") for c in ("run", "literal", "dense")]), families(members), "cluster", "text")
    judged = many.join(facts, ["cluster", "_salt"], "left").select(
        "cluster", "text", "copied", yes(F.col("seeded")).alias("seeded"), (F.col("n_lines") >= MIN_LINES).alias("long"), *[F.coalesce(c, f"own_{c}").alias(c) for c in ("run", "literal", "dense")]
    )
    judged = judged.select(
        "text", "copied", (F.col("dense") >= MOST).alias("is_min"), (F.col("long") & (F.col("literal") >= MOST)).alias("is_blob"),
        (F.col("seeded") | (F.col("long") & (F.col("run") >= MOST) & (F.col("literal") < MOST))).alias("is_gen"),
    )
    family = seen.filter((F.col("n_tokens") >= MIN_TOKENS) & F.col("folder").isNotNull() & F.col("text").isNotNull()).select("cluster", "folder", "order", "text").distinct()
    family = family.groupBy("cluster", "folder", "order").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= FAMILY).select("folder", "order", F.lit(True).alias("_family")).distinct()
    some, kinds = salted(seen, judged, "text", "file_id")
    rows = some.join(kinds, ["text", "_salt"], "left").drop("_salt").join(family, ["folder", "order"], "left")
    rows = rows.groupBy("file_id").agg(
        F.min("cluster").alias("cluster"),
        F.max(F.col("says_gen") | yes(F.col("is_gen")) | yes(F.col("_family"))).alias("generated"),
        F.max(F.col("p_min") | yes(F.col("is_min"))).alias("minified"),
        F.max(F.col("says_ven") | yes(F.col("copied"))).alias("vendored"),
        F.max(yes(F.col("is_blob"))).alias("blob"),
    )
    return rows.filter("generated or minified or vendored or blob")
