"""Languages of documents and of their mixed stretches.

Method: word-first backoff.  A word that the model knows is scored by its log frequency in each language; an unseen word
falls back to character n-grams of five, then four, three and two letters (with word ends), the longest of which the model
knows some.  The scores of a sentence add up to a posterior over the languages; neighbouring sentences of one language
make a segment, and a document has every language of which it has a whole sentence.  Words become numbers once for each
batch, whose scores are gathered from one table and summed sentence by sentence.

The model is trained here, on at most ``SAMPLE`` documents chosen by a hash of their id, with the labels they carry:
labels are brought to two letters, a first model is counted from them, and a second one from the sentences as the first
one reads them, which drops wrong labels and mixed documents.  ``SEEDS`` keep a language apart where labels are scarce.

Code, inline code, identifiers, links, headings and short prefixes are no prose.  Words are scored in composed form with
their accents removed and wrongly decoded letters repaired, so that lost or broken accents do not matter.

Defined results: a sentence is sure with ``MIN_WORDS`` words and a confidence of ``SURE``; one that is not goes to the
segment before it (at the beginning of a text, behind it), whose confidence it lowers.  A document without a sure sentence is
one segment with the language of all its words, or, where it has no prose, of its letters, and with the confidence that
this gives; ``sure`` is false there.  Only a text without letters has no language.  Equal scores go to the language
first by its code; repeated rows (same id and text) count once; an empty table or one without labels gives what the
seeds alone can tell.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 12_000
MIN_WORDS = 4
#: Confidence from which a sentence counts.
SURE = 0.8
NGRAMS = (5, 4, 3, 2)
#: Known words and n-grams kept for each language.
WORDS, GRAMS = 20_000, 40_000

# ---- fixed values: names of languages (ISO 639), and frequent words of each
NAMES = {
    "en": "eng english", "fr": "fra fre french français francais", "de": "deu ger german deutsch", "es": "spa spanish español espanol castellano", "pt": "por portuguese português portugues",
    "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "ru": "rus russian русский", "pl": "pol polish polski", "sv": "swe swedish svenska", "da": "dan danish dansk", "no": "nor nb nn nob nno norwegian norsk",
    "fi": "fin finnish suomi", "cs": "ces cze czech čeština", "tr": "tur turkish türkçe", "uk": "ukr ukrainian українська", "ro": "ron rum romanian română", "hu": "hun hungarian magyar", "el": "ell gre greek ελληνικά",
    "ja": "jpn japanese 日本語", "zh": "zho chi cmn chinese mandarin 中文", "ko": "kor korean 한국어", "ar": "ara arabic العربية", "ca": "cat catalan català",
}
UNKNOWN = frozenset("und unk unknown undefined undetermined none null nan na n/a mis zxx mul xx xxx ? ?? - -- other unspecified".split()) | {""}
SEEDS = {
    "en": "the of and to in is that for it with as was on are this not be by from which",
    "fr": "le la les des et en un une du que qui dans est pour pas sur au avec ce sont",
    "de": "der die das und in den von zu ist mit sich des auf für nicht ein eine dem im wird",
    "es": "el la los las de que y en un una del se por con no para es al lo como",
    "pt": "o a os as do da de que e em um uma dos não para com por se no na",
    "it": "il la di che e in un una del della per non con si le da gli sono nel alla",
    "nl": "de het een van en in is dat op te zijn voor met niet aan er om die door bij",
    "ru": "и в не на что с по из как это для к от его но все она так же при",
}
_CODE_OF = {n: code for code, names in NAMES.items() for n in [code, *names.split()]}


def normal_label(label: str | None) -> str | None:
    """Two-letter code of a label in any spelling; None where it is absent; the label itself where nobody knows it."""
    name = (label or "").strip().lower()
    if name in UNKNOWN:
        return None
    for part in (name, re.split(r"[-_ ./@(]", name)[0]):
        if part in _CODE_OF:
            return _CODE_OF[part]
    return None if re.split(r"[-_ ./@(]", name)[0] in UNKNOWN else name


_FENCE = re.compile(r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)", re.S)
_LINK = re.compile(r"https?://\S+|www\.\S+|(?<!\S)[^\s@]++@\S+|`[^`\n]*`|<[^<>\n]{1,80}>")
_HEADING = re.compile(r"^[ \t]*(?:#{1,6}[ \t][^\n]*|[=\-~*_]{3,}[ \t]*|\|.*\|[ \t]*)$|^[^\n]+\n(?==={2,}|---{1,}[ \t]*$)", re.M)
_PREFIX = re.compile(r"^[ \t>*•+\-]*(?:\d+[.)][ \t]+)?(?:\[[\w -]{1,20}\][ \t]*|[a-z]{2,10}(?:\([\w./-]*\))?!?:[ \t]+|[A-Z][a-zA-Z]{1,14}:[ \t]+(?=[A-ZÀ-ÝА-Я]))?", re.M)
_CODELINE = re.compile(r"^[^\n]*(?:[;{}]|\)[;:]?|=>|->|::|&&|\|\|)[ \t]*$|^[ \t]*(?://|#!|/\*|\*/|import |from \w+ import|def |func |fn |const |let |var |return[ ;]|raise |assert |(?:el)?if\b.*:|for\b.*:|while\b.*:|with\b.*:|if \(|for \(|at \w+ \(|[\w.\[\]]+(?:, [\w.\[\]]+)*\s*[:+\-|]?=\s).*$", re.M)
_PROSE = re.compile(r"(?<![^\W_])(?:[^\W\d_]++,?[ \t]++){5}[^\W\d_]")
_END = re.compile(r"(?=[\s\"'»”’)\]])(?:(?<=[.!?…。！？])[\"'»”’)\]]*(?=\s)|\n\s*\n|(?<=[»”])\s|\n(?=[ \t]*(?:[-*•>]|\d+[.)])[ \t])|(?<=:)\n|\s(?=«)|(?<=[.!?])\s)")
_TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|['’](?=[^\W\d_]))*")
_LETTERS = re.compile(r"[^\W\d_]+")
_ODD = re.compile(r"[a-z][A-Z]|[_\d]|\w\.\w|\w/\w|\w\(\)")
_BROKEN = re.compile("[Â-ô][\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]+")


def _byte(c: str) -> bytes:
    try:
        return c.encode("latin-1")
    except UnicodeEncodeError:
        return c.encode("cp1252")


def repair(text: str) -> str:
    """Undo UTF-8 that was read as a one-byte code."""

    def one(m: re.Match) -> str:
        try:
            return b"".join(map(_byte, m.group())).decode("utf-8")
        except (UnicodeDecodeError, UnicodeEncodeError):
            return m.group()

    return _BROKEN.sub(one, text)


class _Folds(dict):
    """Letters without accents, in compatible form; marks and invisible characters are left out."""

    def __missing__(self, code: int) -> str:
        parts = (c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
        self[code] = "".join(parts).replace("ß", "ss").replace("ё", "е")
        return self[code]


class _Gaps(dict):
    """Letters as they are, a blank for all else."""

    def __missing__(self, code: int) -> str:
        self[code] = chr(code) if _LETTERS.match(chr(code)) else " "
        return self[code]


_FOLDS, _GAPS = _Folds(), _Gaps()


def words(sentence: str) -> list[str]:
    """Words that count, folded."""
    if not sentence.isascii():
        sentence = repair(sentence).translate(_FOLDS)
    kept = [p for p in sentence.split() if (p.isalpha() and (p.islower() or p.istitle())) or not _ODD.search(p)]
    sentence = " ".join(kept).lower()
    if "'" not in sentence and "’" not in sentence:
        return sentence.translate(_GAPS).split()
    out = []
    for w in _TOKEN.findall(sentence.replace("’", "'")):
        head, _, tail = w.rpartition("'")
        if head and len(head) <= 4:
            out.append(head)
            w = tail
        out.append(w)
    return out


def sentences(text: str) -> list[tuple[int, int, list[str]]]:
    """Offsets and words of the sentences of prose."""
    blank = lambda m: re.sub(r"[^\n]", " ", m.group())
    unless_prose = lambda m: m.group() if _PROSE.search(m.group()) else blank(m)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(blank, text)
    if any(c in text for c in ("`", "<", "@", "http", "www.")):
        text = _LINK.sub(blank, text)
    text = _HEADING.sub(blank, text)
    text = _CODELINE.sub(unless_prose, text)
    text = _PREFIX.sub(lambda m: " " * len(m.group()), text)
    out, start = [], 0
    for m in [*_END.finditer(text), None]:
        end = m.end() if m else len(text)
        part = text[start:end]
        if part.strip():
            a = start + len(part) - len(part.lstrip())
            out.append((a, start + len(part.rstrip()), words(part)))
        start = end
    return out


class Model:
    """Centred log frequencies of words and n-grams over ``langs``: two tables and the row of each word and n-gram."""

    def __init__(self, langs: list[str], words_: list[str], known: np.ndarray, grams: list[str], parts: np.ndarray):
        self.langs, self.known, self.parts = langs, known, parts
        self.rows, self.grams = {w: i for i, w in enumerate(words_)}, {g: i for i, g in enumerate(grams)}

    def back_off(self, word: str) -> np.ndarray:
        w = f"^{word}$"
        for n in NGRAMS:
            found = [i for at in range(len(w) - n + 1) if (i := self.grams.get(w[at : at + n])) is not None]
            if len(found) * 2 >= max(1, len(w) - n + 1):
                return np.clip(self.parts[found].mean(0), -2, 2) * 0.5 if found else np.zeros(len(self.langs))
        return np.zeros(len(self.langs))

    def totals(self, parts: list[list[str]], step: int = 1 << 19) -> np.ndarray:
        """Sums of the scores of the words of each part; an unseen word is looked up once for each call."""
        out, at = np.zeros((len(parts), len(self.langs))), 0
        unseen: dict[str, int] = {}
        more: list[np.ndarray] = []

        def row(w: str) -> int:
            i = self.rows.get(w)
            if i is None and (i := unseen.get(w)) is None:
                i = unseen[w] = len(self.known) + len(more)
                more.append(self.back_off(w))
            return i

        full = [k for k, ws in enumerate(parts) if ws]
        while at < len(full):
            some, n = [], 0
            while at < len(full) and n < step:
                some.append(full[at])
                n += len(parts[full[at]])
                at += 1
            ids = np.fromiter((row(w) for k in some for w in parts[k]), np.int64, n)
            table = np.concatenate([self.known, np.array(more).reshape(-1, len(self.langs))]) if more else self.known
            starts = np.cumsum([0, *(len(parts[k]) for k in some[:-1])])
            out[some] = np.add.reduceat(table[ids], starts, axis=0)
        return out

    def posteriors(self, parts: list[list[str]]) -> np.ndarray:
        total = self.totals(parts)
        odds = np.exp(np.maximum(total - total.max(1, keepdims=True), -60)) if len(parts) else total
        return odds / odds.sum(1, keepdims=True)


def _centred(counts: dict[str, Counter], langs: list[str], keep: int, least: int) -> tuple[list[str], np.ndarray]:
    totals = np.array([sum(counts[c].values()) + 1.0 for c in langs])
    chosen = sorted({w for c in langs for w, n in counts[c].most_common(keep) if n >= least})
    n = np.array([[counts[c].get(w, 0) for c in langs] for w in chosen], float).reshape(-1, len(langs))
    rate = np.log((n + 0.02) / (totals + 1) + 1e-6)
    return chosen, np.clip(rate - rate.mean(1, keepdims=True), -4, 4)


def _fit(parts: list[tuple[str, list[str]]]) -> Model:
    counts: dict[str, Counter] = defaultdict(Counter)
    for lang, seed in SEEDS.items():
        counts[lang].update({w: 3 for w in words(seed)})
    for lang, ws in parts:
        counts[lang].update(ws)
    langs = sorted(counts)
    grams: dict[str, Counter] = defaultdict(Counter)
    for lang in langs:
        mine = grams[lang]
        for w, n in counts[lang].items():
            v, weight = f"^{w}$", 1 + math.log(n)
            for size in NGRAMS:
                for i in range(len(v) - size + 1):
                    mine[v[i : i + size]] += weight
    return Model(langs, *_centred(counts, langs, WORDS, 2), *_centred(grams, langs, GRAMS, 2))


def train(rows: list[tuple[str | None, str | None]], least: int = 12) -> Model:
    """Model of labelled texts; languages with fewer than ``least`` sentences of their own are left out unless seeded."""
    split = [(normal_label(label), [ws for _, _, ws in sentences(text or "") if len(ws) >= MIN_WORDS]) for label, text in rows]
    enough = Counter()
    for lang, parts in split:
        enough[lang] += len(parts)
    allowed = {c for c, n in enough.items() if c in NAMES and n >= least} | set(SEEDS)
    first = _fit([(lang, ws) for lang, parts in split if lang in allowed for ws in parts])
    flat = [ws for _, parts in split for ws in parts]
    sure = first.posteriors(flat)
    return _fit([(first.langs[k], ws) for k, p, ws in zip(sure.argmax(1), sure.max(1), flat) if p > 0.9]) if flat else first


def segments(texts: list[str], model: Model) -> list[list[tuple[int, int, str, float, int, bool]]]:
    """``(start, end, lang, confidence, words, sure)`` of each stretch in one language, for each text.

    ``words`` counts those of sure sentences, or all where none is sure.
    """
    read = [[r for r in sentences(text) if r[2]] for text in texts]
    chances = model.posteriors([ws for parts in read for _, _, ws in parts])
    pooled = [k for k, (parts, text) in enumerate(zip(read, texts)) if not parts and text]
    letters = [_LETTERS.findall(texts[k].lower()) for k in pooled]
    # code is no prose: its words count as much as those of one short sentence
    chance = np.exp(model.totals(letters) * [[min(1.0, MIN_WORDS / max(1, len(ws)))] for ws in letters]) if letters else []
    plain = {k: (ws, c / c.sum()) for k, ws, c in zip(pooled, letters, chance)}
    out, at = [], 0
    for k, (parts, text) in enumerate(zip(read, texts)):
        p = chances[at : at + len(parts)]
        at += len(parts)
        best = p.argmax(1) if len(parts) else []
        sure = [len(ws) >= MIN_WORDS and p[i, best[i]] >= SURE for i, (_, _, ws) in enumerate(parts)]
        if any(sure):
            own: list[list] = []
            lead = parts[0][0]
            lang = int(best[sure.index(True)])
            for i, (a, b, ws) in enumerate(parts):
                if sure[i] and (not own or own[-1][2] != best[i]):
                    lang = int(best[i])
                    if not own and i:  # what came before the first sure sentence
                        n = sum(len(w) for _, _, w in parts[:i])
                        own.append([lead, b, lang, sum(p[j, lang] * len(parts[j][2]) for j in range(i)), n, 0])
                    else:
                        own.append([a, b, lang, 0.0, 0, 0])
                if own:
                    last = own[-1]
                    last[1], last[3], last[4], last[5] = b, last[3] + p[i, last[2]] * len(ws), last[4] + len(ws), last[5] + sure[i] * len(ws)
            out.append([(a, b, model.langs[g], float(c / n), w, True) for a, b, g, c, n, w in own])
        elif parts or (k in plain and plain[k][0]):
            ws, chance = ([w for _, _, x in parts for w in x], model.posteriors([[w for _, _, x in parts for w in x]])[0]) if parts else plain[k]
            out.append([(parts[0][0] if parts else 0, parts[-1][1] if parts else len(text), model.langs[int(chance.argmax())], float(chance.max()), len(ws), False)])
        else:
            out.append([])
    return out


def _reader(model: Model) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                part = batch.iloc[a : a + 256]
                rows = [(i, label, k, *s) for i, label, found in zip(part["doc_id"], part["label"], segments(part["text"].to_list(), model)) for k, s in enumerate(found)]
                yield pd.DataFrame(rows, columns=["doc_id", "label", "segment", "start", "end", "lang", "confidence", "n_words", "sure"])

    return run


def fit(documents: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> Model:
    """Model from at most about ``sample`` labelled documents (all of them where there are fewer)."""
    rows = documents.filter(F.col(text).isNotNull() & F.col(label).isNotNull())
    n = rows.count()
    if n > sample:
        rows = rows.filter(F.pmod(F.xxhash64(doc_id, F.lit("langid")), F.lit(1 << 20)) < int((1 << 20) * sample / n))
    return train([tuple(r) for r in rows.select(label, text).collect()])


def language_segments(documents: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """``doc_id, label, segment, start, end, lang, confidence, n_words, sure``; offsets count characters."""
    rows = documents.filter(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    return rows.mapInPandas(_reader(model), "doc_id long, label string, segment int, start long, end long, lang string, confidence double, n_words long, sure boolean")


def document_languages(found: DataFrame) -> DataFrame:
    """``doc_id, label, lang, confidence, n_words, sure, is_main, n_langs`` for each language of a document."""
    per = found.groupBy("doc_id", "label", "lang").agg((F.sum(F.col("confidence") * F.col("n_words")) / F.sum("n_words")).alias("confidence"), F.sum("n_words").alias("n_words"), F.max("sure").alias("sure"))
    top = per.groupBy("doc_id", "label").agg(F.min(F.struct((-F.col("n_words")).alias("n"), "lang")).alias("_top"), F.count(F.lit(1)).alias("n_langs"))
    same = [F.col("p.doc_id") == F.col("t.doc_id"), F.col("p.label").eqNullSafe(F.col("t.label"))]
    return per.alias("p").join(top.alias("t"), same).select("p.*", (F.col("lang") == F.col("t._top.lang")).alias("is_main"), "t.n_langs")


def mislabelled(languages: DataFrame) -> DataFrame:
    """``doc_id, lang``: every language of the documents of prose whose label is absent or wrong, or that mix languages."""

    @F.pandas_udf("string")
    def normal(labels: pd.Series) -> pd.Series:
        return labels.map(lambda x: normal_label(None if pd.isna(x) else x))

    sure = languages.filter("sure")
    labels = sure.select("label").distinct().withColumn("_label", normal("label"))
    rows = sure.alias("l").join(labels.alias("n"), F.col("l.label").eqNullSafe(F.col("n.label"))).select("l.*", "n._label")
    wrong = rows.groupBy("doc_id", "label").agg(F.max((F.col("n_langs") > 1) | F.col("_label").isNull() | (F.col("is_main") & (F.col("_label") != F.col("lang")))).alias("_wrong")).filter("_wrong")
    return sure.alias("l").join(wrong.alias("w"), (F.col("l.doc_id") == F.col("w.doc_id")) & F.col("l.label").eqNullSafe(F.col("w.label"))).select("l.doc_id", "l.lang").distinct()
