import random
import time

from pyspark.sql import functions as F

from trellis.operators import memory as m


def brute(rows, t):
    sets = {}
    for i, c in rows:
        if c is not None:
            w = tuple(sorted(set(c.lower().split())))
            sets[w] = min(i, sets.get(w, i))
    out = {}
    items = [(r, set(w)) for w, r in sets.items()]
    for a, x in items:
        for b, y in items:
            if a < b and (len(x & y) / len(x | y) if x | y else 1.0) > t:
                out[a, b] = len(x & y) / len(x | y)
    return out


def test_near_duplicates_are_complete(spark):
    r = random.Random(3)
    base = [[f"w{r.randrange(60)}" for _ in range(r.randrange(4, 25))] for _ in range(25)]
    rows = []
    for i in range(160):
        ws = list(r.choice(base))
        for _ in range(r.randrange(0, 3)):
            ws[r.randrange(len(ws))] = f"w{r.randrange(60)}"
        rows.append((f"{i:04}", "  ".join(ws)))
    rows += [("9000", None), ("9001", ""), ("9002", " "), ("9003", rows[0][1].upper())]
    df = spark.createDataFrame(rows, "id string, content string")
    for t in (0.5, 0.8, 0.85):
        got = {(x.a, x.b): x.similarity for x in m.near_duplicates(df, t).collect()}
        want = brute(rows, t)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got) and got


def _store(spark, rows):
    cols = "id string, content string, tags array<string>, type string, created string, priority boolean, promoted boolean, demoted boolean, recall_count int, expires_at string, project string, global boolean"
    return spark.createDataFrame([(i, c, t, k, cr, p, pr, d, n, e, None, True) for i, c, t, k, cr, p, pr, d, n, e in rows], cols)


def test_terms_and_scores(spark):
    assert list(m.query_terms("Yes, please: the fetchInBatches (see `a/b.ts`) fetchinbatches")) == ["fetchinbatches", "see", "a/b.ts"]
    df = _store(spark, [("1" * 8, "Sure, sure and sure again sure", [], "bug", "2024", False, False, False, 0, None), ("2" * 8, "nothing", ["src/Stub", None], "stub", "2025", False, False, False, 0, None), ("3" * 8, None, None, None, None, False, False, False, 0, None)])
    assert [(r.id[0], r.score) for r in m.search(df, "sure").collect()] == [("1", 1.3)]
    assert [(r.id[0], r.score) for r in m.search(df, "stub").collect()] == [("2", 3.5)]
    assert m.search(df, "the and").count() == 0 and m.search(df, " ").count() == 3
    assert [r.id for r in m.by_prefix(df, "11111111").collect()] == ["1" * 8]


def test_upkeep(spark):
    a = " ".join(f"w{i}" for i in range(20))
    rows = [
        ("a", a, [], "bug", "2024-01-01", False, False, False, 1, "2024-02-01 00:00:00"),
        ("b", a + " extra", [], "bug", "2024-01-02", False, False, False, 4, "bad date"),
        ("c", "[commit] x", [], "bug", "2024-01-03", True, False, False, 0, None),
        ("d", "alone in the world", [], "bug", "2024-01-04", False, False, True, 9, "2030-01-01 00:00:00"),
    ]
    df = _store(spark, rows)
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(m.unexpired(df, "2024-03-01 00:00:00")) == ["b", "c", "d"]
    assert ids(m.without_commits(df)) == ["a", "b", "d"]
    assert ids(m.auto_promote(df).filter("promoted")) == ["b"] and ids(m.auto_promote(df, 0).filter("promoted")) == []
    kept = m.greedy_merge(df)
    assert ids(kept) == ["b", "c", "d"]
    assert ids(m.greedy_merge(df.join(kept, "id"))) == ["b", "c", "d"]
    assert ids(m.new_entries(df.filter("id in ('b', 'd')"), df.filter("id in ('a', 'c')"))) == ["d"]
    assert ids(m.greedy_merge(df.limit(0))) == []
    assert [r.recall_count for r in m.record_recalls(df, df.select("id").filter(F.col("id") == "a")).orderBy("id").collect()] == [2, 4, 0, 9]


NAMES = ["fetchInBatches", "FEATURE_GRADES", "scripts/check-items.ts", "config.embedding.mode", "web-app", "web-app:direct", "@scope/pkg", "ADR-0042", "JSON"]
WORDS = ["tests", "Docker", "sure", "is", "x", "API", "est-ce", "peut-être", "follow-up", "built-in"]


def test_names_and_terms():
    assert all(map(m.looks_like_name, NAMES)) and not any(map(m.looks_like_name, WORDS))
    assert m.words_of("(see `a/b.ts`), SOURCE={}.") == ["see", "a/b.ts", "SOURCE"]
    assert list(m.query_terms("how should we do this for the retryPolicy")) == ["retrypolicy"]
    assert m.query_terms("yes please") == m.query_terms("oui") == {} and len(set(m.STOPWORDS)) == 191
    assert m.query_terms("Config, config.ts and CONFIG") == {"config": True, "config.ts": True}


def test_term_scores(spark):
    def score(content, term, name, tags=(), kind="decision"):
        df = spark.createDataFrame([(content, list(tags), kind)], "content string, tags array<string>, type string")
        return round(df.select(m.term_score(term, name).alias("s")).first().s, 6)

    assert score("make sure it runs", "sure", False) == 1.1
    assert score("call fetchInBatches for pages", "fetchinbatches", True) == 3.1
    assert score("the checks are in check-items.ts now", "scripts/check-items.ts", True) == 2.0
    assert score("a stubborn case", "stub", False) == 1.1
    assert score("write a test", "a::run", True) == 0 and score("see the docs", "the:x", True) == 0
    assert score("go to db", "db", False) == 1.1 and score("dbase", "db", False) == 0 and score("see the db.", "db", False) == 1.1
    assert score(None, "bug", False, kind="bug") == 1.5 and score("x", "direct", False, ["Web-App:direct"]) == 2.0
    assert score("run run run run", "run", False) == 1.3


def shuffled(spark, run):
    """What ``run`` returns, and the MB that it shuffled."""

    def written():
        time.sleep(0.5)
        each = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(each.apply(i).totalShuffleWrite() for i in range(each.size())) / 1e6

    before = written()
    return run(), written() - before


def common_words(n):
    """Texts of the same 60 words; each tenth one is the one before with a word changed."""
    r = random.Random(7)
    rows = [r.sample([f"word{i}" for i in range(60)], 30) for _ in range(n)]
    for i in range(1, n, 10):
        rows[i] = [*rows[i - 1][:-1], f"only{i}"]
    return [(f"{i:05}", " ".join(ws)) for i, ws in enumerate(rows)]


def test_new_entries_of_common_words(spark):
    rows = common_words(2000)
    rows = [(i, None if i == "00005" else " " if i == "00015" else c) for i, c in rows] + [("90001", "\t"), ("90002", " ".join(sorted(rows[0][1].split())).upper())]
    df = spark.createDataFrame(rows, "id string, content string")
    batch = "substring(id, 5, 1) in ('1', '5') or id >= '90000'"
    new, old = df.filter(batch), df.filter(f"not ({batch})").union(spark.createDataFrame([("90003", "")], df.schema))
    got, mb = shuffled(spark, lambda: {r.id for r in m.new_entries(new, old).collect()})
    assert got == {i for i, c in rows if i[4] == "5" and i not in ("00005", "00015")} and mb < 8


def plain_merge(rows, t=0.85):
    """The rule of ``greedy_merge`` over all entries, for entries of one rank and age."""
    best, rep = {}, {}
    for i, c, n in rows:
        w = frozenset(c.lower().split())
        best[w], rep[w] = max(best.get(w, (n, i)), (n, i)), min(rep.get(w, i), i)
    kept = []
    for w in sorted(rep, key=rep.get):
        for k, v in enumerate(kept):
            if (len(v & w) / len(v | w) if v | w else 1.0) > t:
                if best[w][0] >= best[v][0]:
                    kept[k] = w
                break
        else:
            kept.append(w)
    return sorted(best[w][1] for w in kept)


def test_merge_of_common_words(spark):
    rows = [(i, c, int(i) % 5) for i, c in common_words(2000)]
    chain = [f"c{i}" for i in range(40)]
    rows += [(f"9{i:04}", " ".join(chain[i : i + 30]), i * 7 % 5) for i in range(10)] + [("95000", "", 1), ("95001", " ", 0)]
    df = _store(spark, [(i, c, [], "bug", "2024", False, False, False, n, None) for i, c, n in rows])
    got, mb = shuffled(spark, lambda: sorted(r.id for r in m.greedy_merge(df).collect()))
    assert got == plain_merge(rows) and len(got) < 1900 and mb < 8


def test_near_duplicates_of_common_words(spark):
    rows = common_words(2000)
    df = spark.createDataFrame(rows, "id string, content string")
    got, mb = shuffled(spark, lambda: {(r.a, r.b) for r in m.near_duplicates(df).collect()})
    assert got == set(brute(rows, 0.85)) and len(got) >= 200 and mb < 8
