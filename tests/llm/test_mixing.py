import base64
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import tiktoken

from trellis.llm.mixing import BITS, PATTERN, TOKENIZER, _parts, mix, nth_slots, progressions, quotas, shares


def test_quotas():
    got = quotas({"a": 100, "b": 10, "c": 1000}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.1, 1), "gone": (0.1, 9)}, 300)
    assert got["a"] == 100 and got["b"] == 20 and abs(got["c"] - 180) < 1e-9 and "gone" not in got
    assert quotas({}, {"a": (1.0, 1)}, 5) == {}


def encoder():
    with open(TOKENIZER, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("test", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer here")
def test_parts_have_the_tokens_of_the_whole():
    r, e = random.Random(3), encoder()
    for _ in range(60):
        text = "".join(r.choice(["wort", " ", "  ", "\n", "\t ", "'s", "größe", "12", "!?", " \n\n", "a" * 50, "\u00a0"]) for _ in range(r.randrange(1, 200)))
        parts = list(_parts(text, 20))
        assert "".join(parts) == text and sum(len(e.encode_ordinary(p)) for p in parts) == len(e.encode_ordinary(text))
    assert list(_parts("x" * 100, 20)) == ["x" * 100] and list(_parts("", 20)) == [""]


def test_slots_are_those_of_van_der_corput():
    bits, weights = 10, [300, 1, 723]
    point = lambda i: int(format(i % (1 << bits), f"0{bits}b")[::-1], 2)
    low = 0
    for w in weights:
        want = [i for i in range(5000) if low <= point(i) < low + w]
        got = nth_slots(np.arange(len(want)), *progressions(low, low + w, bits))
        assert got.tolist() == want
        low += w
    whole = progressions(0, 1 << BITS)
    assert nth_slots(np.array([0, 7, 1 << 40]), *whole).tolist() == [0, 7, 1 << 40]
    rare = progressions(5, 6)  # one point of 2 ** 48
    assert nth_slots(np.array([0, 1]), *rare).tolist() == [int(format(5, "048b")[::-1], 2), int(format(5, "048b")[::-1], 2) + (1 << 48)]


def test_mix(spark):
    docs = [(i, "word " * (5 + i % 40), "big", 1) for i in range(600)] + [(1000 + i, "other thing " * 9, "small", 1) for i in range(20)]
    docs += [(2000 + i, "and so on " * 12, "mid", 1) for i in range(150)] + [(3000, "x", None, 1), (3001, None, "mid", 1), (3002, "", "mid", 1), (3003, "no target", "other", 1)] + [(0, "word " * 5, "big", 2)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, slot int")
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.2, 3), ("mid", 0.28, 4), ("gone", 0.02, 5), ("big", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = mix(d, t, total_tokens=8000, block_tokens=100).collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    used, times = Counter(), Counter()
    for r in rows:
        used[r.source] += r.n_tokens
        times[r.doc_id] += 1
    assert max(n for i, n in times.items() if 1000 <= i < 2000) == 3 and max(n for i, n in times.items() if i < 1000) == 1
    blocks = defaultdict(set)
    for r in rows:
        blocks[r.slot].add(r.source)
    assert all(len(s) == 1 for s in blocks.values())
    order = sorted(blocks)
    for a in range(0, len(order) - 40, 10):  # every stretch is close to the shares
        n = Counter(next(iter(blocks[s])) for s in order[a : a + 40])
        whole = Counter(next(iter(s)) for s in blocks.values())
        assert all(abs(n[s] / 40 - whole[s] / len(order)) < 0.12 for s in whole)
    report = {r.source: r for r in shares(d, t, total_tokens=8000, block_tokens=100).collect()}
    assert set(report) == {"big", "small", "mid", "gone"} and report["gone"].tokens_used == 0
    assert {s: report[s].tokens_used for s in used} == dict(used) and abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9
    assert report["small"].most_repeats == 3
    assert mix(d.limit(0), t).count() == 0 and mix(d, t.limit(0)).count() == 0
    assert mix(d, t, with_text=True).filter("text is null").count() == 0
