import random

from hypothesis import given, settings
from hypothesis import strategies as st

from trellis.llm.chunking import CONTEXT, cut, oversized, split_files, split_items


def pieces_of(text, size, limit, overlap):
    data = text.encode()
    back = limit // 2 + overlap + overlap // 4 + CONTEXT
    out = []
    for r in range(-(-len(data) // size)):
        start = max(0, r * size - back)
        out += cut(data[start : (r + 1) * size + 1], start, len(data), r, size, limit, overlap)
    return data, list(zip(out[::3], out[1::3], out[2::3]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "word ", "é", "汉字", "\n", "\n\n", "End. ", "🙂", " " * 9]), min_size=1, max_size=400), st.sampled_from([64, 100, 256]))
def test_pieces_cover(parts, size):
    text = "".join(parts)
    data, got = pieces_of(text, size, 32, 8)
    assert b"".join(data[n:e] for _, n, e in got) == data
    for (a, n, e), last in zip(got, [None, *got]):
        assert e - a <= 32 and a <= n < e
        data[a:e].decode()
        if last:
            assert n == last[2] and 0 <= n - a <= 11
    assert got[0][0] == 0


def test_prefers_blocks():
    text = "\n\n".join("x" * 20 + "\n" + "y" * 20 for _ in range(20))
    data, got = pieces_of(text, 1 << 16, 120, 0)
    assert all(data[:e].endswith(b"\n\n") for _, _, e in got[:-1])


def test_spark_ranges_and_nulls(spark):
    r = random.Random(1)
    texts = ["".join(r.choice(["wort ", "größe\n", "end. ", "\n\n", "код "]) for _ in range(n)) for n in (5, 900, 4000)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(1, texts[1], "x"), (9, None, "x"), (10, "", "x"), (None, texts[1], "x")]
    df = spark.createDataFrame(rows, "id long, text string, piece string")
    for size in (4096, 1 << 16):
        got = split_items(df, ["id"], "text", 1000, 100, size).collect()
        for key, text in ((1, texts[1]), (2, texts[2]), (None, texts[1])):
            own = sorted((x for x in got if x.id == key), key=lambda x: x.piece_no)
            assert [x.piece_no for x in own] == list(range(1, len(own) + 1))
            assert b"".join(x.piece.encode()[x.new_byte - x.start_byte :] for x in own) == text.encode()
            assert max(len(x.piece.encode()) for x in own) <= 1000
        assert {x.id for x in got} == {1, 2, None}
    assert split_items(df.limit(0), ["id"], "text").count() == 0


def whole(rows):
    own = sorted(rows, key=lambda x: x.piece_no)
    assert [x.piece_no for x in own] == list(range(1, len(own) + 1)) and max(len(x.piece.encode()) for x in own) <= 2000
    assert all(100 <= b.new_byte - b.start_byte <= 300 and b.new_byte == a.end_byte for a, b in zip(own, own[1:]))
    return b"".join(x.piece.encode()[x.new_byte - x.start_byte :] for x in own)


def test_items_and_files_of_megabytes(spark, tmp_path):
    r = random.Random(6)
    text = "".join(r.choice(["wort ", "größe\n", "end. ", "\n\n", "код ", "\n" + " " * 200 + "\n"]) for _ in range(300_000))
    df = spark.createDataFrame([(1, text), (2, text[:7_000]), (2, text[:9_000]), (3, "x" * 30_000)], "id long, text string")
    got = split_items(df, ["id"], "text").collect()
    assert whole([x for x in got if x.id == 1]) == text.encode() and whole([x for x in got if x.id == 3]) == b"x" * 30_000
    assert {x.id for x in oversized(split_items(df, ["id"], "text"), ["id"]).collect()} == {1, 2, 3}
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text(text)
    (tmp_path / "b.txt").write_text("short")
    for size in (1 << 16, 1 << 24):
        rows = split_files(spark, str(tmp_path), range_bytes=size).collect()
        assert {x.path.rsplit("/", 1)[1] for x in rows} == {"a.txt"} and whole(rows) == text.encode()


def test_long_blank_lines_are_boundaries():
    text = ("x" * 300 + "\n" + " " * 150 + "\n") * 40
    data, got = pieces_of(text, 4096, 1000, 0)
    assert all(data[:e].endswith(b" \n") for _, _, e in got[:-1])
