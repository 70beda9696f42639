import random

import pytest
from pyspark.sql import functions as F

from lorestack.llm.split import split_files, split_oversized


def check(text, pieces, limit, overlap, start=0):
    pieces = sorted(pieces, key=lambda p: p.piece_no)
    assert [p.piece_no for p in pieces] == list(range(len(pieces)))
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for p in pieces:
        assert text[p.start : p.end] == p.piece and len(p.piece) <= limit
    for p, q in zip(pieces, pieces[1:]):
        assert 1 <= p.end - q.start <= overlap and p.start < q.start and p.end < q.end


def made(kind, n, seed):
    r = random.Random(seed)
    if kind == "blob":
        return "".join(r.choice("abcdXYZ+/09") for _ in range(n))
    if kind == "lines":
        return "".join(r.choice(["α", "word ", "long.word ", "\r\n", "\n", "。", "end. ", "é"]) for _ in range(n))
    return "\n\n".join("This is a sentence of text. " * r.randint(1, 30) for _ in range(n // 300))


@pytest.mark.parametrize("kind", ["blob", "lines", "prose"])
def test_pieces_keep_the_rules_over_many_ranges(spark, kind):
    texts = [made(kind, n, n) for n in (500, 2001, 9000, 30000)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, body string")
    by = {}
    for p in split_oversized(df, ["id"], "body", 400, 50, 1600).collect():
        by.setdefault(p.id, []).append(p)
    assert set(by) == {i for i, t in enumerate(texts) if len(t) > 400}
    for i, pieces in by.items():
        check(texts[i], pieces, 400, 50)
        if kind == "prose":
            assert all(p.boundary in ("paragraph", "line", "sentence", "end") for p in pieces)


def test_null_empty_and_short_texts_give_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 2000), (4, "x" * 2001)], "id int, text string").withColumn("start", F.lit("clash"))
    assert {r.id for r in split_oversized(df, ["id"], "text").collect()} == {4}
    assert split_oversized(df.limit(0), ["id"], "text").count() == 0


def test_files_are_cut_by_byte_ranges(spark, tmp_path):
    text = made("lines", 20000, 3)
    (tmp_path / "a.txt").write_bytes(text.encode())
    (tmp_path / "b.txt").write_bytes(b"short")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = sorted(split_files(spark, str(tmp_path), 400, 50, 4096).collect(), key=lambda r: (r.path, r.piece_no))
    raw = text.encode()
    a = [r for r in rows if r.path.endswith("a.txt")]
    assert [r.piece_no for r in a] == list(range(len(a))) and a[0].start == 0 and a[-1].end == len(raw)
    for r in a:
        assert raw[r.start : r.end].decode() == r.piece and len(r.piece) <= 400
    for p, q in zip(a, a[1:]):
        shared = len(raw[q.start : p.end].decode())
        assert 1 <= shared <= 50
    assert [r.piece for r in rows if r.path.endswith("b.txt")] == ["short"]


def test_words_are_kept_whole_at_any_limit(spark):
    text = "x" * 18000 + " " + "y" * 15000
    pieces = split_oversized(spark.createDataFrame([(1, text)], "id int, body string"), ["id"], "body", 20000, 200, 80000).orderBy("piece_no").collect()
    check(text, pieces, 20000, 200)
    assert pieces[0].end == 18001 and pieces[0].boundary == "word"
