import pytest
from pyspark.sql import functions as F

from lorestack.llm.mixture import expected_copies, fill, mix_sources
from lorestack.llm.tokenizer import VOCABULARY, PairIndexEncoder, count_tokens, encode_corpus

TEXTS = ["", None, "   ", "Hello, world!", "aaaaaaaaaaaaaaaaa", "naïve façade — 東京都 🙂🙂", "don't we'll\r\n\tx\n\n", "a" * 5000, "<|endoftext|> is text", "x y" * 3000, "नमस्ते दुनिया", "0123456789 3.14"]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_public_library(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r.doc_id: r.ids for r in encode_corpus(df, ["doc_id"]).collect()}
    assert got == {i: reference(t) for i, t in enumerate(TEXTS)}
    counts = {r.doc_id: r.tokens for r in count_tokens(df, ["doc_id"]).collect()}
    assert counts == {i: len(x) for i, x in got.items()}


def test_repeats_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted(map(str, encode_corpus(df, ["doc_id"]).collect())) == sorted(map(str, [*[r for r in encode_corpus(df, ["doc_id"]).collect()]]))
    assert encode_corpus(df, ["doc_id"]).count() == 3 and encode_corpus(df.limit(0), ["doc_id"]).count() == 0


def test_round_trip():
    encoder = PairIndexEncoder(open(VOCABULARY, "rb").read())
    offsets, ids = encoder.encode_texts(TEXTS)
    for i, text in enumerate(TEXTS):
        assert b"".join(encoder.bytes_of[x] for x in ids[offsets[i] : offsets[i + 1]]).decode() == (text or "")


def test_fill_shares_what_capped_sources_leave():
    out = fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 1000, "c": 1000}, 100)
    assert out["a"] == 10 and abs(out["b"] - 54) < 1e-9 and abs(out["c"] - 36) < 1e-9
    assert sum(expected_copies({3: 80, 5: 320}, 300, 2, 0.5)[b] * t for b, t in {3: 80, 5: 320}.items()) == pytest.approx(300)


def test_mixture_reaches_shares_and_caps(spark):
    rows = [(i, "word " * (1 + i % 40), "big" if i % 3 else "small") for i in range(900)] + [(1000 + i, "few words here", "tiny") for i in range(5)]
    rows += [(2000, None, "big"), (2001, "", "small"), (2002, "unlisted text", "other"), (2003, "no source", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("tokens", F.lit(-1)).withColumn("copies", F.lit("clash"))
    targets = spark.createDataFrame([("big", 0.3, 1), ("small", 0.6, 3), ("tiny", 0.05, 2), ("gone", 0.05, 9)], "source string, weight double, max_repeats int")
    selection, report = mix_sources(docs, targets)
    by = {r.source: r for r in report.collect()}
    total = sum(r.tokens for r in by.values())
    picked = selection.collect()
    assert len({r.doc_id for r in picked}) == len(picked) and all(1 <= r.copies <= by[r.source].max_repeats for r in picked)
    assert abs(sum(r.tokens * r.copies for r in picked) - total) <= 90
    assert by["gone"].selected_tokens == 0 and not by["gone"].reached and by["tiny"].selected_tokens == 2 * by["tiny"].tokens
    assert by["small"].actual_share / by["big"].actual_share == pytest.approx(2, rel=0.02)
    again = mix_sources(docs, targets)[0].collect()
    assert sorted(again) == sorted(picked)


def test_empty_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, weight double, max_repeats int")
    selection, report = mix_sources(docs, targets)
    assert selection.count() == 0 and report.first().selected_tokens == 0
