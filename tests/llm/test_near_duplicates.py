import random

import numpy as np
from pyspark.sql import functions as F

from lorestack.llm import near_duplicates as nd


def shingles(text, run):
    w = nd.WORD.findall((text or "").lower())
    return {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}


def corpus(seed=5):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(60):
        base = [r.choice(words) for _ in range(r.randint(8, 120))]
        for _ in range(r.randint(1, 4)):
            x = list(base)
            for _ in range(r.randint(0, len(x) // 12)):
                x[r.randrange(len(x))] = r.choice(words)
            rows.append(" ".join(x))
    return [*rows, None, "", "one two", "same text again and again " * 5, "Same text, again and again! " * 5]


def brute(texts, run, threshold):
    sets = [shingles(t, run) for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])}


def test_pairs_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").withColumn("class", F.lit("clash"))
    for run, threshold in ((3, 0.5), (5, 0.8)):
        got = {(r.a, r.b) for r in nd.key_pairs(*nd.similar_classes(df, "id", "text", threshold, run)).collect()}
        want = brute(texts, run, threshold)
        assert got <= want and len(got) >= 0.97 * len(want) and want


def test_groups_one_row_per_text(spark):
    df = spark.createDataFrame([(1, "a b c d e f g"), (2, "A b c, d e f g"), (3, "x y z u v w"), (4, None), (5, "")], "id int, text string")
    rows = {r.key: r for r in nd.duplicate_groups(df, "id", "text").collect()}
    assert set(rows) == {1, 2, 3} and rows[1].group == rows[2].group != rows[3].group and rows[1].links == 0
    assert nd.duplicate_groups(df.limit(0), "id", "text").count() == 0


def test_a_hot_group_is_split_and_whole(spark):
    base = [f"t{i}" for i in range(60)]
    texts = [" ".join([*base[:i], f"edit{i}", *base[i + 1 :]]) for i in range(60)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {(r.a, r.b) for r in nd.key_pairs(*nd.similar_classes(df, "id", "text", 0.7, 3)).collect()}
    assert got == brute(texts, 3, 0.7)


def test_signatures_estimate_similarity():
    a, b = set(range(100)), set(range(50, 150))
    s = nd.signatures([np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b)], 512)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.08
