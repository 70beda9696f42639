import random
import textwrap

import numpy as np

from lorestack.llm import scans, spam
from lorestack.llm.trees import Bagged, Boosted

WORDS = "harbour meeting archive forecast measurement planning committee workshop laboratory inventory retention calibration summary evidence pipeline register".split()


def prose(r, n):
    return " ".join(f"The {r.choice(WORDS)} of the {r.choice(WORDS)} was checked before the {r.choice(WORDS)} and the {r.choice(WORDS)} became final." for _ in range(n))


def scanned(r):
    lines, truth, page = [], [], r.randint(20, 80)
    for line in textwrap.wrap(prose(r, 30), 60):
        if len(lines) % 25 == 0:
            page += 1
            truth.append((len(lines) + 1, "furniture"))
            lines.append(f"Harbour Papers   {page}")
        if r.random() < 0.2 and "the" in line.split():
            line = " ".join("tbe" if w == "the" else w for w in line.split())
            truth.append((len(lines) + 1, "misread"))
        lines.append(line)
    i = next(k for k, x in enumerate(lines) if k > 3 and lines[k + 1].split()[0].isalpha() and len(lines[k + 1].split()[0]) > 6 and not x.startswith("Harbour Papers"))
    word, *rest = lines[i + 1].split()
    lines[i], lines[i + 1] = f"{lines[i]} {word[:3]}-", " ".join([word[3:], *rest])
    return "\n".join(lines), [*truth, (i + 1, "split_word")]


def test_defects_of_scanned_pages(spark):
    r = random.Random(3)
    rows, truth = [(f"c{i}", None, prose(r, 12)) for i in range(40)], set()
    for i in range(12):
        text, found = scanned(r)
        rows.append((f"s{i}", "Notes", text))
        truth |= {(f"s{i}", *f) for f in found}
    rows += [("n", None, None), ("e", None, ""), ("t", None, "| a | b |\n" * 20)]
    df = spark.createDataFrame([*rows, rows[-5]], "id string, title string, text string")
    defects = scans.scan_defects(df)
    got = {(x.id, x.line_no, x.defect) for x in defects.collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got & truth) >= 0.9 * len(got)
    texts = {x.id: x.text for x in scans.repair_texts(df, defects).collect()}
    assert set(texts) == {f"s{i}" for i in range(12)} and not any("tbe" in t or "Papers" in t for t in texts.values())
    assert scans.scan_defects(df.limit(0)).count() == 0


def test_shapes_and_numbers():
    assert scans.shape("rnodern") == scans.shape("modern") and scans.shape("@fter") == scans.shape("after") and scans.shape("hacl") == scans.shape("had")
    assert scans.number_value("xiv") == 14 and scans.number_value("1O2") == 102 and scans.number_value("word") is None


def test_filler_pages(spark):
    r = random.Random(1)
    good = [prose(r, 8) for _ in range(40)] + ["\n".join(f"[{h:02}:10] ana: see http://a.example/{h}" for h in range(20)), "\n".join(f"2025-01-{d:02} INFO batch took {d}ms" for d in range(1, 28))]
    bad = ["cheap desk lamp best desk lamp buy desk lamp online " * r.randint(5, 20) for _ in range(10)] + ["\n".join(f"http://x{i}.example/page" for i in range(30)) for _ in range(5)] + ["\n".join(f"SKU {i} desk lamp 9.99 SALE tags: cheap, new" for i in range(20))] * 3
    rows = [(i, t, "web" if i >= len(good) else "notes") for i, t in enumerate(good + bad)] + [(900, None, "web"), (901, "", None), (902, " \n", "web")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.key for x in spam.score_pages(df).filter("score > 0.5").collect()}
    assert got == set(range(len(good), len(good) + len(bad)))
    assert spam.score_pages(df.limit(0)).count() == 0


def test_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.random((600, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    for model in (Bagged.fit(x, y), Boosted.fit(x, y)):
        assert ((model.predict(x) > 0.5) == y).mean() > 0.95


def test_misread_words_are_found_though_some_clean_text_has_them(spark):
    known = ["earlier", "compass", "harbour", "modern", "turbine", "festival", "kitchen", "archive", "forecast", "schedule", "measure", "station", "building", "calendar", "delivery", "council", "project", "window", "garden", "budget", "library", "minutes", "morning", "quarter", "railway", "shelter", "therefore", "village", "weather", "question"]
    for size in (1, 10):  # alike at every size
        rows = [(w, 700 * size, 300 * size, 0) for w in known] + [("modem", 70 * size, 30 * size, 0), ("e@rlier", size, 3 * size, 0), ("c0mpass", size, 2 * size, 0), ("harb0ur", 0, 2 * size, 0)]
        counts = spark.createDataFrame(rows, "word string, clean long, scanned long, cut long")
        assert {tuple(r) for r in scans.find_corrections(counts).collect()} == {("e@rlier", "earlier"), ("c0mpass", "compass"), ("harb0ur", "harbour")}


def test_links_count_in_any_case_and_sentences_in_any_script():
    from lorestack.llm.spam import FEATURES, page_features

    share = lambda text, name: page_features(text)[FEATURES.index(name)]
    lines = "\n".join(f"http://site{i}.example/page/{i}" for i in range(30))
    assert share(lines, "links") == share(lines.upper(), "links") == 1.0
    assert share("\n".join(f"{i}. best water filter http://site{i}.example/page/{i}" for i in range(9)), "links") > 0.9
    assert share("なぜ記録が先に訂正されたのか、誰も説明できない。LIB-1016が終わるまで倉庫は保留とする。" * 4, "sentences") == 1.0
    assert share("Tags: solar charger | travel mug | seat cover | loan offer | label printer", "goods") == 1.0


def test_every_repeated_line_and_page_number_of_a_text_is_looked_at():
    r = random.Random(5)
    body = iter(textwrap.wrap(prose(r, 700), 60))
    heads = ["".join(r.choice("abcdefgh") for _ in range(r.randint(9, 30))) for _ in range(30)]
    lines, spoilt, numbered = [], [], []
    for page in range(4):
        numbered.append(len(lines))
        lines.append(f"Quay   {page + 41}")
        for k, head in enumerate(heads):
            if page == 3 and k >= 15:
                spoilt.append(len(lines))
                head = head[:4] + "x" + head[5:]
            lines += [*[head] * (1 if k >= 15 else 2), *(next(body) for _ in range(8))]  # the spoilt ones aren't among the commonest
        lines += [f"Table {k}   {1000 + 50 * k}" for k in range(9)]
    page = scans.read_page("\n".join(lines), None)
    row = {i: dict(zip(scans.LINE_FEATURES, x)) for i, x in zip(page.candidates, page.features)}
    assert page.scanned and len(spoilt) == 15 and all(i in row and row[i]["repeats"] == 3 for i in spoilt)
    assert all(row[i]["in_sequence"] == 1 for i in numbered)
    words = [w for n in (5, 7, 12, 40) for w in ("".join(r.choice("abc") for _ in range(n)) for _ in range(30))]
    words = list(dict.fromkeys(words))
    alike = scans.Alike([(w, 1000 - k) for k, w in enumerate(words)])
    for own in [w[1:] + "a" for w in words] + [w[1] + w[0] + w[2:-2] + w[-1] + w[-2] for w in words] + [w + "cab" for w in words]:
        if len(own) > 6:
            assert alike.count(own) == max((1000 - k for k, w in enumerate(words) if scans.slips(w, own, 3) <= 3), default=0)


KNOWN = ["earlier", "compass", "harbour", "modern", "turbine", "festival", "kitchen", "archive", "forecast", "schedule", "measure", "station", "building", "calendar", "delivery", "council", "project", "window", "garden", "budget", "library", "minutes", "morning", "quarter", "railway", "shelter", "therefore", "village", "weather", "question"]


def test_no_candidate_is_dropped_for_its_length_or_a_rarer_one(spark):
    long = "donaudampfschifffahrtselektrizitatenhauptbetriebswerk"
    rows = [(w, 700, 300, 0) for w in [*KNOWN, "mammogram", "the", long]] + [("fue", 3, 0, 0), ("rnarnrnograrn", 0, 3, 0), ("fhe", 0, 40, 0), (long.replace("o", "0", 1), 0, 2, 0)]
    counts = spark.createDataFrame(rows, "word string, clean long, scanned long, cut long")
    got = {tuple(r) for r in scans.find_corrections(counts).collect()}
    assert got == {("rnarnrnograrn", "mammogram"), ("fhe", "the"), (long.replace("o", "0", 1), long)}
    texts = [("c", None, f"A {long} is old."), ("s", None, "\n".join(textwrap.wrap(f"{prose(random.Random(2), 4)} A {long} is old.", 70)))]
    counts = {r.word: (r.clean, r.scanned) for r in scans.word_counts(scans.survey(spark.createDataFrame(texts, "id string, title string, text string"))).collect()}
    assert counts[long] == (1, 1)


def test_all_known_words_that_share_a_gram_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(scans, "LEFT", 30)
    monkeypatch.setattr(scans, "RIGHT", 50)
    r = random.Random(7)
    known = {w: r.randint(1, 2000) for w in KNOWN} | {"".join(r.choice("aeilmnrst") for _ in range(r.randint(2, 9))): r.randint(1, 900) for _ in range(120)} | {"long" * 20: 7}
    some = list(dict.fromkeys([w[:2] + r.choice("aeil1") + w[3:] for w in known] + ["long" * 19 + "1ong"]))
    ranker = scans.fit_ranker(list(known.items()))
    best = {}
    for w in some:
        others = [c for c in known if scans.shape(c) != scans.shape(w) and set(scans.grams(c)) & set(scans.grams(w))]
        p = ranker.predict(np.array([scans.pair_features(w, c, known[c]) for c in others]).reshape(-1, 10))
        best[w] = float(max(p, default=0.0))
    least = {w: best[w] if k % 3 == 0 else best[w] * (0.999 if k % 3 == 1 else 1.001) for k, w in enumerate(some)}
    shared = spark.sparkContext.broadcast(ranker)
    alike = spark.createDataFrame(list(least.items()), "word string, p double")
    got = sorted(x.word for x in scans.outranked(alike, spark.createDataFrame(list(known.items()), "right string, texts long"), shared).collect())
    assert got == sorted(w for w in some if best[w] > least[w]) and len(got) > 30


def test_misread_forms_of_misread_forms_are_followed_to_the_end(spark):
    steps = [(f"w{k}", f"w{k + 1}") for k in range(6)] + [("x", "w3")]
    got = scans.followed(spark.createDataFrame(steps, "word string, right string"))
    assert {tuple(r) for r in got.collect()} == {(w, "w6") for w, _ in steps}
