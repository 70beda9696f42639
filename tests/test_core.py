import json
import sqlite3
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import history as H
from lorestack.operators.blocks import block_pairs
from lorestack.operators.components import connected_components
from lorestack.operators.graph import edges, reach, settle
from lorestack.operators.incremental import ConcurrentPublish, VersionedTarget, due_objects
from lorestack.operators.orphans import Reference, find_orphans, orphan_report
from lorestack.operators.retrieval import bm25
from lorestack.operators.search import intent_filter, parse_query, resolve_date, resolve_range
from lorestack.operators.vectors import InvertedLists, exact_search, recall
from lorestack.sources import readers
from lorestack.sources.tables import current_rows, current_wide

DAY = datetime(2025, 1, 1)


def day(n):
    return DAY + timedelta(days=n)


# --- references to records that do not exist ---------------------------------------------------------------------------
def orphan_tables(spark):
    child = spark.createDataFrame(
        [("c1", " P1\t", day(0), day(1)), ("c1", " P1\t", day(0), day(2)), ("c2", "nope", day(40), day(1)), ("c3", None, day(0), day(1)), ("c4", " \t", day(0), day(1)), ("c5", "p2", day(0), day(1)), ("c6", "p3", None, day(1)), ("c7", "p1", day(0), None)],
        "id string, ref string, created_at timestamp_ntz, ingested_at timestamp_ntz",
    ).withColumn("key", F.lit("clash"))
    parent = spark.createDataFrame([("p1", day(1)), ("P1", day(9)), ("p2", day(5)), ("p3", day(0))], "id string, ingested_at timestamp_ntz")
    return child, parent


def test_orphans_missing_late_and_tidy(spark):
    child, parent = orphan_tables(spark)
    found = find_orphans({"child": child}, {"parent": parent}, [Reference("child", "ref", "parent")])
    assert {(r.record_id, r.reason) for r in found.collect()} == {("c2", "missing"), ("c5", "late")}
    report = {(r.month, r.orphans) for r in orphan_report(found).collect()}
    assert report == {("2025-02", 1), ("2025-01", 1)}


def test_orphans_of_empty_tables(spark):
    child, parent = orphan_tables(spark)
    refs = [Reference("child", "ref", "parent")]
    assert find_orphans({"child": child.limit(0)}, {"parent": parent}, refs).count() == 0
    assert {r.reason for r in find_orphans({"child": child}, {"parent": parent.limit(0)}, refs).collect()} == {"missing"}


def test_orphans_of_a_hot_key(spark):
    child = spark.range(3000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("ref"), F.lit(day(0)).cast("timestamp_ntz").alias("created_at"), F.lit(day(1)).cast("timestamp_ntz").alias("ingested_at"))
    parent = child.filter("ref <> 'hot'").select(F.col("ref").alias("id"), "ingested_at")
    assert find_orphans({"c": child}, {"p": parent}, [Reference("c", "ref", "p")]).count() == 1000


# --- processing only new or changed records ----------------------------------------------------------------------------
def test_due_objects(spark):
    objects = spark.createDataFrame(
        [("a", "w", 1, day(1)), ("a", "w", 2, day(5)), ("a", "w", 2, day(9)), ("b", "w", 1, day(3)), ("c", "v", 1, day(9)), ("d", None, 1, day(9)), ("e", "w", 3, day(6)), ("e", "w", 2, day(8))],
        "id string, workspace_id string, head_version int, ingested_at timestamp_ntz",
    )
    peers = spark.createDataFrame([("p", "w", day(5)), ("q", "w", None), ("r", "x", None), ("p", "w", day(5))], "id string, workspace_id string, last_pulled timestamp_ntz")
    receipts = spark.createDataFrame([("q", "a", 2, "committed"), ("q", "a", 2, "committed"), ("q", "b", 1, "rolled_back"), ("p", "e", 2, "committed")], "peer_id string, object_id string, version int, status string")
    got = {tuple(r) for r in due_objects(objects, peers, receipts).collect()}
    assert got == {("p", "e", 3), ("q", "b", 1), ("q", "e", 3)}
    assert due_objects(objects.limit(0), peers, receipts).count() == 0 and due_objects(objects, peers.limit(0), receipts).count() == 0


def test_target_is_the_state(spark, tmp_path):
    target = VersionedTarget(spark, str(tmp_path / "t"))
    rows = lambda *x: spark.createDataFrame(list(x), "id string, version int, v string")
    assert target.read() is None and target.version() == 0
    assert target.run(rows(("a", 1, "x"), ("b", 1, "y")), ["id"], "version", lambda d: d) == 1
    with pytest.raises(Exception):  # a run that breaks off in its work publishes nothing
        target.run(rows(("a", 2, "z"), ("c", 1, "z")), ["id"], "version", lambda d: d.withColumn("v", F.raise_error(F.lit("broken"))))
    assert target.version() == 1 and target.read().count() == 2
    seen = []
    assert target.run(rows(("a", 2, "z"), ("b", 1, "y"), ("c", 1, "z")), ["id"], "version", lambda d: seen.extend(d.collect()) or d) == 2
    assert {(r.id, r.version) for r in seen} == {("a", 2), ("c", 1)} and target.read().count() == 4
    assert target.run(rows(("a", 2, "z")), ["id"], "version", lambda d: d) == 2
    assert target.read(1).count() == 2
    with pytest.raises(ConcurrentPublish):
        target.publish([], 2)
    won, lost = [], []

    def publish():
        try:
            won.append(VersionedTarget(spark, str(tmp_path / "t")).publish([f"f{len(won)}"], 3))
        except ConcurrentPublish:
            lost.append(1)

    threads = [threading.Thread(target=publish) for _ in range(6)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 5 and target.version() == 3
    target.publish(target.folders(2), 4)
    assert target.compact(["id"], "version") == 5 and {(r.id, r.version) for r in target.read().collect()} == {("a", 2), ("b", 1), ("c", 1)} and target.read(2).count() == 4
    (tmp_path / "t" / "versions" / "6.json").write_text("{")  # a publisher that died
    assert target.version() == 5
    with pytest.raises(ValueError):
        target.run(rows(("k", 1, "z")), ["id"], "version", lambda d: d.drop("version"))


# --- tables, blocks, components ----------------------------------------------------------------------------------------
def test_current_rows(spark):
    df = spark.createDataFrame([("a", 2, day(5), "new", "x"), ("a", 2, day(3), "first", "x"), ("a", 1, day(9), "old", "x" * 30), ("a", 2, day(3), "first", "x"), (None, 1, day(1), "n", "x")], "id string, head_version int, ingested_at timestamp_ntz, title string, body string")
    assert [tuple(r) for r in current_rows(df, "title", "head_version").collect()] == [("a", "first", 2)]
    assert [tuple(r) for r in current_wide(df, "title", "body").collect()] == [("a", "first", "x")]
    assert current_wide(df, "body", where=F.length("body") > 20).count() == 0


def test_block_pairs_split_hot_blocks(spark):
    df = spark.createDataFrame([("h", i) for i in range(90)] + [("h", 1), ("s", 200), ("t", 1), ("t", 2), (None, 5)], "b string, m int")
    want = {(i, j) for i in range(90) for j in range(i + 1, 90)}
    assert {(r.a, r.b) for r in block_pairs(df, ["b"], "m", cell=16).collect()} == want
    # with every row counted, the block is known to be hot beforehand and travels in salted parts
    assert {(r.a, r.b) for r in block_pairs(df, ["b"], "m", cell=16, hot=20, sample=1).collect()} == want


def test_no_task_holds_a_block_of_a_million(spark):
    from lorestack.operators.blocks import hot_blocks

    df = spark.range(1_200_000).select(F.when(F.col("id") < 1_000_000, "h").otherwise(F.concat(F.lit("b"), F.col("id") % 1000)).alias("b"), F.col("id").alias("m"))
    hot = {r.b: r._est for r in hot_blocks(df, ["b"], "m").collect()}
    assert set(hot) == {"h"} and 900_000 < hot["h"] < 1_100_000
    salted = df.filter("b = 'h'").groupBy(F.pmod(F.xxhash64("m"), F.lit(-(-hot["h"] // 8192)))).count()
    assert salted.agg(F.max("count")).first()[0] < 12_000


def test_components_equal_union_find(spark):
    import random

    r = random.Random(2)
    rows = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, i) for i in range(3000, 3100)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in rows:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(rows, "src int, dst int")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src int, dst int")).count() == 0


# --- text, search language ---------------------------------------------------------------------------------------------
def test_stems_and_terms(spark):
    df = spark.createDataFrame([(w,) for w in "memories addresses status boxes caches dropping dropped exceed decide decided this string cat".split()], "w string")
    got = {r.w: r.s for r in df.select("w", T.stem(F.col("w")).alias("s")).collect()}
    assert got["memories"] == "memory" and got["addresses"] == "address" and got["status"] == "status" and got["boxes"] == "box" and got["dropping"] == got["dropped"] == "drop"
    assert got["exceed"] == "exceed" and got["decide"] == got["decided"] == "decid" and got["string"] == "string" and got["caches"] == "cach"
    row = spark.createDataFrame([("The GPT-4 of Éva, v1.2 -- 42 2025!",), (None,)], "t string").select(T.content_terms(F.col("t")).alias("t"), T.nfkd(F.col("t")).alias("n")).collect()
    assert row[0].t == ["gpt-4", "eva", "v1.2", "2025"] and row[1].t == [] and "eva" in row[0].n and row[1].n is None


def test_sentences_and_names(spark):
    s = spark.createDataFrame([("Dr. Smith went home. It was late! J. Doe agreed\n\nNext part",)], "t string").select(T.sentences(F.col("t")).alias("s")).first().s
    assert s == ["Dr. Smith went home.", "It was late!", "J. Doe agreed", "Next part"]
    pairs = [("ann lee", "ann lee", 1.0), ("ann lee", "ann lee smith", 0.8), ("a lee", "ann lee", 0.85), ("amy lee", "ann lee", 0.72), ("bob", "zoe", 0.0)]
    got = spark.createDataFrame(pairs, "a string, b string, w double").select("w", T.compare_names(F.col("a"), F.col("b")).alias("s")).collect()
    assert [r.s for r in got] == [r.w for r in got]


def test_query_language(spark):
    q = parse_query('kind:note type:Fact tag:"two words" "exact phrase" -draft after:2025-02 the harbour archive', "2025-06-15 12:00:00")
    assert q.kinds == ["note", "fact"] and q.tags == ["two words"] and q.phrases == ["exact phrase"] and q.exclude == ["draft"] and q.terms == ["harbour", "archive", "exact", "phrase"] and q.after == "2025-02-01 00:00:00"
    last = parse_query("what did we do last week?", "2025-06-15 12:00:00")
    assert (last.after, last.before, last.shape, last.temporal) == ("2025-06-08 00:00:00", "2025-06-14 23:59:59.999000", "question", True)
    assert parse_query("what was it originally?", "2025-06-15").retrospective and parse_query("kind:note", "2025-06-15").shape == "browse" and parse_query("the", "2025-06-15").terms == ["the"]
    q = parse_query("is:superseded is:confirmed before:2025 near:o1", "2025-06-15")
    assert q.states == ["superseded"] and q.reviews == ["confirmed"] and q.before == "2025-12-31 23:59:59.999000" and q.near == "o1"
    assert parse_query("in:2024-02 plan", "2025-06-15").before == "2024-02-29 23:59:59.999000" and parse_query("since:yesterday", "2025-06-15").after == "2025-06-14 00:00:00"
    assert resolve_date("2024-02", "end") == "2024-02-29 23:59:59.999000" and resolve_date("soon") is None and resolve_date("2024-13") is None
    assert resolve_range("3 months ago", "2025-06-15 00:00:00") == ("2025-03-17 00:00:00", "2025-06-15 23:59:59.999000") and resolve_range("some day", "2025-06-15") is None
    assert resolve_range("this-year", "2025-06-15 08:00:00") == ("2025-01-01 00:00:00", "2025-06-15 23:59:59.999000") and resolve_range("last month", "2025-03-15") == ("2025-02-01 00:00:00", "2025-02-28 23:59:59.999000")
    rows = [("note", "user", "fact", "active", "unreviewed", '{"tags":["x"]}', None, day(60), "a draft here"), ("Note ", "user", "fact", "active", "unreviewed", '{"tags":["x"]}', None, day(60), "fine"), ("note", "ai", "fact", "deleted", "confirmed", "{}", None, day(60), "gone"), ("note", "ai", "fact", "archived", "confirmed", "{}", None, day(60), "old")]
    df = spark.createDataFrame(rows, "kind string, origin string, epistemic string, state string, review string, attrs string, occurred_at timestamp_ntz, created_at timestamp_ntz, body string")
    pick = lambda text: [r.body for r in df.filter(intent_filter(parse_query(text, "2025-06-15"), F.col("body"))).collect()]
    assert pick("kind:note tag:X -draft") == ["fine"] and pick("state:archived") == ["old"] and pick("is:archived") == ["old"] and pick("is:deleted") == [] and len(pick("after:2025-02 before:2025-04")) == 2


# --- retrieval ---------------------------------------------------------------------------------------------------------
def test_bm25_equals_sqlite(spark):
    docs = [(i, t.split("|")[0], t.split("|")[1]) for i, t in enumerate(["harbour plan|the harbour was closed", "archive|old archive of the harbour office", "kitchen|no match here", "plan|plan plan plan", "empty|"])]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(title, text, tokenize='unicode61 remove_diacritics 2')")
    except sqlite3.OperationalError:
        pytest.skip("no FTS5")
    con.executemany("INSERT INTO t(rowid, title, text) VALUES (?, ?, ?)", docs)
    want = {i: round(-s, 6) for i, s in con.execute("SELECT rowid, bm25(t, 3.0, 1.0) FROM t WHERE t MATCH 'harbour OR plan'")}
    df = spark.createDataFrame(docs, "id int, title string, text string")
    queries = spark.createDataFrame([(1, "harbour plan")], "query_id int, query string")
    got = {r.key: r.score for r in bm25(df, "id", F.col("title"), F.col("text"), queries).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_vector_search(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    centers = rng.normal(size=(12, 16))
    data = [(i, [float(x) for x in centers[i % 12] + 0.2 * rng.normal(size=16)]) for i in range(900)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0])]
    df = spark.createDataFrame(data, "id int, v array<double>")
    queries = df.filter("id % 100 = 0")
    truth = exact_search(queries, df, "id", "v", k=5)
    x = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, v in data[:900]}
    for q in range(0, 900, 100):
        want = sorted(((-round(float(x[q] @ x[i]), 6), i) for i in x if i != q))[:5]
        assert [r.key for r in truth.filter(f"query_id = {q}").orderBy("rank").collect()] == [i for _, i in want]
    index = InvertedLists(df, "id", "v")
    assert recall(index.search(queries.filter("id < 900"), k=5), truth.filter("query_id < 900")).agg(F.avg("recall")).first()[0] >= 0.9


def test_inverted_lists_reach_their_recall_without_clusters(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    data = [(i, [float(x) for x in rng.normal(size=24 if i % 4 else 12)]) for i in range(1600)]
    df = spark.createDataFrame(data, "id int, v array<double>")
    queries = df.filter("id % 40 in (0, 1)")  # of both lengths
    index = InvertedLists(df, "id", "v")
    each = recall(index.search(queries), exact_search(queries, df, "id", "v"))
    assert index.table.count() == 1600 and each.count() == 80
    index.remove(df.filter("id < 10").select(F.col("id").alias("k")))
    assert index.table.count() == 1590 and not index.stale()
    index.add(df.filter("id < 500"))
    assert index.table.count() == 1600 and index.stale()
    near = exact_search(queries, df, "id", "v")
    from lorestack.operators.vectors import nearest

    assert nearest(queries, df, "id", "v").exceptAll(near).isEmpty()
    assert {r.s: r.r >= 0.9 for r in each.join(df, each.query_id == df.id).groupBy(F.size("v").alias("s")).agg(F.avg("recall").alias("r")).collect()} == {12: True, 24: True}


# --- graph, history, readers, streams ----------------------------------------------------------------------------------
def test_graph(spark):
    rows = [("e1", "a", "part_of", "b", "user", 0.5, day(1), day(1)), ("e1", "a", "part_of", "b", "user", 0.5, day(1), day(2)), ("e2", "b", "part_of", "c", "ai", 0.5, day(1), day(1)), ("e3", "a", "part_of", "b", "ai", 0.9, day(9), day(1)), ("e4", "c", "mentions", "c", "ai", 0.9, day(9), day(1)), ("e5", "c", "mentions", None, "ai", 0.9, day(9), day(1))]
    rel = edges(spark.createDataFrame(rows, "id string, src_id string, type string, dst_id string, origin string, confidence double, updated_at timestamp_ntz, ingested_at timestamp_ntz"))
    rel = rel.withColumn("state", F.lit("active"))
    assert {(r.id, r.depth) for r in reach(rel, spark.createDataFrame([("a",)], "id string")).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {(r.src_id, r.dst_id, r.id, r.asserted) for r in settle(rel).collect()} == {("a", "b", "e1", 2), ("b", "c", "e2", 1)}


def test_history(spark):
    rows = [("a", 1, day(1), "x"), ("a", 2, day(5), "y"), ("a", 1, day(7), "x"), ("b", 1, day(9), None)]
    df = spark.createDataFrame(rows, "id string, head_version int, ingested_at timestamp_ntz, title string")
    assert [tuple(r) for r in H.as_of(df, "2025-01-04 00:00:00", "title").collect()] == [("a", 1, "x")]
    assert [tuple(r) for r in H.changes(df, ["title"]).collect()] == [("a", 2, "title")]
    one = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 1, "h"), ("e", 1, "h")], "id string, head_version int, hash string")
    two = spark.createDataFrame([("a", 2, "h"), ("b", 1, "h"), ("c", 1, "g"), ("d", 1, "h"), ("e", 1, "h")], "id string, head_version int, hash string")
    assert {tuple(r) for r in H.sync_decisions(one, two).collect()} == {("a", "take"), ("b", "keep"), ("c", "conflict"), ("d", "insert"), ("e", "skip")}


def test_readers(spark, tmp_path):
    page = readers.read_html("<title>T &amp; U</title><script>no</script><h2>Head</h2><p>One <a href='u'>link</a><p>Two")
    assert page["title"] == "T & U" and page["headings"] == [{"level": 2, "text": "Head"}] and page["links"] == [{"href": "u", "text": "link"}] and "no" not in page["text"] and "One link\n\nTwo" in page["text"]
    assert readers.flatten_json(json.dumps({"a": {"b": [1, 2]}})) == "a.b[0]: 1\na.b[1]: 2" and readers.flatten_json("{bad") == "{bad"
    pdf = b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj << /Length 9 >> stream\nBT (Hello \\(you\\)) Tj T* [(a) -20 (b)] TJ ET\nendstream endobj"
    assert readers.read_pdf(pdf) == ("Hello (you)\nab", 1)
    for name, content in (("a.md", b"# x"), ("b.exe", b"x"), ("c.txt", b""), (".hidden.md", b"x")):
        (tmp_path / name).write_bytes(content)
    (tmp_path / "t.csv").write_text('n,v\n"a ""q""",1\nb,\n')
    plan = {r.path.rsplit("/", 1)[1]: r.reason for r in readers.plan_folder(readers.scan_folder(spark, str(tmp_path))).collect()}
    assert plan["a.md"] is None and plan["b.exe"] == "unsupported type"
    listed = spark.createDataFrame([("d/c.txt", 0), ("d/.h.md", 5), ("node_modules/a.md", 5), ("d/big.md", 1 << 30)], "path string, length long")
    assert [r.reason for r in readers.plan_folder(listed).collect()] == ["empty", "hidden", "skipped folder", "too large"]
    page = readers.read_markdown("---\ntitle: 'Front'\n---\n# Head\n**bold** [x](http://y \"t\") and [[Page]] [no] [")
    assert page["title"] == "Front" and page["text"] == "Head\nbold x and Page [no] [" and page["links"] == [{"href": "http://y", "text": "x"}] and page["pages"] == ["Page"] and page["headings"][0]["level"] == 1
    assert readers.read_csv('a,b\n"x ""q""",1\ny')["text"] == 'a: x "q"; b: 1\na: y; b: ' and readers.read_csv("") == {"text": "", "columns": [], "rows": 0} and readers.read_markdown(None)["title"] is None
    assert [r.line for r in readers.read_csv_rows(spark, str(tmp_path / "t.csv")).collect()] == ['n: a "q"; v: 1', "n: b; v: "]
    read = {r.path.rsplit("/", 1)[1]: r for r in readers.read_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert read["a.md"].text == "x" and read["a.md"].title == "x" and read["t.csv"].text.startswith("n: a") and read["a.md"].media_type == "text/markdown"


def test_streams(spark, tmp_path):
    from lorestack.streaming import streams

    source, rows = str(tmp_path / "in"), "id string, version int, text string, delta int"
    spark.createDataFrame([("a", 1, "harbour plan", 1), ("b", 1, "harbour log", 1)], rows).coalesce(1).write.mode("append").parquet(source)
    target = VersionedTarget(spark, str(tmp_path / "out"))
    run = lambda: streams.drain(streams.watch_table(spark, source, rows), target, ["id"], "version", lambda d: d, str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([("a", 2, "archive plan", 1), ("b", 1, "harbour log", 1)], rows).coalesce(1).write.mode("append").parquet(source)
    run()
    run()
    assert target.version() == 2 and sorted((r.id, r.version) for r in target.read().collect()) == [("a", 1), ("a", 2), ("b", 1)]
    query = streams.term_deltas(streams.watch_table(spark, source, rows)).writeStream.format("memory").queryName("deltas").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {r.term: r.df for r in spark.table("deltas").collect()}["harbour"] == 3


def test_chunks_and_names():
    from lorestack.operators import capture

    text = "\n\n".join("This is sentence number %d of a paragraph. " % i * 12 for i in range(6))
    parts = capture.chunk(text)
    assert len(parts) > 3 and all(n <= 220 and n == capture.count(p) for p, n, _ in parts) and capture.chunk("") == [] and capture.chunk(None) == []
    assert all(set(p.split()) <= set(text.split()) and text[at:].startswith(p.split(".")[0]) for p, _, at in parts)
    long = capture.chunk("word " * 2000)
    assert max(n for _, n, _ in long) <= 225 and sum(len(p.split()) for p, _, _ in long) == 2000
    spans = {s["text"]: s["type"] for s in capture.name_runs("we met Ana Lopez at our office in Coimbatore with Acme Group. Later it rained. The Atlas migration moved to Postgres 16 near Oxford Street. `Code Name` Memory Model")}
    assert spans == {"Ana Lopez": "name", "Coimbatore": "place", "Acme Group": "organisation", "Atlas": "project", "Postgres": "product", "Oxford Street": "place"}


def test_twins_of_the_text_kernels(spark):
    rows = [(t,) for t in ("Dr. Smith said e.g. This. See No. 5 and approx. 3! Then\n\nnew", "Éva ﬁne … がっこう２ gpt-4 v1.2 us Łódź", "memories addresses boxes dropped dropping decided status caches", None, "", "Ｆull\u00a0width. Next", "it ended ch. 4. J. Doe")]
    df = spark.createDataFrame(rows, "t string").select("t", T.sentences(F.col("t")).alias("s"), T.content_terms(F.col("t")).alias("c"), T.match_terms(F.col("t")).alias("m"), T.nfkd(F.col("t")).alias("n"), T.fold(F.col("t")).alias("f"))
    for r in df.collect():
        assert r.s == T.py_sentences(r.t) and r.c == T.py_content_terms(r.t) and r.m == [T.py_stem(x) for x in r.c]
        assert r.t is None or r.f == r.n == T.py_fold(r.t)
    assert "us" not in T.py_content_terms("us here")


def test_statements_and_contradictions():
    from lorestack.operators import extract as X

    assert X.classify("We decided to use Postgres for the billing archive.")[:2] == ("decision", "conclusion") and X.classify("Why is the harbour closed on Mondays?")[0] == "question"
    assert X.classify("It might rain on 3 days.") == ("hypothesis", "hypothesis", 0.48)
    assert X.numbers("38ms, 14 days, $1,200.50, 3 million, 5k, 40 mins and 95 minutes") == [("ms", 38.0), ("day", 14.0), ("currency", 1200.5), ("count", 3e6), ("count", 5e3), ("minute", 40.0), ("minute", 95.0)]
    firing = [("p99 latency of search at 38ms", "p99 latency of search at 88ms"), ("retention of logs is 14 days", "retention of logs is 30 days"), ("the archive import is safe", "the archive import is not safe"), ("budget for turbines is 5k", "budget for turbines is 7 thousand")]
    quiet = [("latency is 38ms today", "the harbour has 12 boats"), ("retention of logs is 30 days", "retention of logs is 30 days"), ("meeting took 60 minutes", "meeting took 60 mins"), ("the plan is safe", "cats sleep")]
    assert [X.contradiction(a, b)[0] is not None for a, b in firing + quiet] == [True] * 4 + [False] * 4
    assert X.structured("| a | b | c |") and X.structured('a = "x" b = 3') and X.structured("const { a }") and not X.structured("Plain prose with x = 3 in it.")
    assert X.answer_confidence([1.0], [["a", "b"]], 2) == 1.0 and X.answer_confidence([], [], 2) == 0.0


def test_long_claims_and_answers(spark):
    from lorestack.operators import extract as X

    text = "\n\n".join(f"We decided that harbour number {i} needs a new archive keeper soon. " * 3 for i in range(60))
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string")
    got = X.long_claims(df, "id", F.col("t")).collect()
    assert len({X.normal_claim(r.claim) for r in got}) == len(got) == X.claim_budget(text) and {r.key for r in got} == {1}
    rows = [("a", "Headcount", "The engineering team is fifteen people now.", "active"), ("b", "Headcount", "The engineering team was nine people then.", "superseded"), ("c", None, None, "active"), ("d", "Boats", "Nothing else matters much here.", "active")]
    docs = spark.createDataFrame(rows, "id string, title string, body string, state string")
    ask = lambda q, past=False: [(r.key, r.part) for r in X.answers(docs, "id", F.col("title"), F.col("body"), F.col("state"), q, past).orderBy("part").collect()]
    assert ask("What is the engineering headcount?") == [("a", "answer"), ("b", "aside")] and ask("What was the engineering headcount?", True) == [("b", "answer"), ("a", "aside")]
    assert ask("Who sings?") == [] and ask("") == []


def test_entities(spark):
    import random

    from lorestack.operators import entities as E

    r = random.Random(3)
    base = ["".join(r.choice("abcd ") for _ in range(r.randint(5, 22))).strip() or "x" for _ in range(60)]
    names = base + ["".join(c for i, c in enumerate(b) if i not in {r.randrange(len(b)) for _ in range(2)}) for b in base] + [b[:3] + b[4:5] + b[3:4] + b[5:] for b in base]
    df = spark.createDataFrame([(f"{i:03d}", "w", "person", n) for i, n in enumerate(names)] + [("z1", "w", None, None), ("z2", None, "person", "abc")], "id string, workspace_id string, entity_type string, title string")
    got = {(x.id_a, x.id_b) for x in E.duplicate_candidates(df).collect()}
    c = df.filter("workspace_id = 'w' and entity_type = 'person'").select("id", T.canonicalise(F.col("title")).alias("c"))
    brute = c.toDF("a", "x").crossJoin(c.toDF("b", "y")).filter("a < b").filter(T.compare_names(F.col("x"), F.col("y")) >= 0.7)
    assert got == {(x.a, x.b) for x in brute.collect()} and len(got) > 60
    texts = spark.createDataFrame([("t", "w", "Ann Lee met Acme Robotics and Ann Lee at Acme."), ("u", "v", "Ann Lee"), ("n", "w", None)], "id string, workspace_id string, text string")
    known = spark.createDataFrame([("e1", "w", "Ann Lee", ["A. L."], "person", "active", day(1)), ("e2", "w", "Acme Robotics", ["Acme"], "organisation", "active", day(1)), ("e3", "w", "ann lee", None, "person", "active", day(0)), ("e4", "w", None, None, None, "active", day(0))], "id string, workspace_id string, title string, aliases array<string>, entity_type string, state string, created_at timestamp_ntz")
    assert {tuple(x) for x in E.mentions(texts, known).collect()} == {("t", "e1", 2), ("t", "e2", 3), ("t", "e3", 2)}
    found = spark.createDataFrame([("t", "w", "Dr. Ann Lee", "name", 0.65), ("t", "w", "ACME", "organisation", 0.65), ("t", "w", "2025", "date", 0.9), ("t", "w", "New Harbour", "place", 0.75), ("t", "w", "Faint", "name", 0.35)], "object_id string, workspace_id string, text string, type string, confidence double")
    got = {(x.entity_id if not x.created else "new", x.name) for x in E.link_mentions(found, known).collect()}
    assert got == {("e3", "Dr. Ann Lee"), ("e2", "ACME"), ("new", "New Harbour")}


def test_concepts(spark):
    from lorestack.operators.mining import concepts

    body = "The old harbour archive plan is `code archive` | x"
    rows = [(f"o{i}", "w", "note", f"t{i}", body, "active", None, "{}") for i in range(3)] + [("e", "w", "entity", "Archive Plan", None, "active", None, '{"aliases":[]}'), ("r", "w", "note", None, None, "active", "rejected", "{}")]
    df = spark.createDataFrame(rows, "id string, workspace_id string, kind string, title string, body string, state string, review string, attrs string")
    assert {(r.phrase, r.documents) for r in concepts(df).collect()} == {("harbour archive plan", 3)}
    plan = concepts(df)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert [x for x in plan if "LeftOuter" in x] and not [x for x in plan if "LeftOuter" in x and "Broadcast" in x]  # parts of phrases aren't sent to the driver


def test_jaccard_join_equals_brute_force(spark):
    import random

    from lorestack.operators.capture import jaccard_join

    r = random.Random(4)
    sets = [(i, r.sample("abcdefghij", r.randint(0, 7))) for i in range(120)]
    df = spark.createDataFrame(sets, "id int, t array<string>")
    want = {(i, j) for i, x in sets for j, y in sets if i < j and x and y and len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}
    assert {(p.a, p.b) for p in jaccard_join(df, "id", "t", 0.5).collect()} == want


def test_jaccard_tiles_equal_brute_force(spark):
    import random

    from lorestack.operators.capture import jaccard_tiles

    r = random.Random(4)
    sets = [(f"k{i:03d}", [f"w{x}" for x in r.sample(range(30), r.randint(0, 14))]) for i in range(200)] + [(None, ["w1"])]
    df = spark.createDataFrame(sets, "id string, t array<string>")
    share = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
    want = {(i, j): share(x, y) for i, x in sets for j, y in sets if i and j and i < j and x and y and share(x, y) >= 0.45}
    for bits in (32, 4):  # codes of four bits stand for several terms
        got = [((p.a, p.b), p.similarity) for p in jaccard_tiles(df, "id", "t", 0.45, least=40, bits=bits).collect()]
        assert dict(got) == want and len(got) == len(want) > 100
    assert jaccard_tiles(df.limit(0), "id", "t", 0.45).count() == 0


def test_near_pairs_alone_leave_their_tiles(spark):
    from lorestack.operators import recall as M

    s = memory(spark)
    pairs = M.near_pairs(s)
    assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()  # candidates aren't shuffled
    known = {tuple(r) for r in M.object_notices(s, pairs).collect()}
    assert known == {tuple(r) for r in M.object_notices(s, pairs.select("id", "other")).collect()} and len(known) > 3
    assert {(r.id, r.other): r.overlap for r in pairs.collect()}["a", "d"] == 0.8


def test_export_and_import(spark, tmp_path):
    from lorestack.sources.exchange import export_workspace, plan_import

    objects = spark.createDataFrame([("o1", "w"), ("o2", "w"), ("o3", "v")], "id string, workspace_id string")
    rel = spark.createDataFrame([("r1", "w", "o1", "o2"), ("r2", "w", "o1", "gone"), ("r3", "w", "o1", None)], "id string, workspace_id string, src_id string, dst_id string")
    sums = export_workspace({"knowledge_object": objects, "relation": rel}, "w", str(tmp_path / "e"))
    plan = plan_import(spark, str(tmp_path / "e"), {"knowledge_object": spark.createDataFrame([("o1",)], "id string")}, sums)
    assert {r.id for r in plan["knowledge_object"].collect()} == {"o2"} and {r.id for r in plan["relation"].collect()} == {"r1", "r3"}
    with pytest.raises(ValueError):
        plan_import(spark, str(tmp_path / "e"), {}, {"knowledge_object": "0"})


def test_providers():
    import time

    from lorestack.functions.providers import Provider, Providers, builtin

    def fail(capability, task):
        raise RuntimeError("down")

    now, up, told = [0.0], [True], []
    p = Providers(clock=lambda: now[0])
    p.listeners.append(lambda name, ok: told.append((name, ok)))
    p.register(Provider("good", {"tag": (0.9, 100, 50)}, fail, local=False, available=lambda: up[0]))
    p.register(Provider("floor", {"tag": (0.3, 1, 0)}, lambda c, t: [t]))
    assert p.ranked("tag") == ["good", "floor"] and p.ranked("tag", prefer="privacy") == ["floor", "good"] and p.ranked("tag", most=10) == ["floor"] == p.ranked("tag", left=20) == p.ranked("tag", remote=False)
    assert p.ranked("tag", first=("floor",)) == ["floor", "good"] and p.ranked("tag", deny=("good",)) == ["floor"]
    assert p.call("tag", "x") == {"provider": "floor", "result": ["x"], "degraded": True} and [r["status"] for r in p.history()] == ["ok", "error: down"]
    up[0] = False
    p.call("tag", "x")
    assert not told and p.history()[1]["status"] == "error: down"  # still known to be up
    now[0] = 31.0
    p.call("tag", "x")
    assert told == [("good", False)] and p.history(status="unavailable")[0]["provider"] == "good"
    p.register(Provider("slow", {"tag": (1.0, 1, 0)}, lambda c, t: time.sleep(1)))
    assert p.call("tag", "x", timeout=0.05)["degraded"] and p.history(status="timeout")
    assert p.coverage(["tag", "link"]) == {"tag": ["floor", "good", "slow"], "link": []}
    with pytest.raises(LookupError):
        p.call("link", "x")
    p.register(builtin())
    assert p.call("numbers", "38ms")["result"] == [("ms", 38.0)]


def memory(spark):
    from lorestack.operators.recall import Store

    rows = [
        ("a", "Harbour plan", "The harbour plan needs 12 boats. " * 3, "active", None, None), ("b", "Harbour plan of old", "The harbour plan needed 9 boats then.", "superseded", "a", None),
        ("c", "Kitchen rota", "Nothing about ships is written in here.", "active", None, "rejected"), ("d", "Harbour plan copy", "The harbour plan needs 12 boats. " * 3, "active", None, None),
        ("e", "Harbour plan denied", "The harbour plan does not need 12 boats.", "active", None, None), ("f", "Gone", "The harbour plan is deleted.", "deleted", None, None), ("g", None, None, "active", None, None),
    ]
    full = [(i, "w", "note", t, b, '{"tags":["x"]}', "fact", "user", None, rv or "unreviewed", st, sup, None, day(n), day(n), 0, None, "h" + i) for n, (i, t, b, st, sup, rv) in enumerate(rows)]
    schema = "id string, workspace_id string, kind string, title string, body string, attrs string, epistemic string, origin string, confidence double, review string, state string, superseded_by string, occurred_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz, access_count int, last_access timestamp_ntz, content_hash string"
    rel = [("r1", "w", "a", "related_to", "c", 0.9, "active"), ("r2", "w", "a", "contradicts", "e", 0.8, "active"), ("r3", "w", "a", "mentions", "f", 0.9, "active")]
    relations = spark.createDataFrame(rel, "id string, workspace_id string, src_id string, type string, dst_id string, confidence double, state string")
    return Store(spark.createDataFrame(full, schema), relations, spark.createDataFrame([("a", "e1", "supports")], "target_id string, id string, stance string"), "2026-03-01 00:00:00")


def test_search_context_and_answers(spark):
    from lorestack.operators import recall as M

    s = memory(spark)
    found = [r.id for r in M.search(s, parse_query("harbour plan", s.now)).orderBy("rank").collect()]
    assert set(found[:3]) == {"a", "d", "e"} and not {"b", "f"} & set(found)
    assert [r.id for r in M.search(s, parse_query("is:superseded harb", s.now)).collect()] == ["b"]  # by prefix
    near = {r.id: r.why for r in M.search(s, parse_query("harbour plan", s.now), anchor="c", rerank=True).collect()}
    assert near["a"].depth == 1 and "1 step(s) away in the graph" in near["a"].because and near["a"].quality > 1
    assert {r.id for r in M.search(s, parse_query("kind:note", s.now)).collect()} == {"a", "c", "d", "e", "g"}
    ctx = M.context(s, "What did the harbour plan originally need?")
    ids = [i["id"] for i in ctx.items]
    assert "f" not in ids and {"a", "b", "c", "e"} <= set(ids) and ctx.conflicts[0]["id"] == "r2" and ctx.used <= ctx.budget
    assert next(i for i in ctx.items if i["id"] == "c")["reason"] == "related to — Harbour plan" and "KNOWN DISAGREEMENTS" in M.render(ctx)
    cache = {}
    first = M.ask(s, "How many boats does the harbour plan need?", cache)
    assert first["grounded"] and "12 boats" in first["answer"] and first["escalate"] == "synthesis" and not first["cached"] and M.ask(s, "How many boats does the harbour plan need??", cache)["cached"]
    assert M.ask(s, "zzz qqq")["answer"] is None
    assert M.pack([{"text": "x" * 4000, "tokens": 1000, "reason": "r"}], 500)[0][0]["reason"] == "r (trimmed)"
    pairs = M.near_pairs(s)
    got = {(r.id, r.kind, r.other) for r in M.object_notices(s, pairs).collect()}
    assert ("a", "seen-before", "d") in got and ("a", "contradiction", "e") in got
    assert [r.kind for r in M.question_notices(s, s.heads.filter("id in ('b', 'c')").select("id")).collect()] == ["superseded-source", "all-old"] and {r.kind for r in M.workspace_notices(s).collect()} == {"open-conflicts", "possibly-outdated"}
    assert {r.other for r in M.similar_to(s, s.heads.filter("id = 'a'")).collect()} >= {"d", "e"}
    empty = M.Store(s.heads.limit(0), s.relations.limit(0), s.evidence.limit(0), s.now)
    assert M.search(empty, parse_query("harbour", s.now)).count() == 0 and M.ask(empty, "harbour?")["answer"] is None
    assert M.escalate("compare them", 3, True, 0.9) == "synthesis" and M.escalate("x", 3, True, 0.2) == "unsure" and M.escalate("x", 0, False, 0) is None and M.escalate("x", 3, True, 0.9, "always") == "always"


def test_lifecycle(spark):
    from lorestack.operators import lifecycle as L

    s = memory(spark)
    heads = s.heads.select("id", F.lit(1).alias("head_version"), "title", "body", "attrs", "epistemic", "confidence", "review", "state", "superseded_by", F.lit(None).cast("timestamp_ntz").alias("valid_until"))
    p = [("p1", "a", 1, "edit", "New", None, None), ("p2", "a", 2, "edit", " New ", None, None), ("p3", "a", 3, "delete", None, None, None), ("p4", "a", 4, "confirm", None, None, None), ("p5", "a", 5, "restore", None, None, None), ("p6", "a", 6, "edit", " ", None, None),
         ("p7", "a", 7, "supersede", None, None, "a"), ("p8", "a", 8, "supersede", None, None, "d"), ("p9", "zz", 1, "confirm", None, None, None), ("q1", "f", 1, "edit", "x", None, None), ("q2", "f", 2, "edit", None, 2.0, None)]
    rows = spark.createDataFrame([(a, b, day(c), d, e, None, None, None, f, g) for a, b, c, d, e, f, g in p], "patch_id string, id string, at timestamp_ntz, change string, title string, body string, attrs string, epistemic string, confidence double, superseded_by string")
    got = {r.patch_id: (r.outcome, r.head_version, r.title, r.state, list(r.changed)) for r in L.apply_changes(heads, rows).collect()}
    assert got["p1"] == ("changed", 2, "New", "active", ["title"]) and got["p2"][:2] == ("unchanged", 2) and got["p3"][:2] == ("changed", 3) and got["p4"][0] == "deleted" and got["p5"][:2] == ("changed", 4)
    assert got["p6"][0] == "invalid" == got["p7"][0] and got["p8"][:2] == ("changed", 5) and got["p8"][4] == ["state", "superseded_by", "valid_until"] and got["p9"][0] == "missing" and got["q1"][0] == "deleted" and got["q2"][0] == "invalid"
    new = spark.createDataFrame([("i1", "w", "note", "Harbour plan", "The harbour plan needs 12 boats. " * 3, '{"tags":["x"]}', None, "user", None, day(1)), ("i2", "w", "note", "N", None, "{}", None, "ai", 0.5, day(1)), ("i3", "w", "note", " N", "", None, None, "ai", None, day(2)), ("i4", "w", "note", None, "", None, None, "ai", None, day(2)), ("i5", "w", "note", "M", "", None, None, "ai", 7.0, day(2))],
                                "input_id string, workspace_id string, kind string, title string, body string, attrs string, epistemic string, origin string, confidence double, at timestamp_ntz")
    assert {(r.input_id, r.outcome, r.id) for r in L.create(new, s.heads).collect()} == {("i1", "existing", "a"), ("i2", "created", "new_i2"), ("i3", "existing", "new_i2"), ("i4", "invalid", None), ("i5", "invalid", None)}
    al = L.add_aliases(spark.createDataFrame([("a", "Ann", ["A"])], "id string, title string, aliases array<string>"), spark.createDataFrame([("a", "Annie"), ("a", "Ann"), ("a", " ")], "id string, alias string")).first()
    assert al.aliases == ["A", "Annie"] and al.changed


def test_change_feed_delivers_ties_over_pages(spark):
    from lorestack.operators.history import change_feed, feed_state

    rows = [(f"i{n}", day(1 if n < 7 else 2)) for n in range(9)]
    streams = {"a": spark.createDataFrame(rows, "id string, ingested_at timestamp_ntz")}
    cursors, seen, complete = {"a": ("2000-01-01 00:00:00", None)}, [], False
    while not complete and len(seen) < 20:
        page = change_feed(streams, cursors, 3)
        seen += [r.id for r in page.collect()]
        cursor, complete = feed_state(streams, cursors, page)["a"]
        cursors = {"a": cursor}
    assert sorted(seen) == [r[0] for r in rows]
