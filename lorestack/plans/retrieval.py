"""Queries of search and ranking, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import graph as G
from lorestack.operators import retrieval as R
from lorestack.operators import vectors as V
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.plans.duck import HEAD
from lorestack.plans.store import NOW
from lorestack.session import cut
from lorestack.sources.tables import current_rows, kind_key, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL

ASKED = ["harbour archive forecast", "who measured the turbine compass", "budget shelf dropped", "Wenildcrest schema policy", "festival ferry rehearsal litres", "copie registre", "Archiv Beleg", "onboarding checklist kitchen"]
_Q = "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{t}')" for i, t in enumerate(ASKED)) + ") v(query_id, query))"
_FIRST = "split_part(text, chr(10), 1)"
_BM25 = f"""d AS (SELECT doc_id, {duck.words(_FIRST)} AS a, {duck.words('text')} AS b FROM documents), size AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS avg_len FROM d),
p AS (SELECT doc_id, l, term, sum(w) AS w FROM (SELECT doc_id, len(a) + len(b) AS l, unnest(a) AS term, 3 AS w FROM d UNION ALL SELECT doc_id, len(a) + len(b), unnest(b), 1 FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
qt AS (SELECT query_id, unnest(list_distinct({duck.words('query')})) AS term FROM q),
bm AS (SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * l / avg_len))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term), size GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm)"""


def asked(spark):
    return spark.createDataFrame(list(enumerate(ASKED)), "query_id int, query string")


def best(spark, folder, k):
    docs = table(spark, folder, "documents")
    return R.bm25(docs, "doc_id", F.substring_index("text", "\n", 1), F.col("text"), asked(spark), k)


@query(f"WITH {_Q}, {_BM25} SELECT query_id, doc_id, score, rank FROM top WHERE rank <= 10")
def bm25_topk(spark, folder):
    """The ten best documents of each query of a batch, in one plan."""
    return best(spark, folder, 10).withColumnRenamed("key", "doc_id")


@query(f"WITH {_Q}, {_BM25} SELECT query_id, doc_id, score FROM top WHERE rank <= 50 AND doc_id NOT IN (SELECT doc_id FROM p WHERE term = 'canal')")
def bm25_excluding(spark, folder):
    """Hits without those that have an excluded word."""
    has = table(spark, folder, "documents").filter(F.array_contains(T.words(F.col("text")), "canal")).select(F.col("doc_id").alias("key"))
    return best(spark, folder, 50).join(has, "key", "left_anti").select("query_id", F.col("key").alias("doc_id"), "score")


@query(rf"SELECT doc_id, len(regexp_extract_all(array_to_string({duck.words('text')}, ' '), 'the harbour office')) AS n FROM documents WHERE regexp_matches(array_to_string({duck.words('text')}, ' '), 'the harbour office')")
def phrase_match(spark, folder):
    line = F.array_join(T.words(F.col("text")), " ")
    rows = table(spark, folder, "documents").select("doc_id", F.regexp_count(line, F.lit("the harbour office")).cast("long").alias("n"))
    return rows.filter("n > 0")


@query(
    f"""WITH {_Q}, {_BM25}, recent AS (SELECT doc_id, row_number() OVER (ORDER BY captured_at DESC, doc_id) AS rank FROM documents ORDER BY rank LIMIT 100), u AS (SELECT doc_id, 1.0 / (60 + rank) AS s FROM top WHERE query_id = 0 AND rank <= 100 UNION ALL SELECT doc_id, 0.6 / (60 + rank) FROM recent)
SELECT doc_id, round(sum(s), 6) AS score FROM u GROUP BY 1"""
)
def rank_fusion(spark, folder):
    """Reciprocal rank fusion of a lexical list and the newest documents."""
    lexical = best(spark, folder, 100).filter("query_id = 0").select("key", "rank")
    recent = table(spark, folder, "documents").select(F.col("doc_id").alias("key"), "captured_at").orderBy(F.desc("captured_at"), "key").limit(100)
    recent = recent.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("captured_at"), "key"))).select("key", "rank")
    return R.fuse({"lexical": (lexical, 1.0), "structured": (recent, 0.6)}).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


_DEG = "edge AS (SELECT * FROM (SELECT DISTINCT ON (id) * FROM relation ORDER BY id, ingested_at) WHERE state = 'active' AND src_id IS NOT NULL AND dst_id IS NOT NULL), deg AS (SELECT id, count(*) AS degree FROM (SELECT src_id AS id FROM edge UNION ALL SELECT dst_id FROM edge) GROUP BY 1), ev AS (SELECT target_id AS id, count(DISTINCT id) AS evidence FROM evidence GROUP BY 1)"


@query(
    f"""WITH {HEAD}, {_DEG}, x AS (SELECT h.*, coalesce(degree, 0) AS degree, coalesce(evidence, 0) AS evidence FROM head h LEFT JOIN deg ON deg.id = h.id LEFT JOIN ev ON ev.id = h.id)
SELECT id, floor(1e6 * ((CASE review WHEN 'confirmed' THEN 1.25e0 WHEN 'rejected' THEN 0.4e0 ELSE 1.0e0 END) * (CASE epistemic WHEN 'fact' THEN 1.15e0 WHEN 'observation' THEN 1.05e0 WHEN 'conclusion' THEN 1.05e0 WHEN 'inference' THEN 0.95e0 WHEN 'hypothesis' THEN 0.9e0 WHEN 'speculation' THEN 0.75e0 ELSE 1.0e0 END)
 * (CASE WHEN origin = 'user' THEN 1.1e0 WHEN origin = 'ai' AND review = 'unreviewed' THEN 0.85e0 ELSE 1.0e0 END) * coalesce(0.7e0 + 0.3e0 * confidence, 1.0e0) * (1 + least(0.2e0, 0.05e0 * evidence)) * (CASE state WHEN 'superseded' THEN 0.5e0 WHEN 'archived' THEN 0.7e0 ELSE 1.0e0 END)) + 0.5e0) / 1e6 AS quality,
 floor(1e6 * (0.85e0 + 0.15e0 * pow(0.5e0, greatest(0, date_diff('day', CAST(updated_at AS DATE), DATE '2026-01-01')) / 180.0e0)) + 0.5e0) / 1e6 AS recency,
 floor(1e6 * (0.32e0 * least(1.0e0, ln(1 + coalesce(access_count, 0)) / ln(41.0e0)) + coalesce(0.18e0 * pow(0.5e0, greatest(0, date_diff('day', CAST(last_access AS DATE), DATE '2026-01-01')) / 60.0e0), 0) + 0.25e0 * least(1.0e0, degree / 8) + 0.15e0 * least(1.0e0, evidence / 4) + (CASE WHEN review = 'confirmed' THEN 0.1e0 ELSE 0 END)) + 0.5e0) / 1e6 AS salience FROM x"""
)
def object_scores(spark, folder):
    """Quality, recency and salience of every object."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "review", "epistemic", "origin", "confidence", "state", "updated_at", "access_count", "last_access")
    e = table(spark, folder, "evidence").groupBy("target_id", "id").agg(F.min("ingested_at")).groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("evidence"))
    x = rows.join(G.degrees(G.active(G.edges(table(spark, folder, "relation")))), "id", "left").join(e, "id", "left")
    return x.select("id", T.round_half(R.quality()).alias("quality"), T.round_half(R.recency(F.col("updated_at"), NOW)).alias("recency"), T.round_half(R.salience(NOW)).alias("salience"))


@query(
    f"""WITH c AS (SELECT doc_id, {duck.tokens('text')} AS t FROM documents), p AS (SELECT doc_id, [x for x in [list_position(t, 'harbour'), list_position(t, 'archive'), list_position(t, 'forecast')] if x > 0] AS pos FROM c)
SELECT doc_id, floor(1e4 * (len(pos) / 3 * 0.75 + 0.25 * (CASE WHEN len(pos) < 2 THEN 0.5 ELSE 1 / (1 + (list_max(pos) - list_min(pos)) / len(pos) / 10) END)) + 0.5) / 1e4 AS score FROM p"""
)
def rerank_proximity(spark, folder):
    score = R.proximity(F.col("t"), ["harbour", "archive", "forecast"])
    return table(spark, folder, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t")).select("doc_id", T.round_half(score, 4).alias("score"))


_COS = "x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id AS key, r.label, round(list_cosine_similarity(q.e, r.e), 6) AS similarity FROM x q JOIN x r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0)"


def vector_queries(spark, folder):
    rows = table(spark, folder, "embeddings")
    return rows.filter("vec_id % 100 = 0"), rows


@query(f"WITH {_COS} SELECT query_id, key, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, key) AS rank FROM s WHERE similarity >= 0.05) WHERE rank <= 10")
def cosine_topk(spark, folder):
    """The ten nearest vectors of every row whose id is divisible by 100, against all rows."""
    return V.exact_search(*vector_queries(spark, folder), "vec_id", "embedding")


@query(f"WITH {_COS}, m AS (SELECT query_id, label, max(similarity) AS similarity FROM s GROUP BY 1, 2) SELECT query_id, label, similarity FROM (SELECT *, max(similarity) OVER (PARTITION BY query_id) AS top FROM m) WHERE similarity >= 0.4 * top AND similarity >= 0.05")
def best_per_label(spark, folder):
    """The best row of each label for each query, without those far below the best of all."""
    top = V.best_per_group(*vector_queries(spark, folder), "vec_id", "embedding", "label").filter("similarity >= 0.05")
    most = F.max("similarity").over(Window.partitionBy("query_id"))
    return top.withColumn("most", most).filter(F.col("similarity") >= 0.4 * F.col("most")).select("query_id", "label", "similarity")


@query()
def ivf_recall(spark, folder):
    """Recall of the inverted lists for each query of cosine_topk; it fails where the mean is under 0.9."""
    queries, rows = vector_queries(spark, folder)
    index = V.InvertedLists(rows, "vec_id", "embedding")
    each = cut(V.recall(index.search(queries), V.exact_search(queries, rows, "vec_id", "embedding")))
    mean = each.agg(F.avg("recall")).first()[0]
    if mean is not None and each.count() >= 20 and mean < V.RECALL:
        raise RuntimeError(f"the inverted lists find {mean:.3f} of the true neighbours")
    return each


@query(
    f"""WITH {HEAD}, t AS (SELECT id, unnest({duck.content("concat_ws(chr(10), title, body)")}) AS t FROM head WHERE state <> 'deleted'), w AS (SELECT id, t, 1 + ln(count(*)) AS w FROM t GROUP BY 1, 2),
f AS (SELECT id, 'w:' || t AS f, w FROM w UNION ALL SELECT id, 'g:' || unnest([substring('#' || t || '#', i, 3) for i in range(1, length(t) + 1)]), 0.28 * w FROM w), u AS (SELECT f, sha256(f) AS h FROM (SELECT DISTINCT f FROM f)),
b AS (SELECT id, CAST('0x' || left(h, 8) AS BIGINT) % 256 AS bucket, sum(w * CASE WHEN h[9] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN 1 ELSE -1 END) AS v FROM f JOIN u USING (f) GROUP BY 1, 2)
SELECT id, CAST(bucket AS BIGINT) AS bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY id)), 5) AS value FROM b WHERE abs(v) > 1e-9"""
)
def hashed_embedding(spark, folder):
    """Vectors of all objects that aren't deleted: hashed terms of title and body and their 3-grams; filled buckets as rows."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "title", "body", "state").filter("state <> 'deleted'")
    v = V.hashed_vectors(rows, "id", F.concat_ws("\n", "title", "body"))
    return v.select(F.col("key").alias("id"), F.posexplode("vector").alias("bucket", "x")).filter(F.abs("x") > 1e-9).select("id", F.col("bucket").cast("long").alias("bucket"), F.round("x", 5).alias("value"))


@query(
    f"""WITH {_Q}, {_BM25}, c AS (SELECT doc_id, rank, {duck.estimate('text')} AS n FROM top JOIN documents USING (doc_id) WHERE query_id = 0 AND rank <= 100), s AS (SELECT *, sum(n) OVER (ORDER BY rank) AS used FROM c) SELECT doc_id, rank, n, CAST(used AS BIGINT) AS used FROM s WHERE used <= 6000"""
)
def context_budget(spark, folder):
    """The best documents of a question that fit a budget of tokens together."""
    hits = best(spark, folder, 100).filter("query_id = 0").select(F.col("key").alias("doc_id"), "rank")
    c = table(spark, folder, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("n")).join(F.broadcast(hits), "doc_id")  # at most 100 rows
    return c.withColumn("used", F.sum("n").over(Window.orderBy("rank"))).filter("used <= 6000").select("doc_id", "rank", "n", "used")


@query(f"WITH {_Q}, {_BM25} SELECT query_id, sha256(array_to_string(list_sort(list_distinct({duck.words('query')})), ' ') || chr(31) || (SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) FROM top t WHERE t.query_id = q.query_id AND rank <= 10)) AS cache_key FROM q")
def answer_cache_keys(spark, folder):
    """Keys under which an answer may be used again: the question's terms and what it was answered from."""
    ids = best(spark, folder, 10).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("key")), lambda k: k.cast("string")), ",").alias("ids"))
    terms = F.array_join(F.array_sort(F.array_distinct(T.words(F.col("query")))), " ")
    return asked(spark).join(ids, "query_id", "left").select("query_id", F.sha2(F.concat(terms, F.lit("\x1f"), "ids"), 256).alias("cache_key"))
