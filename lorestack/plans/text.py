"""Queries over the text kernels, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.plans import duck
from lorestack.plans.base import Registry
from lorestack.sources.tables import current_rows, current_wide, kind_key, table

query = Registry()
QUERIES, SQL = query.QUERIES, query.SQL


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


@query(f"SELECT doc_id, t AS term, count(*) AS tf FROM (SELECT doc_id, unnest({duck.tokens('text')}) AS t FROM documents) GROUP BY 1, 2")
def term_frequency(spark, folder):
    """Terms of each document and how often they occur."""
    return docs(spark, folder).select("doc_id", F.explode(T.tokenize(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


@query(f"SELECT doc_id, len({duck.tokens('text')}) AS terms, len({duck.content('text')}) AS content_terms, {duck.estimate('text')} AS token_estimate FROM documents")
def token_estimate(spark, folder):
    text = F.col("text")
    size = lambda c: F.when(text.isNotNull(), F.size(c)).otherwise(0).cast("long")
    return docs(spark, folder).select("doc_id", size(T.tokenize(text)).alias("terms"), size(T.content_terms(text)).alias("content_terms"), T.estimate_tokens(text).alias("token_estimate"))


@query(f"SELECT t AS term, count(*) AS occurrences, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({duck.content('text')}) AS t FROM documents) GROUP BY 1")
def document_frequency(spark, folder):
    """Occurrences and document frequency of content terms, combined per document before the shuffle by term."""
    per = docs(spark, folder).select("doc_id", F.explode(T.content_terms(F.col("text"))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.count("*").alias("documents"))


@query(f"SELECT DISTINCT t AS term, {duck.stem('t')} AS stem FROM (SELECT unnest({duck.content('text')}) AS t FROM documents)")
def stem_terms(spark, folder):
    terms = docs(spark, folder).select(F.explode(T.content_terms(F.col("text"))).alias("term")).distinct()
    return terms.select("term", T.stem(F.col("term")).alias("stem"))


@query(
    f"SELECT g AS gram, count(*) AS n FROM (SELECT unnest(CASE WHEN length(p) >= 3 THEN [substring(p, i, 3) for i in range(1, length(p) - 1)] ELSE [p] END) AS g FROM (SELECT '#' || t || '#' AS p FROM (SELECT unnest({duck.content('title')}) AS t FROM knowledge_object))) GROUP BY 1"
)
def title_ngrams(spark, folder):
    """Character 3-grams of the content terms of titles."""
    terms = table(spark, folder, "knowledge_object").select(F.explode(T.content_terms(F.col("title"))).alias("t"))
    return terms.select(F.explode(T.char_ngrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, len({duck.sentences('text')}) AS sentences FROM documents")
def sentence_counts(spark, folder):
    return docs(spark, folder).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("sentences"))


@query(
    f"""WITH {duck.HEAD}, p AS (SELECT a.id, {duck.content("concat_ws(' ', a.title, a.body)")} AS x, {duck.content("concat_ws(' ', b.title, b.body)")} AS y FROM head a JOIN head b ON b.id = a.superseded_by)
SELECT id, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE round(len(list_intersect(list_distinct(x), list_distinct(y))) / (len(list_distinct(x)) + len(list_distinct(y)) - len(list_intersect(list_distinct(x), list_distinct(y)))), 6) END AS similarity FROM p"""
)
def superseded_similarity(spark, folder):
    """Lexical similarity of each superseded object and its replacement."""
    rows = current_rows(table(spark, folder, "knowledge_object"), "title", "body", "superseded_by").select("id", "superseded_by", F.concat_ws(" ", "title", "body").alias("t"))
    new = rows.select(F.col("id").alias("superseded_by"), F.col("t").alias("u"))
    return rows.filter("superseded_by is not null").join(new, "superseded_by").select("id", F.round(T.lexical_similarity(F.col("t"), F.col("u")), 6).alias("similarity"))


@query(
    f"""WITH {duck.HEAD}, n AS (SELECT id, workspace_id, json_extract_string(attrs, '$.entityType') AS t, {duck.canonical('title')} AS c FROM head WHERE lower(trim(kind)) = 'entity' AND state = 'active'),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.c AS a, b.c AS b, levenshtein(a.c, b.c) AS e FROM n a JOIN n b ON a.workspace_id = b.workspace_id AND a.id < b.id AND a.t IS NOT DISTINCT FROM b.t),
s AS (SELECT id_a, id_b, CASE WHEN a = '' OR b = '' THEN 0.0 WHEN a = b THEN 1.0 WHEN starts_with(a, b || ' ') OR starts_with(b, a || ' ') THEN 0.8
 WHEN a LIKE '% %' AND b LIKE '% %' AND string_split(a, ' ')[-1] = string_split(b, ' ')[-1] AND a[1] = b[1] THEN CASE WHEN length(string_split(a, ' ')[1]) = 1 OR length(string_split(b, ' ')[1]) = 1 THEN 0.85 ELSE 0.72 END
 WHEN e <= 2 AND 1 - e / greatest(length(a), length(b)) >= 0.85 THEN (1 - e / greatest(length(a), length(b))) * 0.9 ELSE 0.0 END AS score FROM p)
SELECT id_a, id_b, round(score, 6) AS score FROM s WHERE score >= 0.7"""
)
def name_duplicates(spark, folder):
    """Pairs of active entities of a workspace and type with alike names; the SQL compares all pairs."""
    from lorestack.operators.entities import duplicate_candidates

    rows = current_rows(table(spark, folder, "knowledge_object"), "workspace_id", "kind", "title", "attrs", "state").filter((kind_key() == "entity") & (F.col("state") == "active"))
    found = duplicate_candidates(rows.withColumn("entity_type", F.get_json_object("attrs", "$.entityType")))
    return found.select("id_a", "id_b", F.round("score", 6).alias("score"))


@query(f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) SELECT doc_id, count(*) AS lines, count(*) FILTER (WHERE {duck.structured('line')}) AS structured FROM l GROUP BY 1")
def structured_lines(spark, folder):
    lines = docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(T.looks_structured(F.col("line")).cast("int")).alias("structured"))


@query(
    f"""WITH d AS (SELECT doc_id, text, list_min([p for p in [strpos({duck.fold('text')}, 'archive'), strpos({duck.fold('text')}, 'harbour')] if p > 0]) AS m FROM documents), s AS (SELECT *, greatest(1, m - 80) AS b FROM d)
SELECT doc_id, coalesce(CASE WHEN m IS NULL THEN substring(text, 1, 240) || (CASE WHEN length(text) > 240 THEN '…' ELSE '' END) ELSE (CASE WHEN b > 1 THEN '…' ELSE '' END) || regexp_replace(substring(text, b, 240), '^[\\s\\x{{00A0}}\\x{{3000}}]+|[\\s\\x{{00A0}}\\x{{3000}}]+$', '', 'g') || (CASE WHEN b + 239 < length(text) THEN '…' ELSE '' END) END, '') AS excerpt FROM s"""
)
def excerpts(spark, folder):
    """A window of every document around the first match of a question's terms."""
    return docs(spark, folder).select("doc_id", T.excerpt(F.col("text"), ["archive", "harbour"]).alias("excerpt"))


@query(
    f"""WITH t AS (SELECT doc_id, unnest({duck.content('text')}) AS term, generate_subscripts({duck.content('text')}, 1) AS pos FROM documents),
total AS (SELECT count(*) AS n FROM documents), df AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY 1), tf AS (SELECT doc_id, term, count(*) AS tf, min(pos) - 1 AS p FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT doc_id, term, floor(1e4 * (tf / len.n) * (ln((total.n + 1) / (df + 1)) + 1) * least(1.15, 1 + 0.02 * (length(term) - 4)) * (1.3 - 0.4 * least((p / len.n) / 0.4, 1)) + 0.5) / 1e4 AS score FROM tf JOIN df USING (term) JOIN len USING (doc_id), total)
SELECT doc_id, term, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= 10"""
)
def tfidf_keywords(spark, folder):
    """Ten keywords of each document: frequency, rarity, length and first position."""
    from lorestack.operators import extract as X

    d = docs(spark, folder)
    return X.keywords(d, "doc_id", F.col("text"), X.unit_frequency(d, "text"), d.count()).withColumnRenamed("key", "doc_id")


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
# Fixed values: (type, pattern, confidence); B stands for the edge of a word of ASCII.
PATTERNS = (
    ("email", r"B[\w.+-]+@[\w-]+\.[\w.-]+B", 0.98), ("url", r"Bhttps?://[^\s<>\"')]+", 0.98), ("date", r"B\d{4}-\d{2}-\d{2}B", 0.95),
    ("date", rf"(?i)B(?:\d{{1,2}}\s+)?(?:{_MONTHS})\s+\d{{1,2}}?,?\s*\d{{4}}B", 0.9), ("money", r"(?i)(?:[$£€₹]\s?\d[\d,]*(?:\.\d+)?|B\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|INR|dollars|euros|rupees)B)", 0.92),
    ("percent", r"B\d+(?:\.\d+)?\s?%", 0.95), ("version", r"Bv?\d+\.\d+(?:\.\d+)?B", 0.7), ("identifier", r"B[A-Z]{2,}-\d+B", 0.85), ("time", r"(?i)B\d{1,2}:\d{2}(?::\d{2})?\s?(?:am|pm)?B", 0.85),
)


@query(
    r"""WITH m AS (SELECT doc_id, unnest(['email', 'url', 'date', 'date', 'money', 'percent', 'version', 'identifier', 'time']) AS type, unnest([0.98e0, 0.98e0, 0.95e0, 0.9e0, 0.92e0, 0.95e0, 0.7e0, 0.85e0, 0.85e0]) AS confidence, unnest([
 regexp_extract_all(text, '\b[\w.+-]+@[\w-]+\.[\w.-]+\b'), regexp_extract_all(text, '\bhttps?://[^\s<>"'')]+'), regexp_extract_all(text, '\b\d{4}-\d{2}-\d{2}\b'),
 regexp_extract_all(text, '(?i)\b(?:\d{1,2}\s+)?(?:January|February|March|April|May|June|July|August|September|October|November|December)\s+\d{1,2}?,?\s*\d{4}\b'),
 regexp_extract_all(text, '(?i)(?:[$£€₹]\s?\d[\d,]*(?:\.\d+)?|\b\d[\d,]*(?:\.\d+)?\s?(?:USD|EUR|GBP|INR|dollars|euros|rupees)\b)'), regexp_extract_all(text, '\b\d+(?:\.\d+)?\s?%'),
 regexp_extract_all(text, '\bv?\d+\.\d+(?:\.\d+)?\b'), regexp_extract_all(text, '\b[A-Z]{2,}-\d+\b'), regexp_extract_all(text, '(?i)\b\d{1,2}:\d{2}(?::\d{2})?\s?(?:am|pm)?\b')]) AS found FROM documents),
v AS (SELECT doc_id, type, confidence, unnest(found) AS value FROM m)
SELECT doc_id, value, arg_max(type, (confidence, type)) AS type, max(confidence) AS confidence, count(*) AS n FROM v GROUP BY 1, 2"""
)
def pattern_entities(spark, folder):
    """Structured entities of each document (addresses, links, dates, amounts, percentages, versions, identifiers, times), each
    value as its most certain type."""
    edge = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    found = F.array(*[F.struct(F.lit(k).alias("type"), F.lit(c).alias("confidence"), F.regexp_extract_all("text", F.lit(re.sub(r"(?<![\[A-Z|])B(?![P])", lambda _: edge, p)), F.lit(0)).alias("v")) for k, p, c in PATTERNS])
    rows = docs(spark, folder).select("doc_id", F.explode(found).alias("m")).select("doc_id", "m.type", "m.confidence", F.explode("m.v").alias("value"))
    best = F.max(F.struct("confidence", "type")).alias("b")
    return rows.groupBy("doc_id", "value").agg(best, F.count("*").alias("n")).select("doc_id", "value", "b.type", "b.confidence", "n")


@query(
    r"""WITH h AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, length(regexp_extract(line, '^(#{1,6})\s+(\S.*)$', 1)) AS level, trim(regexp_extract(line, '^(#{1,6})\s+(\S.*)$', 2), ' ' || chr(13) || chr(9)) AS heading, count(*) AS n FROM h WHERE regexp_matches(line, '^#{1,6}\s+\S') GROUP BY 1, 2, 3"""
)
def markdown_headings(spark, folder):
    lines = docs(spark, folder).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(r"^#{1,6}\s+\S"))
    p = r"^(#{1,6})\s+(\S.*)$"
    heading = F.regexp_replace(F.regexp_extract("line", p, 2), r"^[ \r\t]+|[ \r\t]+$", "")
    return lines.groupBy("doc_id", F.length(F.regexp_extract("line", p, 1)).cast("long").alias("level"), heading.alias("heading")).agg(F.count("*").alias("n"))


@query(
    r"""SELECT doc_id, list_sort([m for m in regexp_extract_all(text, '\[([^\]\n]*)\]\((https?://[^)\s]+)\)', 2)]) AS links FROM documents WHERE regexp_matches(text, '\[([^\]\n]*)\]\((https?://[^)\s]+)\)')"""
)
def markdown_links(spark, folder):
    p = r"\[([^\]\n]*)\]\((https?://[^)\s]+)\)"
    return docs(spark, folder).filter(F.col("text").rlike(p)).select("doc_id", F.array_sort(F.regexp_extract_all("text", F.lit(p), F.lit(2))).alias("links"))


@query(
    r"""WITH l AS (SELECT id, unnest(regexp_extract_all(text, '<a\s+href="([^"]*)"[^>]*>', 1)) AS href FROM (SELECT doc_id AS id, text FROM documents)) SELECT id AS doc_id, href, count(*) AS n FROM l GROUP BY 1, 2"""
)
def html_links(spark, folder):
    """Links of pages as a reader of tags finds them."""
    from lorestack.sources.readers import parse_html

    pages = docs(spark, folder).filter(F.lower("text").contains("<a"))
    return parse_html(pages, "doc_id", "text").select("doc_id", F.explode("links").alias("l")).groupBy("doc_id", F.col("l.href").alias("href")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {duck.HEAD}, c AS (SELECT id, {duck.content("concat_ws(' ', title, body)")} AS t FROM head), q AS (SELECT {duck.content("'harbour archive forecast measurement'")} AS q),
s AS (SELECT id, (SELECT count(*) FROM unnest(q) u(x) WHERE list_contains(t, x)) AS hits, len(q) AS n FROM c, q) SELECT id, hits / n AS coverage FROM s WHERE hits > 0"""
)
def term_coverage(spark, folder):
    """Share of a question's terms that an object has."""
    rows = current_wide(table(spark, folder, "knowledge_object"), "title", "body")
    terms = ["harbour", "archive", "forecast", "measurement"]
    hits = F.size(F.array_intersect(F.array_distinct(T.content_terms(F.concat_ws(" ", "title", "body"))), F.array(*map(F.lit, terms))))
    return rows.select("id", hits.alias("h")).filter("h > 0").select("id", (F.col("h") / len(terms)).alias("coverage"))
