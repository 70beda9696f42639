"""Keyword-stuffed and link-list pages.

Method: bagged decision trees on content and link features are trained on weak labels; the prediction of a page is then
smoothed by the spam rate of its host. The labels come from the share of filler, which the trees see too: with the label's
own columns hidden from them, ten times as many pages under that share were taken for filler (README). A document's host is its source, the only place of origin the table has.

Scale: one pass makes some twenty numbers of each text, and only these go on. The trees are fitted on the driver on at
most TRAIN_ROWS labelled rows and broadcast (a few KB). Host rates are sums by source, combined before the shuffle; as
there may be as many hosts as a crawl has, they are joined by key and broadcast only below a checked size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.llm.trees import Bagged
from lorestack.session import cut, lookup_join
from lorestack.sources.tables import table

#: The classifier is fitted on at most this many labelled rows (half of each label), chosen by a hash of their key.
TRAIN_ROWS = 20_000
#: How far a host's rate moves a page's log odds, and the pages that a host's rate is shrunk by.
HOST_WEIGHT, HOST_PRIOR = 0.25, 200.0

# Words too common to be keywords, and words of offers.
COMMON = set(
    "the and for that this with was are not but had has have its from into than then been which when who our your you every here more most of to in on at is it as by be or an if so no "
    "der die das und ist nicht mit von für den dem ein eine auf aus bei que los las del por una con para les des est une dans pour sur pas el la le y et à du un au há और में का की के से है".split()
)
OFFER = set(
    "buy cheap best sale discount free online premium wholesale official reviews review download deals deal shop store price prices offer offers coupon delivery shipping order cart stock "
    "new top tags sku günstig kaufen angebot rabatt comprar barato oferta precio acheter prix promo gratuit".split()
)
LINK = re.compile(r"<a\s[^>]*>.*?</a>|\[[^\]]*\]\([^)]*\)|(?:https?://|www\.)\S+", re.S | re.I)
WORD = re.compile(r"[^\W_]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
HASHTAG = re.compile(r"(?<!\w)#\w+[,;]?")
PRICE = re.compile(r"\b\d+[.,]\d\d\b")
GOODS = re.compile(r"\btags?:|\b(?:sku|item|art\.?)\s*#?\d+|add to cart|in stock|\bsale\b|-\d+ ?%", re.I)
TAGS = re.compile(r"tags?:\s", re.I)
#: Lines of working records: stamped, spoken, tabled, ticked, numbered, assigned or listed changes.
RECORD = re.compile(r"\s*(?:\[?\d{1,4}[-:./]\d\d|\|.*\||\[[ xX]?\]|[☐☑✓✗]|\w[\w .-]{0,20}:\s|[-*•]\s*\w+:\s|[\w.\[\]-]+\s*=\s*\S|version\s+\d|\d+\.\s|[{}<>/#]{1,3}\s|(?:def|class|import|return|if|for|while)\b.*[:;{(]\s*$)", re.I)
START_LINK = re.compile(r"https?:|www\.|<a\s|\[[^\]]*\]\(", re.I)
#: Places between sentences; scripts with stops of their own need no blank.
SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？।])\s*(?=\S)")
NUMBERED = re.compile(r"\d+\.\s")

FEATURES = (
    "links", "goods", "hashtags", "keywords", "filler", "record", "sentences", "top_word", "top_pair", "offers", "distinct",
    "links_per_word", "words", "lines", "short_lines", "same_start", "digits", "upper", "commas", "repeated_lines",
)


def page_features(text: str) -> list[float]:
    """Numbers of a text; shares are of its characters that are no white space, or of its words."""
    low = text.lower()
    linked_text = "http" in low or "www." in low or "<a" in low or "](" in low
    words = WORD.findall((LINK.sub(" ", text) if linked_text else text).lower())
    n = max(1, len(words))
    counts = Counter(words)
    pairs = Counter(zip(words, words[1:]))
    floor = max(4, 0.04 * n)
    hot = {w for w, c in counts.items() if c >= floor and len(w) > 1 and w not in COMMON and not w.isdigit()}
    if hot:
        for (a, b), c in pairs.items():
            if c >= floor and (a in hot or b in hot):
                hot.update(w for w in (a, b) if w not in COMMON)
    offers = sum(counts[w] for w in OFFER if w in counts)
    # what the text as a whole has none of needn't be looked for in its parts
    sold_text, tagged_text = offers >= 2 or bool(hot), "#" in text
    goods_text = bool(GOODS.search(text))
    total = links = goods = hashtags = keywords = record = sentences = short = 0
    starts: Counter = Counter()
    lines = [x for x in (line.strip() for line in text.splitlines()) if x]
    for line in lines:
        starts[line[:6].lower()] += 1
        short += len(line) < 60
        for part in SENTENCE_END.split(line):
            size = len(part) - part.count(" ")
            if not size:
                continue
            total += size
            linked = sum(len(m.group()) - m.group().count(" ") for m in LINK.finditer(part)) if linked_text else 0
            if linked >= 0.5 * size and linked and (START_LINK.match(part) or NUMBERED.match(part) or not RECORD.match(part)):
                links += size
                continue
            if goods_text and (TAGS.match(part) or PRICE.search(part) and GOODS.search(part) or len(GOODS.findall(part)) >= 2):
                goods += size
                continue
            if tagged_text and sum(len(m.group()) for m in HASHTAG.finditer(part)) >= 0.5 * size:
                hashtags += size
                continue
            known = sold = again = 0
            inside: list[str] = []
            if sold_text:
                inside = WORD.findall((LINK.sub(" ", part) if linked else part).lower())
                sold = sum(w in OFFER for w in inside)
                known = sum(w in hot or w in OFFER for w in inside)
            if sold >= 2 and known >= 0.5 * len(inside):
                keywords += size
                continue
            if RECORD.match(part):
                record += size
                continue
            ended = part[-1] in "。！？।" or part[-1] in ".!?" and part.count(" ") >= 3
            if inside and known >= 0.3 * len(inside) and any(w in hot for w in inside):
                # a sentence counts as stuffed only if it says its keywords again and again, or offers something
                again = sum(c - 1 for w, c in Counter(inside).items() if w in hot)
                if not ended or sold > 0 or again >= 0.2 * len(inside):
                    keywords += size
                    continue
            if ended:
                sentences += size
    total = max(1, total)
    letters = max(1, len(text))
    top = max((c for w, c in counts.items() if w not in COMMON and len(w) > 2), default=0)
    return [
        links / total, goods / total, hashtags / total, keywords / total, (links + goods + hashtags + keywords) / total, record / total, sentences / total,
        top / n, max(pairs.values(), default=0) / n, offers / n, len(counts) / n,
        (len(LINK.findall(text)) if linked_text else 0) / n, float(n), float(len(lines)), short / max(1, len(lines)), max(starts.values(), default=0) / max(1, len(lines)),
        sum(map(str.isdigit, words)) / n, len(UPPER.findall(text)) / letters, text.count(",") / n, 1 - len(set(lines)) / max(1, len(lines)),
    ]


def weak_label(x: np.ndarray) -> np.ndarray:
    """1: surely filler, 0: surely not, -1: left to the trees. Of rows of FEATURES."""
    f = {name: x[:, i] for i, name in enumerate(FEATURES)}
    out = np.full(len(x), -1)
    out[f["filler"] < 0.48] = 0
    out[(f["record"] > 0.6) | (f["sentences"] > 0.7)] = 0
    out[(f["filler"] > 0.52) & (f["record"] < 0.4)] = 1
    return out


def feature_table(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, x, label) of texts that aren't blank."""
    kinds = {c: docs.schema[c].dataType.simpleString() for c in (key, host)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([page_features(t) for t in batch.column(2).to_pylist()], dtype=np.float32).reshape(-1, len(FEATURES))
            rows = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), len(FEATURES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(weak_label(x).astype(np.int32))], ["key", "host", "x", "label"])

    readable = docs.filter(F.length(F.trim(text)) > 0).select(F.col(key).alias("key"), F.col(host).alias("host"), text)
    return readable.mapInArrow(measure, f"key {kinds[key]}, host {kinds[host]}, x array<float>, label int")


def score_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(key, host, content_score, host_rate, score, filler) of every text that isn't blank.

    score is the chance that more than half of the text is filler: repeated keywords, lists of links or product tags.
    Null, empty and blank texts have no row. Pages of a null host are smoothed by the rate of all pages. Repeated texts
    each have their row. With no labelled page of one kind, the share of filler decides. Only the three columns are read.
    """
    pages = cut(feature_table(docs, key, text, host))
    order = F.xxhash64("key")
    sample = [r for label in (0, 1) for r in pages.filter(F.col("label") == label).orderBy(order, "key").select("x", "label").limit(train_rows // 2).collect()]
    model = None
    if len({r.label for r in sample}) == 2:
        x, y = np.array([r.x for r in sample], dtype=float), np.array([r.label for r in sample], dtype=float)
        model = Bagged.fit(x, y)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def predict(rows):
        import pandas as pd

        x = np.array(rows.tolist(), dtype=float).reshape(-1, len(FEATURES))
        forest = shared.value
        return pd.Series(forest.predict(x) if forest else (x[:, FEATURES.index("filler")] > 0.5).astype(float))

    filler = F.col("x")[FEATURES.index("filler")].cast("double")
    scored = pages.select("key", "host", predict("x").alias("content_score"), filler.alias("filler"))
    scored = cut(scored)
    rates = scored.groupBy("host").agg(F.sum("content_score").alias("_s"), F.count("*").alias("_n"))
    whole = rates.agg(F.sum("_s"), F.sum("_n")).first()
    base = (whole[0] or 0.0) / max(1, whole[1] or 0)
    rates = rates.filter("host is not null").select("host", ((F.col("_s") + base * HOST_PRIOR) / (F.col("_n") + HOST_PRIOR)).alias("host_rate"))
    joined = lookup_join(scored, rates, ["host"], "left", spread=F.col("key")).withColumn("host_rate", F.coalesce("host_rate", F.lit(base)))
    clip = lambda c: F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), c))
    logit = lambda c: F.log(c / (1 - c))
    odds = logit(clip(F.col("content_score"))) + HOST_WEIGHT * (logit(clip(F.col("host_rate"))) - logit(clip(F.lit(base))))
    return joined.select("key", "host", "content_score", "host_rate", (1 / (1 + F.exp(-odds))).alias("score"), "filler")


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return score_pages(table(spark, folder, "documents")).filter("score > 0.5").select(F.col("key").alias("doc_id"))


def p9_hosts(spark: SparkSession, folder: str) -> DataFrame:
    """Pages, filler pages and their share for each source."""
    found = F.sum((F.col("score") > 0.5).cast("int"))
    return score_pages(table(spark, folder, "documents")).groupBy(F.col("host").alias("source")).agg(F.count("*").alias("pages"), found.alias("filler_pages"), (found / F.count("*")).alias("share"))


QUERIES = {"p9_found": p9_found, "p9_hosts": p9_hosts}
SQL: dict[str, str] = {}
