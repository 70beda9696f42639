"""Search as a whole, context for a question, notices, and answers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators import extract as X
from lorestack.operators import graph as G
from lorestack.operators import retrieval as R
from lorestack.operators import vectors as V
from lorestack.operators.accounts import age
from lorestack.operators.capture import count, jaccard_tiles
from lorestack.operators.history import content_hash
from lorestack.operators.search import Intent, intent_filter, parse_query
from lorestack.session import cut
from lorestack.sources.tables import kind_key

WEIGHTS = {"lexical": 1.0, "semantic": 0.9, "structured": 0.6}


@dataclass
class Store:
    """What a search reads: heads (id, workspace_id, kind, title, body, attrs, epistemic, origin, confidence, review, state,
    superseded_by, occurred_at, created_at, updated_at, access_count, last_access, content_hash), active relations, and
    evidence (target_id, id, one row per record). Vectors of the heads are made once, when first asked for."""

    heads: DataFrame
    relations: DataFrame
    evidence: DataFrame
    now: str
    made: dict = field(default_factory=dict)

    def vectors(self) -> DataFrame:
        if "vectors" not in self.made:
            living = self.heads.filter("state <> 'deleted'")
            self.made["vectors"] = cut(V.hashed_vectors(living, "id", F.concat_ws("\n", "title", "body")).withColumnRenamed("key", "id"))
        return self.made["vectors"]

    def terms(self) -> DataFrame:
        """(id, state, review, created_at, t, head): the terms of each head, and those of its title alone."""
        if "terms" not in self.made:
            blank = F.lit("")
            text = F.concat(F.coalesce("title", blank), F.lit(" "), F.coalesce("body", blank))
            distinct = lambda x: F.array_distinct(T.content_terms(x))
            self.made["terms"] = cut(self.heads.select("id", "state", "review", "created_at", distinct(text).alias("t"), distinct(F.col("title")).alias("head")))
        return self.made["terms"]


def semantic_list(store: Store, text: str, pool: int, least: float = 0.05, share: float = 0.4) -> DataFrame:
    """(key, rank): the objects nearest to a text, without those far below the nearest."""
    near = V.nearest_to(V.hash_texts([text])[0], store.vectors(), "id", "vector", pool, least)
    one = Window.orderBy(F.desc("similarity"), "key")  # at most `pool` rows
    near = near.withColumn("rank", F.row_number().over(one)).withColumn("top", F.max("similarity").over(one))
    return near.filter(F.col("similarity") >= share * F.col("top")).select("key", "rank")


def candidates(store: Store, intent: Intent, pool: int) -> DataFrame:
    """(id, lexical, semantic, structured): ranks in the lists that an intent gives; the newest that pass its filters where
    neither words nor vectors find anything."""
    spark = store.heads.sparkSession
    living = store.heads.filter("state <> 'deleted'")
    lists = {}
    terms = [t for t in intent.terms if t not in intent.exclude]
    if terms:
        ask = spark.createDataFrame([(0, " ".join(terms))], "query_id int, query string")
        lists["lexical"] = R.bm25(living, "id", F.col("title"), F.col("body"), ask, pool, prefix=True).select("key", "rank")
        lists["semantic"] = semantic_list(store, " ".join(terms), pool)
    listed = None
    for name, df in lists.items():
        part = df.select(F.col("key").alias("id"), F.lit(name).alias("list"), "rank")
        listed = part if listed is None else listed.unionByName(part)
    listed = None if listed is None else cut(listed)  # at most two pools
    if listed is None or listed.isEmpty():
        at = F.coalesce("occurred_at", "created_at")
        newest = living.filter(intent_filter(intent)).select("id", at.alias("at")).orderBy(F.desc("at"), "id").limit(pool)
        listed = newest.select("id", F.lit("structured").alias("list"), F.row_number().over(Window.orderBy(F.desc("at"), "id")).alias("rank"))
    of = lambda name: F.max(F.when(F.col("list") == name, F.col("rank"))).alias(name)
    return listed.groupBy("id").agg(*map(of, WEIGHTS))


def search(store: Store, intent: Intent, limit: int = 20, anchor: str | None = None, include_archived: bool = False, rerank: bool = False) -> DataFrame:
    """The best `limit` objects for an intent: id, title, kind, state, score, rank and why.

    Reciprocal ranks of the lists are added up, with a boost for what lies near an anchor in the graph, and multiplied by
    quality, recency and salience; why is a struct with each list's rank, the depth and the multipliers. With `rerank`
    and at least three results and two terms, scores are blended with how well the words of the query cover the text."""
    limit = min(limit, 200)
    depth = 25 if rerank else limit
    found = candidates(store, intent, max(max(depth, limit) * 5, 100))
    score = sum((F.coalesce(F.lit(w) / (60 + F.col(name)), F.lit(0.0)) for name, w in WEIGHTS.items()), F.lit(0.0))
    anchor = anchor or intent.near
    if anchor:
        near = G.reach(store.relations, store.heads.sparkSession.createDataFrame([(anchor,)], "id string"), 2, 150).filter("depth > 0").select("id", "depth")
        found = found.join(near, "id", "left")
        score = score + F.coalesce(F.lit(0.5) / (60 + F.col("depth") * 10), F.lit(0.0))
    else:
        found = found.withColumn("depth", F.lit(None).cast("int"))
    rows = store.heads.join(found, "id").filter(intent_filter(intent, F.concat_ws(" ", "title", "body"), include_archived))
    ids = rows.select("id")
    proof = store.evidence.join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("evidence"))
    rows = rows.join(G.degrees(store.relations), "id", "left").join(proof, "id", "left")
    rows = rows.withColumn("quality", R.quality()).withColumn("recency", R.recency(F.col("updated_at"), store.now)).withColumn("salience", 0.85 + 0.3 * R.salience(store.now))
    rows = rows.withColumn("score", T.round_half(score * F.col("quality") * F.col("recency") * F.col("salience"), 6))
    because = F.array_compact(F.array(F.when(F.col("lexical").isNotNull(), "matched your words"), F.when(F.col("semantic").isNotNull(), "semantically close"), F.when(F.col("structured").isNotNull(), "matched your filters"), F.when(F.col("depth").isNotNull(), F.concat(F.col("depth").cast("string"), F.lit(" step(s) away in the graph")))))
    why = F.struct("lexical", "semantic", "structured", "depth", *[T.round_half(F.col(c), 4).alias(c) for c in ("quality", "recency", "salience")], because.alias("because"))
    best = rows.select("id", "title", "kind", "state", "score", why.alias("why"), F.concat_ws(" ", "title", "body").alias("_text")).orderBy(F.desc("score"), "id").limit(max(depth, limit))
    best = blend(best, intent.terms, limit) if rerank else best.drop("_text")
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= limit)  # at most 200 rows


def blend(best: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """Scores of at most some dozen results, blended 6 : 4 with coverage and nearness of the terms in _text."""
    best = cut(best)
    top = best.agg(F.max("score"), F.count("*")).first()
    if len(terms) < 2 or top[1] < 3 or not top[0]:
        return best.drop("_text")
    fit = R.proximity(T.tokenize(F.col("_text")), terms)
    return best.withColumn("score", T.round_half((0.6 * F.col("score") / top[0] + 0.4 * T.round_half(fit, 4)) * top[0], 6)).drop("_text")


def similar_to(store: Store, ids: DataFrame, limit: int = 6, least: float = 0.35) -> DataFrame:
    """(id, other, similarity, rank): the objects nearest to each of `ids` (id) by their vectors, themselves left out."""
    ask = store.vectors().join(ids.select("id"), "id", "left_semi")
    near = V.exact_search(ask, store.vectors(), "id", "vector", limit, least)
    return near.select(F.col("query_id").alias("id"), F.col("key").alias("other"), "similarity", "rank")


# --- context -------------------------------------------------------------------------------------------------------------
@dataclass
class Context:
    items: list[dict]
    conflicts: list[dict]
    intent: Intent
    used: int
    budget: int
    considered: int
    question: str = ""


def item_text(terms: list[str]) -> Column:
    """What of an object goes into a context: its body, or a window of it around the terms if it is long, or its title."""
    return F.when(F.length("body") > 900, T.excerpt(F.col("body"), terms or ["\x00"], 800)).when(F.length("body") > 0, F.col("body")).otherwise(F.col("title"))


def pack(items: list[dict], budget: int) -> tuple[list[dict], int]:
    """Items in order until the budget of tokens is used; one that doesn't fit is trimmed if more than 120 are left."""
    out, used = [], 0
    for item in items:
        if used + item["tokens"] <= budget:
            out.append(item)
            used += item["tokens"]
            continue
        room = budget - used
        if room > 120:
            text = item["text"] if len(item["text"]) <= room * 4 else item["text"][: room * 4 - 1] + "…"
            out.append({**item, "text": text, "tokens": count(text), "reason": f"{item['reason']} (trimmed)"})
            used += out[-1]["tokens"]
        if budget - used < 120:
            break
    return out, used


def context(store: Store, question: str, budget: int = 3000, seeds: int = 8, expand: bool = True) -> Context:
    """What memory has on a question: the best hits (priority 1), what the first five are linked to (2; contradictions 1.5),
    for questions about time what the first six replaced (2.5), and the other sides of open conflicts (1.4), in this order
    and within a budget of tokens.

    Every item costs a token at least, so no more than `budget` items by (priority, score, id) are ever collected."""
    spark = store.heads.sparkSession
    intent = parse_query(question, store.now)
    hits = search(store, intent, seeds, include_archived=intent.temporal).collect()
    picked = [(h.id, 1.0, float(h.score), ", ".join(h.why.because), h.rank) for h in hits]
    fields = "id string, priority double, score double, reason string, stage int"
    known = spark.createDataFrame(picked, fields)
    living = store.heads.select("id", "state", "title", "superseded_by", "updated_at").filter("state <> 'deleted'")
    title = {h.id: h.title for h in hits}
    if expand and hits:
        first = spark.createDataFrame([(h.id, float(h.score), h.rank, (h.title or "")[:60]) for h in hits[:5]], "id string, seed double, at int, name string")
        near = G.neighbours(store.relations, first, living, 0.3).join(first, "id")
        clash = F.col("type") == "contradicts"
        label = F.when(F.col("direction") == "out", G.other_label(F.col("type"))).otherwise(F.col("type"))
        near = near.select(F.col("other").alias("id"), F.when(clash, 1.5).otherwise(2.0).alias("priority"), (F.col("seed") * F.when(clash, 0.9).otherwise(0.5)).alias("score"), F.concat(F.regexp_replace(label, "_", " "), F.lit(" — "), F.col("name")).alias("reason"), (F.col("at") * 10).alias("stage"))
        # a node that several seeds are linked to counts for the first of them
        near = near.groupBy("id").agg(F.min(F.struct("stage", "priority", (-F.col("score")).alias("s"), "reason")).alias("r")).select("id", "r.priority", (-F.col("r.s")).alias("score"), "r.reason", "r.stage")
        known = known.unionByName(near.join(known.select("id"), "id", "left_anti").orderBy("priority", F.desc("score"), "id").limit(budget))
    known = cut(known)
    if intent.temporal:
        lead = known.orderBy("stage", "priority", F.desc("score"), "id").limit(6).select(F.col("id").alias("superseded_by"))
        own = Window.partitionBy("superseded_by").orderBy(F.desc("updated_at"), "id")
        prior = living.join(lead, "superseded_by").withColumn("n", F.row_number().over(own)).filter("n <= 3").groupBy("id").agg(F.min("superseded_by").alias("by"))
        prior = prior.join(living.select(F.col("id").alias("by"), F.substring("title", 1, 50).alias("new")), "by", "left")
        prior = prior.select("id", F.lit(2.5).alias("priority"), F.lit(0.3).alias("score"), F.concat(F.lit("superseded by "), F.coalesce("new", F.lit(""))).alias("reason"), F.lit(1000).alias("stage"))
        known = known.unionByName(prior.join(known.select("id"), "id", "left_anti"))
    top = max((h.score for h in hits), default=0.0)
    relevant = known.filter((F.col("priority") <= 1.5) & (F.col("score") >= 0.25 * top)).select("id")
    clashes = store.relations.filter("type = 'contradicts'").select("id", F.col("src_id").alias("a"), F.col("dst_id").alias("b"), "confidence")
    touching = clashes.join(relevant.select(F.col("id").alias("a")), "a", "left_semi").unionByName(clashes.join(relevant.select(F.col("id").alias("b")), "b", "left_semi").select("a", "id", "b", "confidence")).dropDuplicates(["id"])
    names = living.select("id", "title")
    for side in "ab":
        touching = touching.join(names.select(F.col("id").alias(side), F.col("title").alias(f"{side}_title")), side)
    conflicts = [r.asDict() for r in touching.orderBy(F.desc_nulls_last("confidence"), "id").limit(10).collect()]
    if conflicts:
        other = spark.createDataFrame(sorted({(c[s], 1.4, 0.45, "conflicts with other material in this context", 2000) for c in conflicts for s in "ab"}), fields)
        known = known.unionByName(other.join(known.select("id"), "id", "left_anti"))
    full = store.heads.join(known, "id").withColumn("text", item_text(intent.terms)).withColumn("tokens", T.estimate_tokens(F.concat_ws("\n", "title", "text")).cast("int"))
    columns = ["id", "title", "kind", "text", "tokens", "reason", "priority", "score", "epistemic", "origin", "review", "state", "occurred_at", "content_hash"]
    ordered = [r.asDict() for r in full.select(*columns).orderBy("priority", F.desc("score"), "id").limit(budget).collect()]
    items, used = pack(ordered, budget)
    return Context(items, conflicts, intent, used, budget, len(ordered), question)


def render(ctx: Context) -> str:
    """A context as text, each item with where it comes from and why it is there, then the disagreements in it."""
    lines = []
    for i in ctx.items:
        marks = [i["kind"], i["epistemic"]] + (["AI-derived"] if i["origin"] == "ai" else []) + ([{"confirmed": "confirmed", "rejected": "REJECTED"}[i["review"]]] if i["review"] in ("confirmed", "rejected") else [])
        marks += [i["occurred_at"].isoformat()[:10]] if i["occurred_at"] else []
        lines += [f"[{i['id']}] {i['title']}", f"  ({', '.join(m or '' for m in marks)}; included because: {i['reason']})", "  " + re.sub(r"\n+", "\n  ", i["text"] or ""), ""]
    if ctx.conflicts:
        lines.append("KNOWN DISAGREEMENTS IN THIS MATERIAL:")
        lines += [f"  - [{c['a']}] \"{(c['a_title'] or '')[:60]}\" vs [{c['b']}] \"{(c['b_title'] or '')[:60]}\"" for c in ctx.conflicts]
    return "\n".join(lines).strip()


def cache_key(question: str, items: list[tuple[str, str | None]], provider: str = "any") -> str:
    """The key under which an answer to a question from these (id, content hash) items may be used again."""
    import hashlib
    import json

    plain = " ".join(re.sub(r"[\W_]", " ", T.py_fold(question)).split())
    body = {"m": sorted(f"{i}:{h}" for i, h in items), "p": provider, "q": plain, "t": sorted(set(T.py_content_terms(question)))}
    return hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()


# Questions that quoting can't answer.
_SYNTHESIS = re.compile(r"\b(summari[sz]e|summary|compare|contrast|difference between|overall|in total|how many|how much total|list all|what are all|trend|pattern|across all|timeline of|walk me through|explain why|pros and cons)\b", re.I)


def escalate(question: str, items: int, grounded: bool, confidence: float, policy: str = "auto", least: float = 0.55) -> str | None:
    """Why a model should be asked: 'always', 'ungrounded', 'synthesis' or 'unsure'. None: the quoted answer stands, or memory
    holds nothing that a model could answer from."""
    if policy in ("never", "always"):
        return None if policy == "never" else "always"
    if not items:
        return None
    return "ungrounded" if not grounded else "synthesis" if _SYNTHESIS.search(question) else "unsure" if confidence < least else None


def ask(store: Store, question: str, cache: dict[str, dict] | None = None, budget: int = 3000) -> dict:
    """An answer quoted from the context of a question, from the cache if it was asked on the same material, with
    citations, its confidence, why a model should be asked (or None), and notices."""
    ctx = context(store, question, budget)
    if not ctx.items:
        return {"answer": None, "grounded": False, "confidence": 0.0, "citations": [], "escalate": None, "notices": [], "cached": False}
    key = cache_key(question, [(i["id"], i["content_hash"]) for i in ctx.items])
    if cache is not None and key in cache:
        return {**cache[key], "cached": True}
    spark = store.heads.sparkSession
    docs = spark.createDataFrame([(i["id"], i["title"], i["text"], i["state"]) for i in ctx.items], "id string, title string, text string, state string")
    rows = X.answers(docs, "id", F.col("title"), F.col("text"), F.col("state"), question, ctx.intent.retrospective).collect()
    lead = sorted((r for r in rows if r.part == "answer"), key=lambda r: (-r.score, r.key, r.pos))
    terms = {T.py_stem(t) for t in T.py_content_terms(question)}
    sure = X.answer_confidence([r.score for r in lead], [r.matched for r in lead], len(terms))
    ids = spark.createDataFrame([(i["id"],) for i in ctx.items], "id string")
    out = {
        "answer": " ".join(r.sentence for r in lead) or None, "grounded": bool(lead), "confidence": sure, "citations": list(dict.fromkeys(r.key for r in lead)),
        "escalate": escalate(question, len(ctx.items), bool(lead), sure), "notices": [n.asDict() for n in question_notices(store, ids).collect()],
    }
    if cache is not None:
        cache[key] = out
    return {**out, "cached": False}


# --- notices ---------------------------------------------------------------------------------------------------------------
def question_notices(store: Store, ids: DataFrame) -> DataFrame:
    """(kind, object_id, strength, message) about the material `ids` (id) behind an answer: what of it was replaced, and
    whether all of it is over a year old; the three foremost."""
    rows = store.heads.join(ids.select("id").distinct(), "id", "left_semi")
    new = store.heads.select(F.col("id").alias("superseded_by"), F.col("title").alias("_new"))
    replaced = rows.join(new, "superseded_by").select(F.lit("superseded-source").alias("kind"), F.col("superseded_by").alias("object_id"), F.lit(0.7).alias("strength"), F.concat(F.lit('"'), F.col("title"), F.lit('" has been replaced by "'), F.col("_new"), F.lit('".')).alias("message"))
    newest = rows.agg(F.max(F.coalesce("occurred_at", "created_at")).alias("at"))
    days = F.abs(F.unix_timestamp(F.lit(store.now).cast("timestamp")) - F.unix_timestamp(F.col("at").cast("timestamp"))) / 86400
    old = newest.filter(days > 365).select(F.lit("all-old").alias("kind"), F.lit(None).cast("string").alias("object_id"), F.lit(0.55).alias("strength"), F.concat(F.lit("Everything behind this answer is at least "), age(days), F.lit(" old.")).alias("message"))
    return replaced.unionByName(old).orderBy(F.desc("strength"), "object_id").limit(3)


def object_notices(store: Store, pairs: DataFrame, least: float = 0.45, most: int = 5) -> DataFrame:
    """(id, kind, other, strength, age_days) for each object of `pairs` (id, other, and overlap where it is known): what it
    overlaps with (from 0.45 of the terms; stronger if over 90 days apart), what it contradicts by an active relation, and
    rejected objects among the pairs whose title is much like it; the `most` strongest of each."""
    t = store.terms()
    share = lambda a, b: F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))
    days = F.abs(F.unix_micros(F.col("c1").cast("timestamp")) - F.unix_micros(F.col("c2").cast("timestamp"))) / 86_400_000_000
    both = pairs.filter("id <> other").distinct()
    if "overlap" not in pairs.columns:
        both = both.join(t.select("id", F.col("t").alias("x")), "id").join(t.select(F.col("id").alias("other"), F.col("t").alias("y")), "other").withColumn("overlap", share("x", "y")).drop("x", "y")
    both = both.join(t.select("id", F.col("created_at").alias("c1"), F.size("t").alias("n")), "id").join(t.select(F.col("id").alias("other"), "review", F.col("created_at").alias("c2"), F.size("head").alias("m")), "other").withColumn("days", days)
    seen = both.filter("overlap >= 0.45").select("id", F.lit("seen-before").alias("kind"), "other", F.least(F.lit(0.95), F.col("overlap") + F.when(F.col("days") > 90, 0.1).otherwise(0.0)).alias("strength"), "days")
    # terms meet only where their numbers allow half of them to be shared
    no = both.filter((F.col("review") == "rejected") & (2 * F.least("n", "m") >= F.greatest("n", "m"))).select("id", "other", "days")
    no = no.join(t.select("id", F.col("t").alias("x")), "id").join(t.select(F.col("id").alias("other"), "head"), "other").filter(share("x", "head") >= 0.5)
    no = no.select("id", F.lit("previously-rejected").alias("kind"), "other", F.lit(0.75).alias("strength"), "days")
    c = store.relations.filter("type = 'contradicts'").select("src_id", "dst_id", F.greatest(F.lit(0.6), F.coalesce("confidence", F.lit(0.6))).alias("strength"))
    sides = c.select(F.col("src_id").alias("id"), F.col("dst_id").alias("other"), "strength").union(c.select("dst_id", "src_id", "strength"))
    against = sides.join(pairs.select("id").distinct(), "id", "left_semi").groupBy("id", "other").agg(F.max("strength").alias("strength"))
    against = against.select("id", F.lit("contradiction").alias("kind"), "other", "strength", F.lit(None).cast("double").alias("days"))
    own = Window.partitionBy("id").orderBy(F.desc("strength"), "kind", "other")
    every = seen.unionByName(against).unionByName(no).filter(F.col("strength") >= least)
    return every.withColumn("n", F.row_number().over(own)).filter(F.col("n") <= most).select("id", "kind", "other", T.round_half(F.col("strength"), 4).alias("strength"), F.floor("days").alias("age_days"))


def workspace_notices(store: Store, stale_days: int = 365, most: int = 5) -> DataFrame:
    """(workspace_id, kind, object_id, n, strength): open disagreements, figures that nobody checked for a year (the `most`
    oldest of each workspace), and workspaces of which over 70 % is linked to nothing."""
    rel = store.relations
    h = store.heads.select("id", "workspace_id", "state")
    gone = h.filter("state = 'deleted'").select("id")
    clash = rel.filter("type = 'contradicts'").select("workspace_id", F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b")).distinct()
    for side in "ab":
        clash = clash.join(gone.withColumnRenamed("id", side), side, "left_anti")
    clash = clash.groupBy("workspace_id").agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string").alias("object_id")
    open_ = clash.select("workspace_id", F.lit("open-conflicts").alias("kind"), none, "n", F.least(F.lit(0.9), 0.5 + F.col("n") * 0.1).alias("strength"))
    edge = F.lit(store.now).cast("timestamp_ntz") - F.expr(f"interval {stale_days} days")
    digit = F.coalesce(F.col("title").rlike("[0-9]"), F.lit(False)) | F.coalesce(F.col("body").rlike("[0-9]"), F.lit(False))
    stale = store.heads.filter((F.col("state") == "active") & (F.col("review") == "unreviewed") & (F.col("updated_at") < edge) & digit)
    own = Window.partitionBy("workspace_id").orderBy("updated_at", "id")
    stale = stale.select("workspace_id", "id", "updated_at").withColumn("k", F.row_number().over(own)).filter(F.col("k") <= most)
    stale = stale.select("workspace_id", F.lit("possibly-outdated").alias("kind"), F.col("id").alias("object_id"), F.lit(1).cast("long").alias("n"), F.lit(0.5).alias("strength"))
    active = store.heads.filter((F.col("state") == "active") & (kind_key() != "entity")).select("id", "workspace_id")
    linked = rel.filter("type <> 'mentions'").select(F.explode(F.array("src_id", "dst_id")).alias("id")).distinct().withColumn("linked", F.lit(1))
    loose = active.join(linked, "id", "left").groupBy("workspace_id").agg(F.count("*").alias("total"), F.sum(F.when(F.col("linked").isNull(), 1).otherwise(0)).alias("n")).filter((F.col("total") >= 20) & (F.col("n") / F.col("total") > 0.7))
    loose = loose.select("workspace_id", F.lit("unconnected").alias("kind"), none, "n", F.lit(0.45).alias("strength"))
    return open_.unionByName(stale).unionByName(loose)


def near_pairs(store: Store, threshold: float = 0.45) -> DataFrame:
    """(id, other, overlap) of living objects whose contents share at least `threshold` of their terms, both ways."""
    rows = store.terms().filter("state <> 'deleted'")
    p = jaccard_tiles(rows, "id", "t", threshold).withColumnRenamed("similarity", "overlap")
    return p.select(F.col("a").alias("id"), F.col("b").alias("other"), "overlap").union(p.select("b", "a", "overlap"))


def recall_bundle(store: Store, ids: DataFrame, history: DataFrame, derivations: DataFrame) -> DataFrame:
    """One row per object of `ids` (id): its head with its versions, provenance, neighbours, evidence, conflicts and what it
    replaced as nested lists in order."""
    ask = ids.select("id").distinct()
    nest = lambda df, key, name, *c: df.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*c))).alias(name))
    only = lambda df, key: df.join(ask.select(F.col("id").alias(key)), key, "left_semi")
    out = store.heads.join(ask, "id", "left_semi").select("id", "title", "state", "epistemic")
    near = G.neighbours(store.relations, ask, store.heads.select("id", "state"))
    parts = (
        nest(only(history, "id"), "id", "versions", "head_version", "title"), nest(only(derivations, "target_id"), "target_id", "provenance", "target_version", F.col("id").alias("derivation"), "method"),
        nest(near.filter("type <> 'contradicts'"), "id", "neighbours", "label", "other"), nest(near.filter("type = 'contradicts'"), "id", "conflicts", "other", "confidence"),
        nest(only(store.evidence, "target_id"), "target_id", "evidence", F.col("id").alias("evidence_id"), "stance"), nest(only(store.heads, "superseded_by").filter("state <> 'deleted'"), "superseded_by", "replaced", F.col("id").alias("older"), "title"),
    )
    for part in parts:
        out = out.join(part, "id", "left")
    return out
