"""Near-duplicate records with small edits.

Method: sequential Bayesian verification. Texts get a signature of min-hashes of their word runs; bands of the signature
make candidate pairs. A candidate's signatures, one bit for each hash, are compared batch by batch: after each batch the
posterior of the similarity given the bits that agree is known, and the pair is dropped when the chance that it reaches
the threshold is under `miss`. What survives all batches is verified exactly on the sets of word runs.

Scale: equal texts are one class first, so a page copied a million times is one row. Signatures are made in one pass
with numpy; only (band key, class) pairs of 14 bytes are shuffled, then 32 bytes of signature per candidate, and
the texts of survivors alone. Hot bands are split into cells. Nothing is collected; the keys of survivors are broadcast
only below a checked size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorestack.operators.blocks import block_pairs
from lorestack.operators.components import connected_components
from lorestack.session import cut, lookup_join
from lorestack.sources.tables import current_rows, kind_key, table

#: Words are lower-cased runs of letters and digits.
WORD = re.compile(r"[^\W_]+")
#: Words kept by a worker.
CACHE_WORDS = 1 << 19
SLICE_WORDS = 1 << 18


def band_plan(threshold: float, miss: float) -> tuple[int, int]:
    """(bands, rows): rows by the threshold, bands such that a pair at it shares none with a chance under `miss`."""
    rows = 4 if threshold < 0.65 else 6 if threshold < 0.78 else 9
    bands = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return math.ceil(bands / 16) * 16, rows


def least_agreement(threshold: float, miss: float, batch: int, batches: int) -> list[int]:
    """For each batch the bits that must agree so far.

    A bit agrees with probability (1 + s) / 2 at similarity s; s has a uniform prior. A pair is dropped where the
    posterior P(s >= threshold | m of n agree) is under `miss`.
    """
    s = (np.arange(2000) + 0.5) / 2000
    p = (1 + s) / 2
    out = []
    for k in range(1, batches + 1):
        n = k * batch
        for m in range(n + 1):
            log = m * np.log(p) + (n - m) * np.log1p(-p)
            w = np.exp(log - log.max())
            if w[s >= threshold].sum() / w.sum() >= miss:
                out.append(m)
                break
    return out


_words: dict[str, int] = {}


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words one after the other, number of words of each text)."""
    if len(_words) > CACHE_WORDS:
        _words.clear()
    found = [WORD.findall(t.lower()) for t in texts]
    for word in {w for words in found for w in words if w not in _words}:
        _words[word] = xxhash.xxh64_intdigest(word)
    get = _words.__getitem__
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((h for words in found for h in map(get, words)), np.uint64, int(sizes.sum())), sizes


def run_hashes(texts: list[str], run: int) -> list[np.ndarray]:
    """The distinct hashes of runs of `run` words of each text; none for texts with fewer words."""
    hashes, sizes = word_hashes(texts)
    n = len(hashes) - run + 1
    if n <= 0:
        return [np.empty(0, np.uint64) for _ in texts]
    mixed = np.zeros(n, np.uint64)
    for k in range(run):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + n]
        mixed ^= mixed >> np.uint64(29)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    ends = np.cumsum(sizes)
    return [np.unique(mixed[e - s : e - run + 1]) if s >= run else np.empty(0, np.uint64) for e, s in zip(ends, sizes)]


def signatures(sets: list[np.ndarray], count: int, seed: int = 7) -> np.ndarray:
    """`count` min-hashes (32 bits) of each non-empty set, in one array of sets x hashes."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    adds = rng.integers(0, 1 << 63, count, dtype=np.uint64)
    out = np.empty((len(sets), count), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    for k in range(count):
        out[:, k] = np.minimum.reduceat(((flat * factors[k] + adds[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 32-bit key of each band of each signature; bands that agree by chance are told apart by the bits."""
    parts = signature[:, : bands * rows].reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.zeros(parts.shape[:2], np.uint64)
    for k in range(rows):
        keys = (keys ^ parts[:, :, k]) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(31)
    return (keys >> np.uint64(32)).astype(np.uint32).view(np.int32)


def packed_bits(signature: np.ndarray) -> np.ndarray:
    """The lowest bits of the min-hashes, 64 to a number; hashes beyond a full number are left out."""
    bits = np.packbits((signature[:, : signature.shape[1] // 64 * 64] & 1).astype(np.uint8), axis=1, bitorder="little")
    return bits.view(np.int64)


def _sets(texts: list[str | None], run: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(start, run hashes) of slices of the texts, by size."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") // 6 + 1
        if size > SLICE_WORDS or i == len(texts) - 1:
            yield start, run_hashes([t or "" for t in texts[start : i + 1]], run)
            start, size = i + 1, 0


def signed_texts(docs: DataFrame, key: str, text: str, run: int, bands: int, rows: int) -> DataFrame:
    """(key, class, proof, bands, bits) of each text with at least `run` words, in one pass without a shuffle.

    class and proof are the halves of a 128-bit hash of the text's set of word runs. bands and bits are given where a task
    sees a set for the first time and null where it sees it again, so copies are combined before any shuffle.
    """
    kind = docs.schema[key].dataType.simpleString()

    def sign(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in stream:
            for start, sets in _sets(batch.column(1).to_pylist(), run):
                keep = [i for i, s in enumerate(sets) if len(s)]
                classes = [xxhash.xxh128_intdigest(sets[i].tobytes()) for i in keep]
                new: dict[int, int] = {}
                for c, i in zip(classes, keep):
                    if c not in seen and c not in new:
                        new[c] = i
                seen.update(new)
                signed = signatures([sets[i] for i in new.values()], bands * rows)
                place = {i: n for n, i in enumerate(new.values())}
                take = pa.array([place.get(i) for i in keep], pa.int32())
                lists = [
                    pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1), kind), max(1, x.shape[1])).cast(pa.list_(kind)).take(take)
                    for x, kind in ((band_keys(signed, bands, rows), pa.int32()), (packed_bits(signed), pa.int64()))
                ]
                ids = batch.column(0).take(pa.array([start + i for i in keep], pa.int32()))
                halves = [pa.array(np.array([c >> shift & (1 << 64) - 1 for c in classes], np.uint64).view(np.int64), pa.int64()) for shift in (64, 0)]
                yield pa.RecordBatch.from_arrays([ids, *halves, *lists], ["key", "class", "proof", "bands", "bits"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(sign, f"key {kind}, class long, proof long, bands array<int>, bits array<long>")


def distinct_classes(signed: DataFrame) -> DataFrame:
    """signed (key, class, proof, ...) without proof, where different sets whose classes collide (some three pairs among 10^10
    texts) have classes of their own."""
    both = signed.groupBy("class").agg(F.min("proof").alias("_l"), F.max("proof").alias("_h")).filter("_l <> _h").select("class", F.lit(True).alias("_clash"))
    both = cut(both)
    if both.isEmpty():
        return signed.drop("proof")
    apart = F.when(F.col("_clash"), F.xxhash64("class", "proof")).otherwise(F.col("class"))
    return lookup_join(signed, both, ["class"], "left", spread=F.col("key")).withColumn("class", apart).drop("_clash", "proof")


def prefix_rows(docs: DataFrame, text: str, classes: DataFrame, key: str, run: int, threshold: float) -> DataFrame:
    """(class, hash): of each class (key, class) the least n - ceil(threshold * n) + 1 of its n run hashes. Two sets that are
    alike to the threshold have one of these in common, whatever the order, so blocks of them lose no pair."""

    def take(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for start, sets in _sets(batch.column(1).to_pylist(), run):
                least = [s[: len(s) - math.ceil(threshold * len(s) - 1e-9) + 1] for s in sets]  # sets are sorted
                at = pa.array(np.repeat(np.arange(len(sets)) + start, [len(x) for x in least]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate([*least, np.empty(0, np.uint64)]).view(np.int64), pa.int64())], ["class", "hash"])

    first = classes.groupBy("class").agg(F.min("key").alias("key"))
    texts = lookup_join(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), first, ["key"]).select("class", "text").dropDuplicates(["class"])
    return texts.mapInArrow(take, "class long, hash long")


def similar_classes(
    docs: DataFrame, key: str, text: str, threshold: float = 0.8, run: int = 5, band_miss: float = 0.02, miss: float = 0.002,
    keep: Callable[[DataFrame], DataFrame] | None = None,
    source: DataFrame | None = None, exact: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of texts that are alike to at least `threshold`, by the Jaccard similarity of their sets of runs of
    `run` words.

    members: (key, class), every text with at least `run` words; texts with equal sets share a class. pairs: (a, b,
    similarity), a < b, of different classes. Similarities are exact. A pair right at the threshold shares no band with
    a chance under `band_miss`, which falls fast above it (at 0.5: 1.6 %, at 0.56: 0.13 %, at 0.6: 0.01 %), and is dropped by
    the comparison of signatures with a chance of about `miss`. Null, empty and shorter texts have no class. Repeated keys
    give repeated members. Only key and text are read. `keep` may select members and rename their key; classes without a
    member left have no pairs. `source` has the texts by key as docs has, where reading docs again would cost more.
    With `exact` no pair is missed: candidates share a run hash of their least ones instead of a band, and all are verified.
    """
    bands, rows = band_plan(threshold, band_miss)
    signed = distinct_classes(cut(signed_texts(docs, key, text, run, bands, rows)))
    every = signed.select("key", "class")
    members = keep(every) if keep else every
    fresh = signed.filter("bits is not null")
    banded = fresh.select("class", F.posexplode("bands").alias("no", "band")).withColumn("no", F.col("no").cast("short"))
    if exact:
        candidates = block_pairs(cut(prefix_rows(source or docs, text, every, key, run, threshold)), ["hash"], "class")
    else:
        candidates = block_pairs(banded, ["no", "band"], "class")
    if keep:
        there = members.select("class").distinct()
        candidates = candidates.join(there.withColumnRenamed("class", "a"), "a", "left_semi").join(there.withColumnRenamed("class", "b"), "b", "left_semi")
    bits = fresh.select("class", "bits").dropDuplicates(["class"])
    pairs = candidates.join(bits.select(F.col("class").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("class").alias("b"), F.col("bits").alias("y")), "b")
    survivors = cut((candidates if exact else pairs.filter(_agrees(least_agreement(threshold, miss, 64, bands * rows // 64)))).select("a", "b"))
    # the texts of the survivors, and of these one for each class
    needed = survivors.select(F.col("a").alias("class")).union(survivors.select(F.col("b").alias("class"))).distinct()
    first = cut(every.join(needed, "class", "left_semi").groupBy("class").agg(F.min("key").alias("key")))
    texts = lookup_join((source or docs).select(F.col(key).alias("key"), F.col(text).alias("text")), first, ["key"]).select("class", "text").dropDuplicates(["class"])
    both = survivors.join(texts.select(F.col("class").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("class").alias("b"), F.col("text").alias("y")), "b")

    def verify(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = (batch.column(k).to_pylist() for k in (0, 1))
            known: dict[int, set] = {}
            found = []
            for m, n, x, y in zip(a, b, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for c, t in ((m, x), (n, y)):
                    if c not in known:
                        words = WORD.findall(t.lower())
                        known[c] = set(zip(*(words[k:] for k in range(run))))
                shared = len(known[m] & known[n])
                found.append(shared / (len(known[m]) + len(known[n]) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], ["a", "b", "similarity"])

    return members, both.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, similarity double").filter(F.col("similarity") >= threshold)


def _agrees(least: list[int]) -> Column:
    """Whether the bits agree enough after every batch; later batches are looked at only if the earlier ones passed."""
    same, condition = None, F.lit(True)
    for k, m in enumerate(least):
        here = F.lit(64) - F.bit_count(F.col("x")[k].bitwiseXOR(F.col("y")[k]))
        same = here if same is None else same + here
        condition = condition & (same >= m)
    return condition


def duplicate_groups(docs: DataFrame, key: str, text: str, threshold: float = 0.8, run: int = 5, band_miss: float = 0.02, miss: float = 0.002) -> DataFrame:
    """One row per text that has a class: (key, class, group, links).

    group is the lowest class of the connected component, links the number of other classes that the class is alike to.
    A text alone is its own group. Pairs of classes are in similar_classes.
    """
    return group_members(*similar_classes(docs, key, text, threshold, run, band_miss, miss))


def group_members(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Members with the group of their class and its number of links."""
    pairs = cut(pairs.select("a", "b"))
    links = pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("class")).agg(F.count("*").alias("links"))
    groups = connected_components(pairs, "a", "b").select(F.col("node").alias("class"), "component")
    out = members.join(links, "class", "left").join(groups, "class", "left")
    return out.select("key", "class", F.coalesce("component", "class").alias("group"), F.coalesce("links", F.lit(0)).alias("links"))


def key_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): all pairs of different keys that are alike, equal sets included, a < b."""
    equal = block_pairs(members, ["class"], "key")
    left, right = (members.select(F.col("key").alias(f"k{c}"), F.col("class").alias(c)) for c in "ab")
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b"))
    return equal.select("a", "b").union(across)


#: The task's measure: runs of three words, half of them shared, at least 20 words in the body.
P2_RUN, P2_THRESHOLD, P2_WORDS = 3, 0.5, 20


def _store_pairs(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Members and pairs of current non-entity objects with enough words in the body.

    All deliveries are signed as they are read; which of them are current is decided on keys alone, so that no text is
    shuffled for it.
    """
    objects = table(spark, folder, "knowledge_object").filter("id is not null")
    # possessive runs: reading stops at the last word that is needed
    enough = F.col("body").rlike(rf"^(?:[^\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]++){{{P2_WORDS}}}")
    row = F.struct("id", "head_version", "ingested_at")
    every = objects.select(row.alias("key"), F.concat_ws("\n", "title", "body").alias("text"))
    texts = objects.filter((kind_key() != "entity") & enough).select(row.alias("key"), F.concat_ws("\n", "title", "body").alias("text"))
    heads = current_rows(objects, "head_version", "ingested_at").select(F.struct("id", "head_version", "ingested_at").alias("key"))

    def current(members: DataFrame) -> DataFrame:
        return members.join(heads, "key", "left_semi").select(F.col("key.id").alias("key"), "class").distinct()

    return similar_classes(texts, "key", "text", P2_THRESHOLD, P2_RUN, keep=current, source=every)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = key_pairs(*_store_pairs(spark, folder))
    return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return group_members(*_store_pairs(spark, folder)).select(F.col("key").alias("id"), "class", "group", "links")


SQL = {
    "p2_found": r"""
WITH head AS (SELECT DISTINCT ON (id) id, kind, title, body FROM knowledge_object ORDER BY id, head_version DESC, ingested_at),
txt AS (SELECT id, regexp_extract_all(lower(concat_ws(chr(10), title, body)), '[\p{L}\p{N}]+') AS w FROM head
  WHERE lower(trim(kind)) <> 'entity' AND len(regexp_extract_all(lower(body), '[\p{L}\p{N}]+')) >= 20),
sh AS (SELECT DISTINCT id, s FROM (SELECT id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS s FROM txt)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pair AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)
SELECT id_a, id_b FROM pair JOIN n x ON x.id = id_a JOIN n y ON y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)
"""
}
QUERIES = {"p2_found": p2_found, "p2_groups": p2_groups}
