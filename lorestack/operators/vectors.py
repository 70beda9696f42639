"""Vector search: exact by blocks, and by inverted lists."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.session import cut

#: Vectors of a block, and rows that the centroids are fitted on at most.
BLOCK, FIT_ROWS = 2048, 8192

#: Recall that the inverted lists reach on held-out rows, two standard errors taken off, and the number of those at most.
RECALL, HELD_ROWS = 0.9, 256


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def blocks(df: DataFrame, key: str, vector: str, size: int = BLOCK, group: str | None = None) -> DataFrame:
    """(block, keys, vectors, groups): blocks of about `size` rows by a hash of the key; null and empty vectors are left out."""
    label = F.lit(None).cast("string") if group is None else F.col(group).cast("string")
    rows = df.filter(F.size(F.coalesce(F.col(vector), F.array())) > 0).select(F.col(key).alias("k"), F.col(vector).alias("v"), label.alias("g"))
    n = max(1, math.ceil(rows.count() / size))
    grouped = rows.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias("block")).agg(F.collect_list(F.struct("k", "v", "g")).alias("r"))
    return grouped.select("block", F.col("r.k").alias("keys"), F.col("r.v").alias("vectors"), F.col("r.g").alias("groups"))


def _vectors(column: pa.ListArray) -> list[np.ndarray]:
    """Vectors of a list column, without a Python object for each number."""
    flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[offsets[i] : offsets[i + 1]] for i in range(len(column))]


def _products(batch: pa.RecordBatch) -> Iterator[tuple[list, list, np.ndarray, list | None]]:
    """(query keys, row keys, similarities, groups) of each pair of blocks and length of vectors, rounded to 6 places."""
    for i in range(batch.num_rows):
        one = batch.slice(i, 1)
        rk, qk, groups = (one.column(c)[0].as_py() for c in ("rk", "qk", "rg"))
        rv, qv = (_vectors(one.column(c)[0].values) for c in ("rv", "qv"))
        for size in {len(v) for v in qv}:
            a, b = [j for j, v in enumerate(qv) if len(v) == size], [j for j, v in enumerate(rv) if len(v) == size]
            if b:
                s = np.round(unit(np.array([qv[j] for j in a], dtype=float)) @ unit(np.array([rv[j] for j in b], dtype=float)).T, 6)
                yield [qk[j] for j in a], [rk[j] for j in b], s, None if groups is None else [groups[j] for j in b]


def _pairs_of_blocks(queries: DataFrame, rows: DataFrame, key: str, vector: str, group: str | None = None) -> DataFrame:
    q = blocks(queries, key, vector).drop("groups").toDF("qb", "qk", "qv")
    r = blocks(rows, key, vector, group=group).toDF("rb", "rk", "rv", "rg")
    # the stated query set against all rows: one row per pair of blocks, spread over the cluster
    return r.join(q).repartition(F.col("rb"), F.col("qb")).select("rk", "rv", "rg", "qk", "qv")


def exact_search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 10, least: float = 0.05) -> DataFrame:
    """(query_id, key, similarity, rank): the k nearest rows of each query by cosine, itself left out.

    The query set is compared with all rows block by block: a pair of blocks is one matrix product that keeps k rows a
    query, so tasks are bounded and nothing grows with rows x queries. Vectors of another length than the query's and
    zero vectors are no neighbours. Ranked by similarity rounded to 6 places, then key."""
    kind = rows.schema[key].dataType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for qk, rk, s, _ in _products(batch):
                most = min(k + 1, s.shape[1])  # the query itself may be among them
                edges = np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most]
                at, to = np.nonzero(s >= np.maximum(edges, least)[:, None])
                out.extend((qk[i], rk[j], float(s[i, j])) for i, j in zip(at.tolist(), to.tolist()) if qk[i] != rk[j])
            columns = list(zip(*out)) if out else [[], [], []]
            kinds = [batch.schema.field("qk").type.value_type, batch.schema.field("rk").type.value_type, pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["query_id", "key", "similarity"])

    near = _pairs_of_blocks(queries, rows, key, vector).mapInArrow(multiply, f"query_id {kind}, key {kind}, similarity double")
    own = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
    return near.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def best_per_group(queries: DataFrame, rows: DataFrame, key: str, vector: str, group: str) -> DataFrame:
    """(query_id, group, similarity): for each query the best similarity of each group of rows (an object's chunks, a
    label), itself left out. Reduced within each product of blocks, so a query gives at most one row per block and group."""
    kind = rows.schema[key].dataType.simpleString()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best: dict[tuple, float] = {}
            for qk, rk, s, groups in _products(batch):
                place = {x: i for i, x in enumerate(rk)}
                names = sorted(set(groups), key=lambda g: (g is None, g))
                codes = np.array([names.index(g) for g in groups]) if len(names) < 64 else np.searchsorted(np.array([g or "" for g in names]), [g or "" for g in groups])
                order = np.argsort(codes, kind="stable")
                starts = np.searchsorted(codes[order], np.arange(len(names)))
                for i, q in enumerate(qk):
                    if q in place:
                        s[i, place[q]] = -2.0
                top = np.maximum.reduceat(s[:, order], starts, axis=1)
                for i, q in enumerate(qk):
                    for g, x in zip(names, top[i].tolist()):
                        if x > max(-1.5, best.get((q, g), -2.0)):
                            best[q, g] = x
            keys = list(best)
            kinds = [batch.schema.field("qk").type.value_type, pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in keys], kinds[0]), pa.array([x[1] for x in keys], kinds[1]), pa.array([best[x] for x in keys], kinds[2])], ["query_id", "g", "similarity"])

    found = _pairs_of_blocks(queries, rows, key, vector, group).mapInArrow(multiply, f"query_id {kind}, g string, similarity double")
    return found.groupBy("query_id", F.col("g").cast(rows.schema[group].dataType).alias(group)).agg(F.max("similarity").alias("similarity"))


_features: dict[tuple[str, int], list[tuple[int, float]]] = {}


def term_features(term: str, dims: int) -> list[tuple[int, float]]:
    """(bucket, signed weight) of a term and its 3-grams; kept by a worker for terms that come again."""

    def place(feature: str) -> tuple[int, int]:
        h = hashlib.sha256(feature.encode()).digest()
        return int.from_bytes(h[:4], "big") % dims, 1 if (h[4] >> 4) % 2 == 0 else -1

    if (term, dims) not in _features:
        if len(_features) > 200_000:
            _features.clear()
        padded = f"#{term}#"
        parts = [(*place("w:" + term), 1.0), *((*place("g:" + padded[i : i + 3]), 0.28) for i in range(len(padded) - 2))]
        _features[term, dims] = [(b, sign * w) for b, sign, w in parts]
    return _features[term, dims]


def hash_texts(texts: list[str | None], dims: int = 256) -> np.ndarray:
    out = np.zeros((len(texts), dims))
    for i, t in enumerate(texts):
        for term, n in Counter(T.py_content_terms(t)).items():
            w = 1 + math.log(n)
            for b, x in term_features(term, dims):
                out[i, b] += w * x
    return unit(out)


def hashed_vectors(docs: DataFrame, key: str, text: Column, dims: int = 256) -> DataFrame:
    """(key, vector): hashed features of a text: each content term (weight 1 + ln of its count) and its 3-grams (0.28 of
    that) are added with the sign of a hash to a bucket; of length 1. All zero for texts without content terms."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = hash_texts(batch.column(1).to_pylist(), dims)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), dims).cast(pa.list_(pa.float64()))], ["key", "vector"])

    return docs.select(F.col(key).alias("key"), text.alias("t")).mapInArrow(run, f"key {kind}, vector array<double>")


def nearest_to(one: np.ndarray, rows: DataFrame, key: str, vector: str, k: int, least: float = 0.05) -> DataFrame:
    """(key, similarity) of the k rows nearest to one vector: a single scan in which each task keeps its k best."""
    kind = rows.schema[key].dataType.simpleString()
    asked = unit(np.asarray(one, dtype=float).reshape(1, -1))[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple] = []
        for batch in batches:
            v = _vectors(batch.column(1))
            fits = [i for i, x in enumerate(v) if len(x) == len(asked)]
            if fits:
                s = np.round(unit(np.array([v[i] for i in fits], dtype=float)) @ asked, 6)
                keys = batch.column(0).to_pylist()
                best = sorted(best + [(keys[i], float(x)) for i, x in zip(fits, s) if x >= least], key=lambda r: (-r[1], r[0]))[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in best]), pa.array([b[1] for b in best], pa.float64())], ["key", "similarity"])

    usable = rows.filter(F.size(F.coalesce(F.col(vector), F.array())) > 0).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    return usable.mapInArrow(run, f"key {kind}, similarity double").orderBy(F.desc("similarity"), "key").limit(k)


def fit_centroids(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centroids by k-means on unit vectors."""
    c = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (at == i).any():
                c[i] = x[at == i].mean(axis=0)
        c = unit(c)
    return c


class InvertedLists:
    """An index of lists around centroids: fitted on a bounded sample, every row assigned. The centroids (the square root
    of the rows, at most 65,536) are broadcast.

    Vectors of each length, of which a table has few, have lists of their own. How many lists a query looks at follows
    from the recall measured on rows that the centroids weren't fitted on; where it can't be measured, all."""

    def __init__(self, rows: DataFrame, key: str, vector: str, lists: int | None = None, fit_rows: int = FIT_ROWS):
        self.key, self.vector = key, vector
        sized = rows.filter(F.size(F.coalesce(F.col(vector), F.array())) > 0).select(F.col(key).alias("k"), F.col(vector).alias("v"), F.size(vector).alias("size"))
        index, held, offset = {}, [], 0
        for size, n in sorted(map(tuple, sized.groupBy("size").count().collect())):
            # chosen and ordered by a hash of the key; the first are held out
            # at least two rows to fit for every list
            most = max(fit_rows, 2 * (lists or min(65536, round(math.sqrt(n)))))
            sample = sized.filter(F.col("size") == size).orderBy(F.xxhash64("k"), "k").limit(most + HELD_ROWS).select("k", "v").collect()
            out = min(HELD_ROWS, len(sample) // 5)
            held += [(r.k, r.v) for r in sample[:out]]
            c = fit_centroids(unit(np.array([r.v for r in sample[out:]], dtype=float)), lists or max(1, min(65536, round(math.sqrt(n)))))
            index[size] = (c, offset)
            offset += len(c)
        self.lists = max(1, offset)
        self.shared = rows.sparkSession.sparkContext.broadcast(index)
        self.held = rows.sparkSession.createDataFrame(held, sized.select("k", "v").schema)
        self.table = cut(self._assign(rows, {size: 1 for size in index}).withColumn("list", F.col("lists")[0]).select("k", "v", "list"))
        self.measured: dict[tuple[int, float], dict[int, tuple[int, float]]] = {}
        self.fitted, self.added = self.table.count(), 0

    def add(self, rows: DataFrame) -> None:
        """Puts new or changed rows into the lists nearest to them; vectors of a new length wait for the next fit."""
        new = self._assign(rows, {size: 1 for size in self.shared.value}).withColumn("list", F.col("lists")[0]).select("k", "v", "list")
        kept = self.table.join(new.select("k"), "k", "left_anti").select("k", "v", "list")
        self.added += new.count()
        self.table = cut(kept.unionByName(new))
        self.measured.clear()

    def remove(self, keys: DataFrame) -> None:
        """Takes the rows of keys (k) out of their lists."""
        self.table = cut(self.table.join(keys.select("k"), "k", "left_anti").select("k", "v", "list"))
        self.measured.clear()

    def stale(self) -> bool:
        """Whether so much was added since the fit (over 200 rows and a quarter) that it should be fitted anew."""
        return self.added > max(200, 0.25 * self.fitted)

    def _assign(self, rows: DataFrame, probes: dict[int, int]) -> DataFrame:
        shared = self.shared

        @F.pandas_udf("array<int>")
        def nearest(v: pd.Series) -> pd.Series:
            out: list = [None] * len(v)
            sizes = v.map(len).to_numpy()
            for size in set(sizes.tolist()) & set(probes):
                c, offset = shared.value[size]
                at = np.flatnonzero(sizes == size)
                s = np.array(v.iloc[at].tolist(), dtype=float).reshape(len(at), -1) @ c.T
                for i, row in zip(at, s):
                    out[i] = (np.argsort(-row, kind="stable")[: probes[size]] + offset).tolist()
            return pd.Series(out)

        usable = rows.filter(F.size(F.coalesce(F.col(self.vector), F.array())).isin([*probes]))
        return usable.select(F.col(self.key).alias("k"), F.col(self.vector).alias("v")).withColumn("lists", nearest("v"))

    def probes(self, k: int = 10, least: float = 0.05) -> dict[int, tuple[int, float]]:
        """Length of vectors -> (lists to look at, their mean recall on the held-out rows; nan: not measured)."""
        if (k, least) in self.measured:
            return self.measured[k, least]
        index = self.shared.value
        vectors = {r.k: np.array(r.v, dtype=float) for r in self.held.collect()}  # at most HELD_ROWS a length
        truth = exact_search(self.held, self.table, "k", "v", k, least).join(self.table.select(F.col("k").alias("key"), "list"), "key")
        ranks: dict[int, dict] = {size: {} for size in index}
        for r in truth.select("query_id", "list").collect():  # at most k a held-out row
            v = vectors[r.query_id]
            c, offset = index[len(v)]
            s = c @ v
            ranks[len(v)].setdefault(r.query_id, []).append(int((np.argsort(-s, kind="stable") == r.list - offset).argmax()))
        out = {}
        for size, (c, _) in index.items():
            out[size] = (len(c), 1.0 if ranks[size] else math.nan)
            for p in range(1, len(c)) if len(ranks[size]) > 1 else ():
                each = np.array([np.mean(np.array(x) < p) for x in ranks[size].values()])
                if each.mean() - 2 * each.std(ddof=1) / math.sqrt(len(each)) >= RECALL:
                    out[size] = (p, float(each.mean()))
                    break
        self.measured[k, least] = out
        return out

    def search(self, queries: DataFrame, k: int = 10, least: float = 0.05) -> DataFrame:
        """(query_id, key, similarity, rank) from the lists nearest to each query."""
        asked = self._assign(queries, {size: p for size, (p, _) in self.probes(k, least).items()}).select(F.col("k").alias("query_id"), F.col("v").alias("q"), F.explode("lists").alias("list"))
        pairs = self.table.join(asked, "list").filter(F.col("k") != F.col("query_id"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
        cosine = F.try_divide(dot("q", "v"), F.sqrt(dot("q", "q") * dot("v", "v")))
        scored = pairs.select("query_id", F.col("k").alias("key"), F.round(cosine, 6).alias("similarity")).filter(F.col("similarity") >= least)
        own = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "key")
        return scored.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


#: Vectors below which every query is compared with all of them.
WORTH_AN_INDEX = 5000


def nearest(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int = 10, index: InvertedLists | None = None) -> DataFrame:
    """exact_search below WORTH_AN_INDEX vectors, else a search of inverted lists (`index`, or new ones)."""
    if index is None and rows.filter(F.size(F.coalesce(F.col(vector), F.array())) > 0).limit(WORTH_AN_INDEX).count() < WORTH_AN_INDEX:
        return exact_search(queries, rows, key, vector, k)
    return (index or InvertedLists(rows, key, vector)).search(queries, k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): the share of the true neighbours that were found."""
    hit = found.select("query_id", "key", F.lit(1).alias("hit"))
    return truth.join(hit, ["query_id", "key"], "left").groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")).alias("recall"))
