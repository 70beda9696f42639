"""From text to retrieval units, mentions and proposals."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorestack.functions import text as T
from lorestack.operators.blocks import block_pairs
from lorestack.session import cut, lookup_join

def count(text: str) -> int:
    return max(math.ceil(len(text) / 4), math.ceil(len(text.split()) * 1.3))


def chunk(text: str | None, target: int = 220, overlap: int = 1) -> list[tuple[str, int, int]]:
    """(chunk, tokens, offset): sentences packed to about `target` tokens; a chunk begins with the last `overlap` sentences
    of the one before. Longer sentences are cut at words. A paragraph's end closes a chunk that is over 60 % full.

    offset is where the chunk's first sentence stands, 0 where white space in it was put right."""
    if not text or not text.strip():
        return []
    out: list[tuple[str, int, int]] = []
    held: list[tuple[str, int]] = []
    seen = 0

    def close() -> None:
        nonlocal held, seen
        if held:
            whole = " ".join(s for s, _ in held)
            at = max(text.find(held[0][0], seen), 0)
            seen = at + 1
            out.append((whole, count(whole), at))
            held = held[-overlap:] if overlap else []

    for paragraph in re.split(r"\n{2,}", text):
        for sentence in T.py_sentences(paragraph):
            size = count(sentence)
            if size > target:
                close()
                words, step = sentence.split(), max(1, int(target / 1.3))
                for i in range(0, len(words), step):
                    piece = " ".join(words[i : i + step])
                    out.append((piece, count(piece), max(text.find(piece, seen), 0)))
                held = []
                continue
            if sum(n for _, n in held) + size > target:
                close()
            held.append((sentence, size))
        if sum(n for _, n in held) > 0.6 * target:
            close()
    close()
    return out


def chunk_texts(docs: DataFrame, key: str, text: str, target: int = 220) -> DataFrame:
    """(key, seq, chunk, tokens, offset, hash) of each text; none for null and blank texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, i, *c) for k, t in zip(frame["key"], frame["text"]) for i, c in enumerate(chunk(t, target))]
            yield pd.DataFrame(rows, columns=["key", "seq", "chunk", "tokens", "offset"])

    parts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, seq int, chunk string, tokens int, offset int")
    return parts.withColumn("hash", F.sha2(F.concat_ws("\x1f", F.lit("chunk"), "chunk"), 256))


def stride_chunks(docs: DataFrame, key: str, text: Column, size: int = 400, step: int = 360) -> DataFrame:
    """(key, seq, hash): windows of fixed size, for index maintenance where sentences don't matter."""
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - (size - step)) / step)).cast("int")
    rows = docs.filter(F.length(text) > 0).select(F.col(key).alias("key"), text.alias("t"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    return rows.select("key", "seq", F.sha2(F.substring("t", F.col("seq") * step + 1, F.lit(size)), 256).alias("hash"))


def index_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, hash, change) of two sets of chunks (key, hash): kept ones need no new vectors, stale ones go."""
    o, n = old.select("key", "hash").distinct().withColumn("o", F.lit(1)), new.select("key", "hash").distinct().withColumn("n", F.lit(1))
    change = F.when(F.col("o").isNull(), "new").when(F.col("n").isNull(), "stale").otherwise("kept")
    return o.join(n, ["key", "hash"], "full_outer").select("key", "hash", change.alias("change"))


def jaccard_join(sets: DataFrame, key: str, terms: str, threshold: float) -> DataFrame:
    """(a, b, similarity): pairs of sets alike to at least `threshold`, exact, without comparing all pairs.

    Prefix filter: ordered by rarity, two such sets share one of their first n - ceil(threshold * n) + 1 terms. Only the
    rare ends of sets make blocks, and large blocks are split."""
    rows = sets.select(F.col(key).alias("key"), F.array_distinct(F.col(terms)).alias("t")).filter(F.size("t") > 0)
    each = rows.select("key", F.size("t").alias("n"), F.explode("t").alias("term"))
    rarity = each.groupBy("term").agg(F.count("*").alias("df")).filter("df > 1")
    # terms of one set alone join nothing, but keep their place at the rare end
    placed = each.join(rarity, "term", "left").withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy(F.coalesce("df", F.lit(1)), "term")))
    prefix = placed.filter((F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1) & F.col("df").isNotNull()).select("term", "key")
    pairs = block_pairs(cut(prefix), ["term"], "key")
    both = pairs.join(rows.select(F.col("key").alias("a"), F.col("t").alias("x")), "a").join(rows.select(F.col("key").alias("b"), F.col("t").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")).filter(F.col("similarity") >= threshold)


def tile_pairs(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray] | None, threshold: float, unsure: np.ndarray, high: int = 256, wide: int = 4096) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, similarity, open): which sets of a and of b are alike to at least `threshold`; without b, each pair of a once.

    Sets come as (codes of their terms one after the other, sizes). A product of matrices counts shared terms by bucket,
    which can only be too many; what passes is counted by codes. `open` tells whether shared codes are among `unsure`, those
    of several terms; then the similarity is one at most."""
    c = threshold / (1 + threshold)  # of the terms of both, so many are shared at least
    codes, flat, often = np.unique(a[0] if b is None else np.concatenate([a[0], b[0]]), return_inverse=True, return_counts=True)
    dense = np.cumsum(often > 1) - 1  # what one set has can't be shared
    dense[often == 1] = -1
    odd = np.isin(codes[often > 1], unsure)
    flat = dense[flat]

    def by_size(flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        kept = np.bincount(np.repeat(np.arange(len(n)), n)[flat >= 0], minlength=len(n))
        flat, order = flat[flat >= 0], np.argsort(n, kind="stable")
        k, first = kept[order], (np.cumsum(kept) - kept)[order]
        return order, n[order], k, np.cumsum(k) - k, flat[np.arange(len(flat)) + np.repeat(first - (np.cumsum(k) - k), k)]

    def counts(flat: np.ndarray, k: np.ndarray, buckets: int) -> np.ndarray:
        at = np.repeat(np.arange(len(k)), k) * buckets + flat % buckets
        return np.bincount(at, minlength=len(k) * buckets).astype(np.float32).reshape(len(k), buckets)

    one = lambda n: np.ones((len(n), 1), np.float32)
    a_own, an, ak, a_at, af = by_size(flat[: len(a[0])], a[1])
    b_own, bn, bk, b_at, bf = (a_own, an, ak, a_at, af) if b is None else by_size(flat[len(a[0]) :], b[1])
    mark = np.zeros((high, max(1, len(odd))), bool)
    for q in range(0, len(bn), wide):
        m, km = bn[q : q + wide], bk[q : q + wide]
        at0 = b_at[q]
        other = bf[at0 : at0 + km.sum()]
        right: dict[int, np.ndarray] = {}
        start, stop = np.searchsorted(an, threshold * m[0] - 1e-9), np.searchsorted(an, m[-1] / threshold + 1e-9, "right")
        for r in range(start, min(stop, q + len(m)) if b is None else stop, high):
            n, kn = an[r : min(r + high, stop)], ak[r : min(r + high, stop)]
            buckets = min(2048, max(128, 1 << int(3 * max(n[-1], m[-1]) - 1).bit_length()))
            if buckets not in right:
                right[buckets] = np.ascontiguousarray(np.hstack([counts(other, km, buckets), -c * one(m), -c * m[:, None].astype(np.float32)]).T)
            own = af[a_at[r] : a_at[r] + kn.sum()]
            left = np.hstack([counts(own, kn, buckets), n[:, None].astype(np.float32), one(n)])
            i, j = np.divmod(np.flatnonzero(left @ right[buckets] >= -0.01), len(m))
            ok = (np.minimum(n[i], m[j]) >= threshold * np.maximum(n[i], m[j]) - 1e-9) & (km[j] > 0)
            if b is None:
                ok &= i + r < j + q
            i, j = i[ok], j[ok]
            if not len(i):
                continue
            rows = np.repeat(np.arange(len(n)), kn)
            mark[rows, own] = True
            for k in range(0, len(i), 1 << 15):
                x, y = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
                size = km[y]
                ends = np.cumsum(size)
                terms = other[np.arange(ends[-1]) + np.repeat(b_at[y + q] - at0 - ends + size, size)]
                met = mark[np.repeat(x, size), terms]
                shared = np.add.reduceat(met, ends - size, dtype=np.int64)
                alike = shared / (n[x] + m[y] - shared)
                hit = alike >= threshold
                check = np.add.reduceat(met & odd[terms], ends - size, dtype=np.int64) > 0 if odd.any() else np.zeros(len(x), bool)
                if hit.any():
                    yield a_own[x[hit] + r], b_own[y[hit] + q], alike[hit], check[hit]
            mark[rows, own] = False


def jaccard_tiles(sets: DataFrame, key: str, terms: str, threshold: float, least: int = 2048, most: int = 65536, bits: int = 32) -> DataFrame:
    """(a, b, similarity): as jaccard_join, for low thresholds and terms that many sets share.

    There, blocks by term meet more often than there are pairs, so all pairs of like sizes are looked at instead, in tiles
    of two groups of sets (of about `least` to `most` sets, by size), at some ten nanoseconds a pair. A set goes to one tile for
    each group, and pairs alone leave a tile. The work grows with the square of the sets, what is written with the sets.
    Terms are compared by codes of `bits` bits; pairs that share a code of several terms are compared by the terms. `sets` is
    read several times: what is dear to make should be cut."""
    spark = sets.sparkSession
    rows = sets.select(F.col(key).alias("key"), F.array_distinct(F.col(terms)).alias("t")).filter(F.col("key").isNotNull() & (F.size("t") > 0))
    code = lambda x: F.shiftright(F.xxhash64(x), 64 - bits).cast("int")
    vocabulary = rows.select(F.explode("t").alias("x")).distinct()
    # of v terms, about v * v / 2 ** (bits + 1) codes stand for several
    unsure = np.array([r[0] for r in vocabulary.groupBy(code(F.col("x"))).count().filter("count > 1").collect()], np.int64).astype(np.int32)
    sizes = rows.groupBy(F.size("t").alias("n")).agg(F.count("*").alias("c")).orderBy("n").collect()  # as many rows as there are sizes
    total = sum(r.c for r in sizes)
    groups = max(1, min(6, total // least), -(-total // most))
    # sets of one size are spread over the groups that it reaches into
    before, place, reach = 0, [], {}
    for r in sizes:
        place.append((r.n, before, r.c))
        for g in range(before * groups // total, (before + r.c - 1) * groups // total + 1):
            reach[g] = (min(reach.get(g, (r.n,))[0], r.n), r.n)
        before += r.c
    tiles = [(g, h) for g in reach for h in reach if g <= h and reach[g][1] >= threshold * reach[h][0] - 1e-9]
    goes = [(x, k, s) for k, (g, h) in enumerate(tiles) for s, x in ((0, g), (1, h)) if s == 0 or g != h]
    group = F.floor((F.col("before") + F.pmod(F.xxhash64("key"), F.col("c"))) * groups / max(1, total)).cast("int")
    placed = rows.select("key", F.size("t").alias("n"), F.transform("t", code).alias("codes"))
    placed = placed.join(F.broadcast(spark.createDataFrame(place, "n int, before long, c long")), "n").withColumn("group", group)
    placed = placed.join(F.broadcast(spark.createDataFrame(goes, "group int, tile int, side int")), "group").select("tile", "side", "key", "codes")
    kind = placed.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (held := list(batches)):
            return
        whole = pa.Table.from_batches(held)
        for tile in whole["tile"].unique().to_pylist():
            keys, parts = [], []
            for side in (0, 1):
                part = whole.filter(pc.and_(pc.equal(whole["tile"], tile), pc.equal(whole["side"], side)))
                lists = part["codes"].combine_chunks()
                keys.append(part["key"].combine_chunks())
                parts.append((pc.list_flatten(lists).to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)))
            alone = tiles[tile][0] == tiles[tile][1]
            for i, j, alike, check in tile_pairs(parts[0], None if alone else parts[1], threshold, unsure):
                yield pa.RecordBatch.from_arrays([keys[0].take(pa.array(i)), keys[0 if alone else 1].take(pa.array(j)), pa.array(alike), pa.array(check)], ["a", "b", "similarity", "open"])

    met = placed.repartitionById(max(1, len(tiles)), F.col("tile")).mapInArrow(run, f"a {kind}, b {kind}, similarity double, open boolean")
    met = cut(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity", "open"))
    sure = met.filter("not open").drop("open")
    if not len(unsure):
        return sure
    pairs = cut(met.filter("open").select("a", "b"))
    x = lookup_join(rows.select(F.col("key").alias("a"), F.col("t").alias("x")), pairs, ["a"])
    y = lookup_join(rows.select(F.col("key").alias("b"), F.col("t").alias("y")), pairs, ["b"])
    shared = F.size(F.array_intersect("x", "y"))
    both = x.join(y, ["a", "b"]).select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity"))
    return sure.unionByName(both.filter(F.col("similarity") >= threshold))

_LETTER = "a-zà-öø-ÿ"
_RUN = re.compile(rf"(?<![A-Za-z0-9_])([A-Z][{_LETTER}]+(?:[ \t]+(?:of|and|&|[A-Z][{_LETTER}]*)){{0,3}})(?![A-Za-z0-9_])")
# Ends of organisations' names, words before a name, capitalised words that are none, words that begin or end
# a heading rather than a name.
_ORGANISATION = re.compile(r"\b(ltd|limited|inc|llc|llp|plc|gmbh|corp|corporation|company|co|group|holdings|partners|labs|technologies|systems|foundation|university|institute)\b\.?$", re.I | re.A)
_LEADING = re.compile(r"^(?:The|A|An|This|That|These|Those|Our|My|Their|Its|Project|Team|Mr|Mrs|Ms|Dr)\s+")
_NO_NAME = frozenset(
    "monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december the this that there we i it they he she but and if when "
    "however all every each some any both no most many few several another other such only also these those".split()
)
_NO_FIRST = frozenset(
    "why what when where how who which whether requires require start starting using use adding add building build running run getting get writing write installing install testing test making make "
    "setting reading read choosing choose status note warning".split()
)
_NO_LAST = frozenset(
    "rules proposal server model project design specification objects structure interpolation resolutions reference guide notes summary overview status roadmap syntax grammar api sdk cli spec docs readme "
    "license changelog support tooling toolchain runtime compiler parser engine memory language version release example examples test tests benchmark benchmarks performance installation usage text editor "
    "studio code console terminal shell kit suite pack packages plugin extension library framework".split()
)
# Countries and cities that a bare name means, and ends of places' names.
COUNTRIES = frozenset(
    "afghanistan,albania,algeria,argentina,armenia,australia,austria,azerbaijan,bahrain,bangladesh,belarus,belgium,bhutan,bolivia,bosnia,botswana,brazil,bulgaria,cambodia,cameroon,canada,chile,china,colombia,"
    "croatia,cuba,cyprus,czechia,denmark,ecuador,egypt,estonia,ethiopia,finland,france,georgia,germany,ghana,greece,guatemala,hungary,iceland,india,indonesia,iran,iraq,ireland,israel,italy,jamaica,japan,jordan,"
    "kazakhstan,kenya,kuwait,kyrgyzstan,laos,latvia,lebanon,libya,lithuania,luxembourg,madagascar,malaysia,maldives,mali,malta,mexico,moldova,mongolia,montenegro,morocco,mozambique,myanmar,namibia,nepal,"
    "netherlands,nicaragua,nigeria,norway,oman,pakistan,panama,paraguay,peru,philippines,poland,portugal,qatar,romania,russia,rwanda,saudi arabia,senegal,serbia,singapore,slovakia,slovenia,somalia,spain,sudan,"
    "sweden,switzerland,syria,taiwan,tajikistan,tanzania,thailand,tunisia,turkey,uganda,ukraine,uruguay,uzbekistan,venezuela,vietnam,yemen,zambia,zimbabwe,south korea,north korea,south africa,new zealand,"
    "sri lanka,united states,united kingdom,united arab emirates,costa rica,dominican republic,papua new guinea,ivory coast,hong kong,usa,uk,uae,us,britain,england,scotland,wales".split(",")
)
CITIES = frozenset(
    "tokyo,delhi,shanghai,dhaka,cairo,mumbai,beijing,osaka,karachi,chongqing,istanbul,buenos aires,kolkata,lagos,manila,guangzhou,bangalore,bengaluru,shenzhen,moscow,jakarta,lahore,seoul,bangkok,chennai,hyderabad,"
    "london,tehran,paris,chicago,toronto,bogota,lima,johannesburg,hanoi,riyadh,santiago,madrid,singapore,sydney,melbourne,berlin,rome,amsterdam,barcelona,vienna,dublin,lisbon,copenhagen,stockholm,oslo,helsinki,"
    "warsaw,prague,budapest,athens,zurich,geneva,munich,hamburg,frankfurt,milan,brussels,dubai,doha,tel aviv,new york,los angeles,san francisco,seattle,boston,austin,denver,atlanta,miami,houston,dallas,"
    "philadelphia,phoenix,washington,vancouver,montreal,ottawa,calgary,auckland,wellington,perth,brisbane,pune,ahmedabad,jaipur,kochi,surat,lucknow,nagpur,indore,chandigarh,noida,gurgaon,gurugram,kathmandu,"
    "colombo,taipei,kyoto,busan".split(",")
)
PLACE_END = r"(?i)\b(street|road|avenue|lane|boulevard|highway|bridge|airport|station|harbour|harbor|port|park|square|plaza|valley|island|beach|bay|river|lake|mountain|county|province|district|city|town|village|campus)\b$"
_PLACE_END = re.compile(PLACE_END, re.A)
# What is named by the phrase around it.
_CUED = (
    ("project", 0.7, re.compile(r"\b(?:[Pp]roject\s+([A-Z][\w-]*)|(?:[Tt]he\s+)?((?![Tt]he\b)[A-Z][\w-]*(?:[ \t](?!migration|project)[A-Z][\w-]*)?)\s+(?:project|migration|rollout|initiative|programme|program|rewrite))\b", re.A)),
    ("product", 0.65, re.compile(r"\b([A-Z][\w.+-]*(?:[ \t][A-Z][\w.+-]*)?)\s+(?:API|SDK|CLI|plugin|extension|library|framework|database|dashboard|service|app|platform|integration)\b", re.A)),
    ("product", 0.75, re.compile(r"\b([A-Z][\w.+-]{2,})\s+(?:v\d+|\d+\.\d+(?:\.\d+)*|\d{2,})\b", re.A)),
    ("place", 0.75, re.compile(rf"\b(?:based\s+in|office\s+in|located\s+in|travel(?:l?ing)?\s+to|flew\s+to|moved\s+to|shipped\s+to|headquartered\s+in)\s+([A-Z][{_LETTER}]+(?:[ \t][A-Z][{_LETTER}]+)?)", re.A)),
)
_FULL, _INITIAL = re.compile(rf"[A-Z][{_LETTER}]+\Z"), re.compile(r"[A-Z]\.?\Z")
_ADDRESS = [re.compile(p) for p in (r"(?s)```.*?```", r"`[^`]*`", r"(?i)\bhttps?://\S+", r"%\w+%[\\/][^\s\"']*", r"\b[A-Za-z]:\\[^\s\"']*", r"\.{0,2}[\\/][\w.-]+(?:[\\/][\w.-]+)+")]


def known_place(name: Column) -> Column:
    """Whether a bare name is that of a country, a city or ends like a place's name."""
    low = F.regexp_replace(F.lower(F.trim(name)), r"^the\s+", "")
    return low.isin(*sorted(COUNTRIES | CITIES)) | F.trim(name).rlike(PLACE_END)


def is_place(name: str) -> bool:
    low = re.sub(r"^the\s+", "", name.strip().lower())
    return low in COUNTRIES or low in CITIES or bool(_PLACE_END.search(name.strip()))


def is_person(name: str) -> bool:
    """Two or three capitalised words or initials, at least two of them words, that don't begin or end like a heading."""
    words = re.split(r"[ \t]+", name)
    if not 2 <= len(words) <= 3 or re.search(r"&|\b(?:and|of|the|for|with|in|on)\b", name, re.I):
        return False
    if words[0].lower() in _NO_FIRST or words[-1].lower() in _NO_LAST:
        return False
    return all(_FULL.match(w) or _INITIAL.match(w) for w in words) and sum(bool(_FULL.match(w)) for w in words) >= 2


def tidy_name(name: str) -> str:
    """A name without leading articles and connectives at its end; empty for what is no name."""
    out = name.strip()
    while (shorter := _LEADING.sub("", out)) != out:
        out = shorter
    words = re.split(r"[ \t]+", out)
    while words and words[-1] in ("of", "and", "&"):
        words.pop()
    out = " ".join(words)
    return "" if not words or words[0].lower() in _NO_NAME or len(out) < 2 else out


def name_runs(text: str | None) -> list[dict]:
    """Named things of a text: by the phrase around them, then capitalised runs of up to four words.

    Single words that begin a sentence prove nothing; a run is an organisation by its end, a place by name or end, or has
    the shape of a person's name, else it is left out. Code, links and paths are no text. Of one name the most certain
    reading counts, at its first place."""
    found: dict[str, dict] = {}
    body = text or ""
    for pattern in _ADDRESS:
        body = pattern.sub(" ", body)

    def keep(name: str, kind: str, sure: float, at: int) -> None:
        old = found.get(T.py_fold(name))
        if old is None or sure > old["confidence"]:
            found[T.py_fold(name)] = {"text": name, "type": kind, "confidence": sure, "offset": min(at, old["offset"]) if old else at}

    for kind, sure, pattern in _CUED:
        for m in pattern.finditer(body):
            if name := tidy_name(next((g for g in m.groups() if g), "")):
                keep(name, kind, sure, m.start())
    for m in _RUN.finditer(body):
        if not (name := tidy_name(m[1])):
            continue
        before = body[max(0, m.start() - 12) : m.start()]
        if " " not in name and (m.start() == 0 or re.search(r"(?:^|[.!?:;]|\n)\s*$", before)):
            continue
        kind = "organisation" if _ORGANISATION.search(name) else "place" if is_place(name) else "name" if is_person(name) else None
        if kind:
            keep(name, kind, 0.65 if " " in name else 0.35, m.start())
    return sorted(found.values(), key=lambda s: s["offset"])


def extract_names(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, type, confidence, offset) of the named things in texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, s["text"], s["type"], s["confidence"], s["offset"]) for k, t in zip(frame["key"], frame["body"]) for s in name_runs(t)]
            yield pd.DataFrame(rows, columns=["key", "text", "type", "confidence", "offset"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("body")).mapInPandas(run, f"key {kind}, text string, type string, confidence double, offset int")
