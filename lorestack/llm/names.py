"""Variant spellings of names typed by people.

Method: names are parsed to tokens without titles, accents, punctuation and forms of business; blocked by the phonetic
codes of their sorted tokens, everyday forms put for given names, and, so that no pair that the comparison accepts is
lost, by all that slips can leave of a token; compared with Jaro-Winkler and a table of everyday forms; accepted pairs are
clustered by connected components. Names that say less than a full name (an initial, a login, an acronym) don't join
clusters to each other: they are attached in a second step, and only where exactly one cluster of the workspace fits best.

Scale: equal names of a workspace are one class before anything is compared, so a name typed a million times is one row.
No token is left out for being common: blocks by slips are narrowed by the other tokens where they are large, and large
blocks are split into cells. What is broadcast is the table of everyday forms, given and learned.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestack.operators.blocks import block_pairs
from lorestack.operators.components import connected_components
from lorestack.session import cut
from lorestack.sources.tables import current_rows, kind_key, table

#: When two given names are taken for forms of one.
FORM_CASES, FORM_SHARE, MOST_FORMS = 3, 0.4, 1_000_000
#: A token that is a family name in more than this share of all two-word names is a given name written last.
COMMON_SHARE = 0.002

#: A block by slips of more people than this is narrowed by what their other tokens can have in common.
SLIP_BLOCK = 16

# Fixed values.
TITLES = {"mr", "mrs", "ms", "miss", "dr", "prof", "sir", "madam", "herr", "frau", "mx"}
LEGAL = {
    "inc": "i", "incorporated": "i", "corp": "c", "corporation": "c", "co": "c", "company": "c", "ltd": "l", "limited": "l",
    "llc": "l", "gmbh": "g", "plc": "p", "ag": "a", "sa": "s", "bv": "b", "oy": "o", "ab": "a", "llp": "l", "kg": "k",
}
TRADES = (
    "analytics", "associates", "brothers", "consulting", "cooperative", "dental", "energy", "engineering", "foods", "foundation", "freight",
    "group", "holdings", "industries", "institute", "insurance", "international", "laboratories", "logistics", "manufacturing", "marine",
    "media", "optics", "partners", "pharmaceuticals", "publishing", "research", "robotics", "security", "services", "solutions", "systems",
    "technologies", "textiles", "trading", "works",
)
SHORT = {
    "assoc": "associates", "assocs": "associates", "bros": "brothers", "consult": "consulting", "coop": "cooperative", "eng": "engineering",
    "engr": "engineering", "fdn": "foundation", "found": "foundation", "grp": "group", "ind": "industries", "inst": "institute", "ins": "insurance",
    "intl": "international", "labs": "laboratories", "lab": "laboratories", "log": "logistics", "mfg": "manufacturing", "pharma": "pharmaceuticals",
    "ptnrs": "partners", "pub": "publishing", "publ": "publishing", "res": "research", "sec": "security", "svcs": "services", "svc": "services",
    "sys": "systems", "tech": "technologies", "technology": "technologies", "laboratory": "laboratories",
}
EVERYDAY = {
    "alex": "alexander", "bill": "william", "will": "william", "billy": "william", "bob": "robert", "vicky": "victoria", "tori": "victoria",
    "chuck": "charles", "harry": "harold", "hal": "harold", "sue": "susanna", "jo": "josephine", "ben": "benedikt", "nacho": "ignacio",
    "max": "maximilian", "tom": "thomas", "jim": "james", "jack": "john", "maria": "mariana", "lina": "linnea", "bella": "isabella",
}
PLACES = re.compile(r"\b(phase|room|model)\s+\d+$", re.I)

_END = sorted([*TRADES, *SHORT, *LEGAL], key=len, reverse=True)


def plain(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKD", text.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("ł", "l").replace("æ", "ae"))
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def word_tokens(title: str) -> list[str]:
    """Lower-case tokens without accents, remarks in brackets and titles; dotted letters are one token."""
    text = re.sub(r"\(.*?\)|\[.*?\]", " ", plain(title))
    text = re.sub(r"\bco-op\b", "coop", text)
    text = re.sub(r"(?<![a-z])((?:[a-z]\.){2,})", lambda m: m.group(1).replace(".", "") + " ", text)
    tokens = re.findall(r"[a-z0-9]+", re.sub(r"['’`]", "", text))
    while len(tokens) > 1 and tokens[0] in TITLES:
        tokens = tokens[1:]
    return [t for t in tokens if t not in TITLES] or tokens


def unglue(token: str) -> list[str]:
    """A name written as one word, cut before the trades and forms of business that it ends in."""
    tail: list[str] = []
    while True:
        for end in _END:
            if token.endswith(end) and len(token) - len(end) >= 4 and (len(end) > 3 or tail or end in ("mfg", "fdn", "grp", "sys", "log")):
                token, tail = token[: -len(end)], [end, *tail]
                break
        else:
            return [token, *tail]


def near_trade(token: str) -> str | None:
    """The trade that a token means: itself, its short form, or it with one slip."""
    if token in SHORT:
        return SHORT[token]
    if token in TRADES:
        return token
    if len(token) >= 5:
        for trade in TRADES:
            if abs(len(trade) - len(token)) <= 1 and slips(token, trade, 1) <= 1:
                return trade
    return None


def edits(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of two numbers."""
    if not a:
        return len(b)
    peq: dict[str, int] = {}
    for i, c in enumerate(a):
        peq[c] = peq.get(c, 0) | 1 << i
    mask, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = mask, 0, len(a)
    for c in b:
        eq = peq.get(c, 0)
        flat = ((eq & up) + up ^ up) | eq | down
        right, left = down | ~(flat | up) & mask, up & flat
        score += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(flat | right)) & mask, right & flat & mask
    return score


def slips(a: str, b: str, most: int) -> int:
    """Edit distance with swaps of neighbours; stops above `most`."""
    if abs(len(a) - len(b)) > most or len(a) > 16 and edits(a, b) > 2 * most:  # a swap is two edits
        return most + 1
    two: list[int] = []
    one = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used = [False] * len(b)
    first = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                first.append(x)
                break
    if not first:
        return 0.0
    second = [y for y, u in zip(b, used) if u]
    m, swapped = len(first), sum(x != y for x, y in zip(first, second)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


_SOUND = {c: str(i) for i, group in enumerate(("bfpvw", "cgjkqsxz", "dt", "l", "mn", "r"), 1) for c in group}


def phonetic(word: str) -> str:
    """First letter and sounds of the consonants, repeats once."""
    codes = [_SOUND.get(c, "") for c in word]
    out = word[:1]
    for before, code in zip(codes, codes[1:]):
        if code and code != before:
            out += code
    return out


def sound_keys(token: str) -> list[str]:
    """Codes of both ends of a token: one slip leaves one of them as it was, unless the ends overlap (up to 13 letters)."""
    return ["h" + phonetic(token[:7]), "t" + phonetic(token[::-1][:7])]


def without(token: str, most: int) -> set[str]:
    """The token and what is left of it without up to `most` letters: tokens that many slips apart have one in common."""
    out = last = {token}
    for _ in range(most):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        out = out | last
    return out


def slip_keys(token: str) -> list[str]:
    """Two tokens that family_alike accepts have one of these in common."""
    return sorted(without(token, 0 if len(token) < 5 else 1 if len(token) < 9 else 2))


def given_keys(token: str, everyday: dict[str, set[str]]) -> set[str]:
    """Two tokens that given_alike accepts have one of these in common."""
    out = {"=" + t for t in everyday.get(token, {token})} | {"~" + t for t in (without(token, 1) if len(token) >= 4 else ())}
    return out | ({"<" + token[:3]} if len(token) >= 3 else set()) | ({">" + token[-4:]} if len(token) >= 4 else set())


def parse_person(tokens: list[str]) -> tuple[str, str, str]:
    """(form, tokens in order, middle initials) of a person's name."""
    words, initials = [t for t in tokens if len(t) > 1], [t for t in tokens if len(t) == 1]
    if len(words) >= 2:
        return "person", " ".join(words), "".join(sorted(initials))
    if len(words) == 1 and initials:
        return "initial", words[0], initials[0]
    if len(words) == 1:
        return "login", words[0], ""
    return "none", "", ""


def parse_name(title: str | None, kind: str | None) -> list[tuple[str, str, str, str]]:
    """Readings (form, name, other, legal) of a title whose entity type is `kind` (null: unknown).

    Forms: person (name: tokens), initial (family name, initial), login (one word), firm (distinctive words; other:
    trades), acronym (letters). Nothing for projects, products, places, blank titles and other types.
    """
    kind = (kind or "").strip().lower()
    if kind in ("organization", "company", "org"):
        kind = "organisation"
    if not title or not title.strip() or kind not in ("", "person", "organisation") or PLACES.search(title.strip()):
        return []
    tokens = word_tokens(title)
    if not tokens:
        return []
    if tokens[0] == "the" and len(tokens) > 1:
        tokens, kind = tokens[1:], kind or "organisation"
    out = []
    firm = tokens
    if len(tokens) == 1:
        squeezed = re.sub(r"[^A-Za-z]", "", title)
        if kind != "person" and 2 <= len(tokens[0]) <= 6 and squeezed.isupper():
            return [("acronym", tokens[0], "", "")]
        firm = unglue(tokens[0])
    trades = [near_trade(t) for t in firm]
    legal = "".join(LEGAL[t] for t in firm if t in LEGAL)
    if kind != "person" and (kind == "organisation" or any(trades) or legal):
        own = [t for t, trade in zip(firm, trades) if not trade and t not in LEGAL and t != "and"]
        order = "".join((trade or t)[0] for t, trade in zip(firm, trades) if t not in LEGAL and t != "and")
        if own:
            comma = "," in title and not re.search(r",\s*\S+\s*$", title) is None and trades[0] is not None
            letters = order if not comma else "".join(t[0] for t in own) + "".join(t[0] for t in filter(None, trades))
            out.append(("firm", " ".join(own), " ".join(sorted(filter(None, trades))), letters + "|" + legal))
    if kind != "organisation" and not any(trades) and not legal:
        out.append((*parse_person(tokens), ""))
    return [x for x in out if x[0] != "none"]


def sorted_codes(tokens: list[str], everyday: dict[str, set[str]]) -> list[str]:
    """Phonetic codes of a name's sorted tokens; a token with everyday forms also by each of these."""
    forms = [sorted(everyday.get(t, {t})) for t in tokens]
    own = ["|".join(sorted(map(phonetic, tokens)))]
    for i, x in enumerate(forms):
        own += ["|".join(sorted(phonetic(f if k == i else t) for k, t in enumerate(tokens))) for f in x]
    return own


def keys_of(form: str, name: str, other: str, legal: str, everyday: dict[str, set[str]]) -> list[str]:
    """The blocks of a reading. Two readings that compare accepts have one in common, but for two full names of people, whose
    other blocks are slip_blocks."""
    tokens = name.split()
    if form == "person":
        out = {"P" + k for k in sorted_codes(tokens, everyday)} | {"c" + tokens[0] + tokens[-1], "c" + tokens[-1] + tokens[0]}
        for i, j in ((-1, 0), (0, -1)):
            out.update(f"i{tokens[j][0]}{k}" for k in slip_keys(tokens[i]))
        return sorted(out)
    if form == "initial":
        return [f"i{other}{k}" for k in slip_keys(name)]
    if form == "login":
        return sorted({f"i{name[0]}{k}" for k in slip_keys(name[1:])} | {"c" + name} | {"g" + k for k in slip_keys(name)})
    if form == "firm":
        letters, _, ends = legal.partition("|")
        out = {"f" + k for t in tokens for k in sound_keys(t)} | {"F" + "|".join(sorted(map(phonetic, tokens)))} | {"=" + "".join(tokens)}
        return sorted(out | {"s" + k for t in tokens for k in slip_keys(t)} | {"a" + letters, "a" + letters + ends[:1]})
    return ["a" + name]


def given_alike(a: str, b: str, everyday: dict[str, set[str]]) -> float:
    """How well two given names agree: equal, everyday form, cut short, or one slip."""
    if a == b:
        return 1.0
    if everyday.get(a, {a}) & everyday.get(b, {b}):
        return 0.98
    short, long = sorted((a, b), key=len)
    if len(short) >= 3 and (long.startswith(short) or len(short) >= 4 and long.endswith(short)):
        return 0.95
    if min(len(a), len(b)) >= 4 and slips(a, b, 1) <= 1 and jaro_winkler(a, b) >= 0.85:
        return 0.93
    return 0.0


def family_alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if min(len(a), len(b)) >= 5 and slips(a, b, 2) <= (2 if min(len(a), len(b)) >= 9 else 1):
        return jaro_winkler(a, b) if jaro_winkler(a, b) >= 0.9 else 0.0
    return 0.0


def same_person(a: str, b: str, mid_a: str, mid_b: str, everyday: dict[str, set[str]]) -> float:
    """Agreement of two full names in any order of their parts; 0 if they differ."""
    if mid_a and mid_b and not set(mid_a) & set(mid_b):
        return 0.0
    x, y = a.split(), b.split()
    if len(x) != len(y):
        x, y = (x, y) if len(x) < len(y) else (y, x)
        if len(x) < 2:
            return 0.0
        y = [y[0], y[-1]] if len(x) == 2 else y[: len(x)]
    best = 0.0
    for z in (y, y[::-1]):
        for given, family in ((0, -1), (-1, 0)):
            g, f = given_alike(x[given], z[given], everyday), family_alike(x[family], z[family])
            inner = all(p == q for p, q in zip(x[1:-1], z[1:-1])) if len(x) > 2 else True
            if g and f and inner and (g == 1.0 or f >= 0.94 or g >= 0.95):
                best = max(best, min(g, f))
    return best


def compare(a: tuple, b: tuple, everyday: dict[str, set[str]]) -> tuple[str, float]:
    """('same' or 'fits', score) of two readings (form, name, other, legal); score 0: different."""
    if a[0] > b[0]:
        a, b = b, a
    forms = (a[0], b[0])
    if forms == ("person", "person"):
        return "same", same_person(a[1], b[1], a[2], b[2], everyday)
    if forms == ("firm", "firm"):
        if a[2] != b[2]:
            return "same", 0.0
        if a[1].replace(" ", "") == b[1].replace(" ", ""):
            return "same", 1.0
        x, y = sorted(a[1].split()), sorted(b[1].split())
        if len(x) != len(y):
            return "same", 0.0
        scores = [family_alike(p, q) for p, q in zip(x, y)]
        return "same", min(scores) if a[2] or len(x) > 1 else (min(scores) if min(scores) == 1 else 0.0)
    if forms == ("acronym", "firm"):
        letters, _, ends = b[3].partition("|")
        return "fits", 1.0 if ends and a[1] == letters + ends[0] else 0.9 if a[1] == letters else 0.0
    if forms == ("acronym", "acronym"):
        return "same", 1.0 if a[1] == b[1] else 0.0
    if forms == ("initial", "person") or forms == ("login", "person"):
        tokens = b[1].split()
        if forms[0] == "initial":
            family, first = a[1], a[2]
        else:
            family, first = a[1][1:], a[1][:1]
            if a[1] in (tokens[0] + tokens[-1], tokens[-1] + tokens[0]):
                return "fits", 1.0
        scores = [family_alike(family, tokens[i]) for i, j in ((-1, 0), (0, -1)) if tokens[j].startswith(first)]
        return "fits", max(scores, default=0.0)
    if forms == ("initial", "initial"):
        return "weak", family_alike(a[1], b[1]) if a[2] == b[2] else 0.0
    if forms == ("initial", "login"):
        return "weak", family_alike(a[1], b[1][1:]) if a[2] == b[1][:1] else 0.0
    if forms == ("login", "login"):
        return "weak", family_alike(a[1], b[1])
    return "same", 0.0


def everyday_forms(rows: list[tuple[str | None, str | None]]) -> dict[str, set[str]]:
    """Given name -> all formal names it may stand for, itself included."""
    out: dict[str, set[str]] = {}
    for formal, short in [*rows, *((f, s) for s, f in EVERYDAY.items())]:
        if formal and short:
            f, s = plain(formal), plain(short)
            out.setdefault(s, {s}).add(f)
            out.setdefault(f, {f})
    return out


def link_names(entities: DataFrame, forms: DataFrame) -> DataFrame:
    """(id, cluster): the entities that name the same person or organisation as another one of their workspace.

    `entities` has id, workspace_id, title and entity_type; `forms` has formal_name and short_name. cluster is the lowest
    class of the cluster's full names, or of all its names if none is full. Entities alone, with null or blank titles, null
    workspaces or other types are left out. Equal titles are linked whatever their number. A name that fits several
    clusters equally well is linked to none.
    """
    spark = entities.sparkSession
    everyday = everyday_forms([tuple(r) for r in forms.select("formal_name", "short_name").distinct().collect()])  # a table of fixed size

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(i, w, *reading) for i, w, t, k in zip(frame["id"], frame["workspace_id"], frame["title"], frame["entity_type"]) for reading in parse_name(t, k)]
            yield pd.DataFrame(rows, columns=["id", "ws", "form", "name", "other", "legal"])

    wanted = entities.filter("workspace_id is not null and title is not null").select("id", "workspace_id", "title", "entity_type")
    readings = cut(wanted.mapInPandas(read, "id string, ws string, form string, name string, other string, legal string"))
    label = F.concat_ws("\x1f", "ws", "form", "name", "other", "legal")
    readings = readings.withColumn("class", label)
    classes = readings.select("ws", "form", "name", "other", "legal", "class").distinct()
    people = classes.filter("form = 'person'")
    everyday = learn_forms(people, everyday)

    @F.pandas_udf("array<string>")
    def blocks(form: pd.Series, name: pd.Series, other: pd.Series, legal: pd.Series) -> pd.Series:
        return pd.Series([keys_of(*x, everyday) for x in zip(form, name, other, legal)])

    blocked = classes.withColumn("key", F.explode(blocks("form", "name", "other", "legal"))).select("ws", "key", "class")
    pairs = block_pairs(cut(blocked.union(slip_blocks(people, everyday))), ["ws", "key"], "class")

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, b in zip(frame["a"], frame["b"]):
                x, y = a.split("\x1f")[1:], b.split("\x1f")[1:]
                how, score = compare(tuple(x), tuple(y), everyday)
                if score > 0:
                    if how == "fits" and x[0] in ("person", "firm"):
                        a, b = b, a
                    rows.append((a, b, how, score))
            yield pd.DataFrame(rows, columns=["a", "b", "how", "score"])

    judged = cut(pairs.select("a", "b").mapInPandas(judge, "a string, b string, how string, score double"))
    # Names that say less have no edge 'same'. Those that fit a full name are attached to it, the others meet only each other: the
    # components of both kinds of names have no name in common, and one pass finds them. Each step is cut, as the next reads it
    # several times: plans that hold one another are what fills the driver.
    fits = judged.filter("how = 'fits'").select("a", "b", "score")
    weak = judged.filter("how = 'weak'").join(fits.select("a").distinct(), "a", "left_anti").join(fits.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    edges = cut(judged.filter("how = 'same'").select("a", "b").union(weak.select("a", "b")))
    components = cut(connected_components(edges, "a", "b").select(F.col("node").alias("class"), F.col("component").alias("cluster")))
    # attached where one cluster fits best; the fit of a cluster is that of its best member
    fits = fits.join(components.withColumnRenamed("class", "b"), "b", "left").groupBy("a", F.coalesce("cluster", "b").alias("cluster")).agg(F.max("score").alias("score"))
    level = fits.groupBy("a", "score").agg(F.count("*").alias("n"), F.min("cluster").alias("cluster"))
    best = level.groupBy("a").agg(F.max(F.struct("score", "n", "cluster")).alias("best"))
    attached = best.filter("best.n = 1").select(F.col("a").alias("class"), F.col("best.cluster").alias("cluster"))
    # equal titles link through their class; an entity with two readings is in the clusters of both
    nodes = readings.select("id", "class").join(components.union(attached), "class", "left")
    named = cut(nodes.select("id", F.coalesce("cluster", "class").alias("cluster")).distinct())
    sizes = named.groupBy("cluster").agg(F.count("*").alias("_n")).filter("_n > 1")
    return named.join(sizes, "cluster").select("id", "cluster")


def slip_blocks(people: DataFrame, everyday: dict[str, set[str]]) -> DataFrame:
    """(ws, key, class) in which any two people (ws, name, class) that same_person accepts meet, however common their tokens."""

    @F.pandas_udf("array<string>")
    def slipped(token: pd.Series) -> pd.Series:
        return token.map(slip_keys)

    @F.pandas_udf("array<string>")
    def narrowed(key: pd.Series, name: pd.Series, at: pd.Series, n: pd.Series) -> pd.Series:
        def keys(k: str, x: str, i: int, size: int) -> list[str]:
            if size <= SLIP_BLOCK:
                return ["s" + k]
            return sorted({f"s{k}{g}" for j, t in enumerate(x.split()) if j != i for g in given_keys(t, everyday)})

        return pd.Series([keys(*x) for x in zip(key, name, at, n)])

    tokens = people.select("ws", "class", F.posexplode(F.split("name", " ")).alias("at", "token"))
    keyed = tokens.select("ws", "class", "at", F.explode(slipped("token")).alias("key"))
    sized = keyed.withColumn("n", F.count("*").over(Window.partitionBy("ws", "key"))).filter("n > 1")
    name = F.split("class", "\x1f")[2]
    return sized.select("ws", F.explode(narrowed("key", name, "at", "n")).alias("key"), "class")


def learn_forms(people: DataFrame, everyday: dict[str, set[str]]) -> dict[str, set[str]]:
    """The everyday forms and those that the names themselves show: the table is incomplete.

    A given name that stands beside one other given name, before the same family name in the same workspace, in at least
    FORM_SHARE of the cases where it stands beside any, and FORM_CASES times, is a form of it. Relatives share a family
    name too, but with given names of all kinds. A token that stands last in more than COMMON_SHARE of the names is a
    given name written last. Given names of one family name meet in cells, so a family name of a whole workspace is no
    hot key. What is collected is at most 1 / FORM_SHARE forms for each given name that is so often seen: a vocabulary of
    given names, far smaller than the names; it is refused beyond MOST_FORMS rather than cut.
    """
    two = people.filter(F.size(F.split("name", " ")) == 2).select("ws", F.split("name", " ").alias("p"))
    way = lambda g, f: F.struct(F.col("p")[g].alias("given"), F.col("p")[f].alias("family"))
    sides = cut(two.select("ws", F.explode(F.array(way(0, 1), way(1, 0))).alias("s")).select("ws", "s.*").filter(F.length("family") >= 5).distinct())
    spread = sides.groupBy("family").agg(F.count("*").alias("c"))
    total = two.count()
    given = spread.filter((F.col("c") > 5) & (F.col("c") > COMMON_SHARE * total)).select("family")
    pairs = block_pairs(cut(sides.join(given, "family", "left_anti")), ["ws", "family"], "given", pairs_per_block=True)
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    counts = both.groupBy("a", "b").agg(F.count("*").alias("n"))
    total_of = counts.groupBy("a").agg(F.sum("n").alias("total"))
    often = (F.col("n") >= FORM_CASES) & (F.col("n") >= FORM_SHARE * F.col("total"))
    found = counts.join(total_of, "a").filter(often | (F.col("n") == 2) & (F.col("total") == 2)).select("a", "b").limit(MOST_FORMS + 1).collect()
    if len(found) > MOST_FORMS:
        raise RuntimeError(f"more than {MOST_FORMS} forms of given names were learned")
    out = {k: set(v) for k, v in everyday.items()}
    for r in sorted(found):
        if r.a not in out.get(r.b, ()):
            out.setdefault(r.a, {r.a}).update(out.get(r.b, {r.b}) | {r.b})
            out.setdefault(r.b, {r.b})
    return out


def store_entities(spark: SparkSession, folder: str) -> DataFrame:
    rows = current_rows(table(spark, folder, "knowledge_object"), "workspace_id", "kind", "title", "attrs")
    return rows.filter(kind_key() == "entity").select("id", "workspace_id", "title", F.get_json_object("attrs", "$.entityType").alias("entity_type"))


def store_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return link_names(store_entities(spark, folder), table(spark, folder, "name_form"))


def p4_clusters(spark: SparkSession, folder: str) -> DataFrame:
    """One row per linked entity: its cluster and the number of entities in it."""
    members = store_clusters(spark, folder)
    sizes = members.groupBy("cluster").agg(F.min("id").alias("first_id"), F.count("*").alias("members"))
    return members.join(sizes, "cluster").select("id", "first_id", "members")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """All pairs of each cluster, as the task lists them."""
    pairs = block_pairs(store_clusters(spark, folder), ["cluster"], "id")
    return pairs.select(F.col("a").alias("id_a"), F.col("b").alias("id_b"))


QUERIES = {"p4_found": p4_found, "p4_clusters": p4_clusters}
SQL: dict[str, str] = {}
