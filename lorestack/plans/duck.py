"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

# Fixed values, written out apart from those of the engine.
ACCENTED = "àáâãäåāçćčèéêëēěìíîïīñńňòóôõöōùúûüūýÿžźżšśřťďÀÁÂÃÄÅĀÇĆČÈÉÊËĒĚÌÍÎÏĪÑŃŇÒÓÔÕÖŌÙÚÛÜŪÝŽŹŻŠŚŘŤĎ０１２３４５６７８９²³"
FOLDED = "aaaaaaaccceeeeeeiiiiinnnoooooouuuuuyyzzzssrtdAAAAAAACCCEEEEEEIIIIINNNOOOOOOUUUUUYZZZSSRTD012345678923"
VOICED = "がぎぐげござじずぜぞだぢづでどばびぶべぼヴガギグゲゴザジズゼゾダヂヅデドバビブベボ"
BASES = "かきくけこさしすせそたちつてとはひふへほウカキクケコサシスセソタチツテトハヒフヘホ"
STOPWORDS = (
    "a an the and or but if then else of in on at to for from by with without about as is are was were be been being do does did doing have has had having i me my we our you your he she it they them "
    "this that these those there here what which who whom when where why how not no nor so than too very can will just should now also into over under again further once because therefore however "
    "although while whereas since thus hence moreover furthermore their its his her our us am being would could might must shall may such more most many much some any all both each every other another "
    "same one two three first second next last new old own via per upon within"
).split()
WHOLE_WORDS = "this has was does goes yes gas bus plus less press class cross series species news analysis basis status focus process access address thing string ring king during being spring".split()

HEAD = "head AS (SELECT DISTINCT ON (id) * FROM knowledge_object ORDER BY id, head_version DESC, ingested_at)"
EDGE = "edge AS (SELECT DISTINCT ON (id) * FROM relation ORDER BY id, ingested_at)"
EVID = "evid AS (SELECT DISTINCT ON (id) * FROM evidence ORDER BY id, ingested_at)"
RUNS = "runs AS (SELECT DISTINCT ON (id) * FROM capability_run ORDER BY id, ingested_at)"


def fold(x: str) -> str:
    """For the characters of the test data; marks of kana become blanks, as every splitter ends there."""
    return f"lower(translate(regexp_replace(replace(replace(regexp_replace({x}, '[\\x{{0300}}-\\x{{036F}}]', '', 'g'), 'ﬁ', 'fi'), '…', '...'), '([{VOICED}])', '\\1 ', 'g'), '{ACCENTED}{VOICED}', '{FOLDED}{BASES}'))"


def tokens(x: str) -> str:
    return rf"[t for t in [regexp_replace(p, '^[._-]+|[._-]+$', '', 'g') for p in regexp_split_to_array({fold(f"coalesce({x}, '')")}, '[^\p{{L}}\p{{N}}._-]+')] if length(t) > 0 and length(t) < 64]"


def words(x: str) -> str:
    return rf"[t for t in regexp_split_to_array({fold(f"coalesce({x}, '')")}, '[^\p{{L}}\p{{N}}]+') if length(t) > 0]"


def content(x: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOPWORDS)
    return rf"[c for c in {tokens(x)} if length(c) > 1 and c not in ({stop}) and not regexp_full_match(c, '\d{{1,3}}')]"


def stem(t: str) -> str:
    """For a column or a lambda's variable."""
    whole = ", ".join(f"'{w}'" for w in WHOLE_WORDS)
    cut = lambda n: f"left({t}, length({t}) - {n})"
    # RE2 has no back references: doubled letters are spelled out
    doubled = "(" + "|".join(c * 2 for c in "bdfglmnprt") + ")$"
    undouble = lambda x: f"CASE WHEN regexp_matches({x}, '{doubled}') THEN left({x}, length({x}) - 1) ELSE {x} END"
    stripped = (
        f"CASE WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {cut(3)} || 'y' WHEN {t} LIKE '%sses' THEN {cut(2)} WHEN regexp_matches({t}, '(ss|us|is)$') THEN {t}"
        f" WHEN length({t}) > 4 AND regexp_matches({t}, '(ch|sh|x|z|s)es$') THEN {cut(2)} WHEN {t} LIKE '%s' THEN {cut(1)}"
        f" WHEN {t} LIKE '%ing' AND length({t}) > 5 THEN {undouble(cut(3))} WHEN {t} LIKE '%ed' AND {t} NOT LIKE '%eed' AND length({t}) > 4 THEN {undouble(cut(2))} ELSE {t} END"
    )
    return f"CASE WHEN length({t}) < 4 OR {t} IN ({whole}) THEN {t} WHEN length({stripped}) > 3 AND ({stripped}) LIKE '%e' THEN left({stripped}, length({stripped}) - 1) ELSE {stripped} END"


def canonical(x: str) -> str:
    bare = rf"regexp_replace({fold(x)}, '^\s*(mr|mrs|ms|dr|prof|sir)\.?\s+', '')"
    return rf"trim(regexp_replace(regexp_replace({bare}, '[.,''\"()\[\]]', '', 'g'), '\s+', ' ', 'g'))"


def estimate(x: str) -> str:
    return rf"CAST(greatest(ceil(length({x}) / 4.0), ceil(len([w for w in regexp_split_to_array({x}, '\s+') if length(w) > 0]) * 1.3)) AS BIGINT)"


#: Without look-around: what stands before an abbreviation is put back, twice, as matches can't overlap.
def sentences(x: str) -> str:
    """DuckDB list of the sentences of x."""
    space = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
    y = f"coalesce({x}, '')"
    for pattern, to in (
        (r"(?i)\b(Mr|Mrs|Ms|Dr|Prof|Sr|Jr|St|vs|etc|approx|no|fig|vol|ch)\.", r"\1' || chr(1) || '"),
        (r"(?i)\b(e)\.(g\.)", r"\1' || chr(1) || '\2"), (r"(?i)\b(i)\.(e\.)", r"\1' || chr(1) || '\2"), (r"\b([A-Z])\.", r"\1' || chr(1) || '"),
        (rf"([.!?]){space}+([A-Z0-9\"''\[(])", r"\1' || chr(2) || '\2"), (r"\n{2,}", "' || chr(2) || '"),
    ):
        y = f"regexp_replace({y}, '{pattern}', '{to}', 'g')"
    return f"[s for s in [regexp_replace(replace(p, chr(1), '.'), '^{space}+|{space}+$', '', 'g') for p in string_split({y}, chr(2))] if length(s) > 0]"


def structured(x: str) -> str:
    return (
        rf"(len(regexp_extract_all({x}, '\|')) >= 3 OR len(regexp_extract_all({x}, '[\w\]\"'']\s*=\s*[\[{{\"''\w]')) >= 2 OR regexp_matches({x}, '\|\s*-{{3,}}|<!--|-->|^\s*(//|--|#!)|={{5,}}|-{{5,}}|\b(require|function|const|local|import)\s*[({{]')"
        rf" OR (length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace({x}, '[^=<>{{}}\[\]|;:\\/\"''`_*#+]', '', 'g')) > length(regexp_replace({x}, '[^A-Za-z]', '', 'g')) * 0.35))"
    )
