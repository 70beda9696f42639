"""Splitting oversized items at natural boundaries.

Method: a text is handled in ranges. The worker of a range sees a halo of the text before it, so it and the worker of
the range before agree on the cut nearest to their border without talking to each other. It detects paragraph, line and
sentence ends in its range, cuts between the two agreed borders and emits pieces with their offsets. Piece numbers are
stitched by a prefix sum over the piece counts of the ranges. A file is read by byte ranges in the same way: no worker
ever holds more than a range of it.

Scale: items under the limit never leave the scan; the others are shuffled once, to keep one delivery of each. Texts of
one range are cut where they are read; longer ones are laid out in windows in one linear pass, spread over as many tasks
as they have ranges, and cut once. Nothing is broadcast or collected but the number of files.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorestack.session import cut, shared_dir
from lorestack.sources.tables import current_wide, table

LIMIT, OVERLAP = 2000, 200
#: Characters of a text that one worker handles at once; of a file, bytes.
RANGE, FILE_RANGE = 1 << 13, 1 << 20
#: Characters after a border that decide whether a boundary is there.
LOOK = 8

_PARAGRAPH = re.compile(r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+")
_LINE = re.compile(r"\r\n|\r|\n")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*(?=\s|$)|[。！？｡]+[」』）”’]*|[।॥]")
#: Words whose full stop ends no sentence.
_ABBREVIATION = re.compile(r"(?:^|[\s(])(?:Mr|Mrs|Ms|Dr|Prof|St|Art|No|Nr|vs|etc|e\.g|i\.e|cf|approx|[A-Z])\.$")
_SPACE = re.compile(r"\s+")


@dataclass
class Boundaries:
    """Sorted cut positions of a text by level; a position p cuts between p - 1 and p."""

    paragraph: list[int]
    line: list[int]
    sentence: list[int]
    word: list[int]


def boundaries(text: str) -> Boundaries:
    sentence = [m.end() for m in _SENTENCE.finditer(text) if not (m.group() == "." and _ABBREVIATION.search(text, max(0, m.end() - 8), m.end()))]
    return Boundaries([m.end() for m in _PARAGRAPH.finditer(text)], [m.end() for m in _LINE.finditer(text)], sentence, [m.end() for m in _SPACE.finditer(text)])


def _last(positions: list[int], low: int, high: int) -> int:
    """The last position in (low, high], else -1."""
    i = bisect.bisect_right(positions, high) - 1
    return positions[i] if i >= 0 and positions[i] > low else -1


def _first(positions: list[int], low: int, high: int) -> int:
    """The first position in [low, high], else -1."""
    i = bisect.bisect_left(positions, low)
    return positions[i] if i < len(positions) and positions[i] <= high else -1


def best_cut(text: str, at: Boundaries, low: int, middle: int, high: int, limit: int) -> tuple[int, str]:
    """The cut in (low, high]: the best level after `middle`, else the last natural end, else a blank, else the limit."""
    for name in ("paragraph", "line", "sentence"):
        if (p := _last(getattr(at, name), max(low, middle), high)) >= 0:
            return p, name
    earlier = {_last(getattr(at, name), low, high): name for name in ("sentence", "line", "paragraph")}
    if (p := max(earlier)) >= 0:
        return p, earlier[p]
    if (p := _last(at.word, max(low, high - limit // 2), high)) >= 0:
        return p, "word"
    p = high
    while p > max(low + 1, high - LOOK) and p < len(text) and (unicodedata.combining(text[p]) or text[p - 1 : p + 1] == "\r\n"):
        p -= 1
    return p, "limit"


def border(text: str, end: int, limit: int) -> tuple[int, str]:
    """The cut at or before `end` that the workers on its two sides agree on: it depends on the text near it only."""
    base = max(0, end - limit)
    near = text[base : end + LOOK]
    cut, name = best_cut(near, boundaries(near), (end - base) // 2, (end - base) // 2, end - base, limit)
    return base + cut, name


def overlap_start(at: Boundaries, start: int, cut: int, overlap: int) -> int:
    """Where the piece after `cut` starts: at a line, sentence or word that begins at most `overlap` before the cut."""
    low, high = max(start + 1, cut - overlap), cut - 1
    for positions in (at.line, at.sentence, at.word):
        if (p := _first(positions, low, high)) >= 0:
            return p
    return low


def cut_range(text: str, first: int, last: int, is_first: bool, is_last: bool, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """Pieces (start, end, boundary) of text[first:last], where text has a halo of limit + overlap before `first` and
    LOOK after `last`. The first piece starts before the agreed border by the overlap, the last ends at the border."""
    at = boundaries(text)
    done = 0 if is_first else border(text, first, limit)[0]
    start = done if is_first else overlap_start(at, max(0, done - overlap - 1), done, overlap)
    goal, name = (last, "end") if is_last else border(text, last, limit)
    out = []
    while done < goal:
        if goal - start <= limit:
            out.append((start, goal, name))
            break
        high = min(start + limit, goal - 2 * overlap)  # leaves the last piece longer than an overlap
        cut, level = best_cut(text, at, done, start + limit // 2, high, limit)
        out.append((start, cut, level))
        done, start = cut, overlap_start(at, start, cut, overlap)
    return out


def split_oversized(items: DataFrame, key: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of the items whose text has more than `limit` characters (code points).

    One row per piece: the key columns, piece_no (from 0), start and end (offsets in characters), boundary ('paragraph',
    'line', 'sentence', 'word', 'limit' or 'end': what the piece ends at) and piece. No piece is over the limit, together
    they cover the text, and each shares between 1 and `overlap` characters with the one before. A piece ends at a
    paragraph, line or sentence end if there is one after the end of the piece before and within the limit. Null,
    empty and short texts give no rows. Keys must be unique: repeated rows of one key give repeated pieces. Other columns
    are not read.
    """
    if not 0 < overlap * 4 < limit or size < 4 * limit:
        raise ValueError("the overlap must be under a quarter of the limit, and a range at least four limits")
    halo, width = limit + overlap, len(key)
    long = items.filter(F.char_length(text) > limit).select(*key, F.col(text).alias("_text"))
    fields = [items.schema[k] for k in key]
    names = [*key, "_range", "_n", "_k", "start", "end", "boundary", "piece"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "_range long, _n long, _k int, start long, end long, boundary string, piece string"])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def put(batch: pa.RecordBatch, rows: list[int], out: list[tuple]) -> pa.RecordBatch:
        take = pa.array(rows, pa.int32())
        columns = list(zip(*out)) if out else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([*(batch.column(i).take(take) for i in range(width)), *(pa.array(list(c), t) for c, t in zip(columns, kinds))], names)

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of texts of one range; of longer ones a row per range (no boundary yet) with its window and where that starts."""
        for batch in batches:
            rows, out = [], []
            for i, t in enumerate(batch.column(width).to_pylist()):
                n = len(t)
                if n <= size:
                    found = [(0, n, k, s, e, level, t[s:e]) for k, (s, e, level) in enumerate(cut_range(t, 0, n, True, True, limit, overlap))]
                else:
                    bases = ((r, max(0, r * size - halo)) for r in range((n - 1) // size + 1))
                    found = [(r, n, 0, b, 0, None, t[b : (r + 1) * size + LOOK]) for r, b in bases]
                rows.extend([i] * len(found))
                out.extend(found)
            yield put(batch, rows, out)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of windows, with offsets in the whole text."""
        for batch in batches:
            rows, out = [], []
            number, total, bases, windows = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_range", "_n", "start", "piece"))
            for i, (r, n, b, w) in enumerate(zip(number, total, bases, windows)):
                for k, (s, e, level) in enumerate(cut_range(w, r * size - b, min(n, (r + 1) * size) - b, r == 0, (r + 1) * size >= n, limit, overlap)):
                    rows.append(i)
                    out.append((r, n, k, b + s, b + e, level, w[s:e]))
            yield put(batch, rows, out)

    laid = cut(long.mapInArrow(lay, schema))
    small = laid.filter("boundary is not null").withColumn("piece_no", F.col("_k").cast("long"))
    giant = cut(laid.filter("boundary is null").repartition(*key, "_range").mapInArrow(emit, schema))
    # numbers before a range are the prefix sum of piece counts, one row per range
    counts = giant.groupBy(*key, "_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*key, "_range", before.alias("_before"))
    giant = giant.join(offsets, [*key, "_range"]).withColumn("piece_no", F.col("_k") + F.col("_before"))
    columns = [*key, "piece_no", "start", "end", "boundary", "piece"]
    return small.select(*columns).unionByName(giant.select(*columns))


def split_files(spark: SparkSession, path: str, limit: int = LIMIT, overlap: int = OVERLAP, size: int = FILE_RANGE) -> DataFrame:
    """Pieces of UTF-8 files, read by byte ranges: path, piece_no, start, end (offsets in bytes), boundary, piece.

    Files are listed without their content. A worker opens the file, seeks to its range and its halo and never reads
    more. The rules for pieces are those of split_oversized; files of up to `limit` characters are one piece, empty files
    give none. Bytes that are no UTF-8 are replaced by U+FFFD in `piece`; offsets stay true at the ends of ranges.
    """
    halo = 4 * (limit + overlap)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").filter("length > 0")
    ranges = files.withColumn("_range", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / size)))).repartition(F.col("path"), F.col("_range"))

    def aligned(raw: bytes, at: int) -> int:
        """The start of the character that holds byte `at`."""
        while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
            at -= 1
        return at

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                system, place = fs.FileSystem.from_uri(row["path"])
                first, last, n = row["_range"] * size, min(row["length"], (row["_range"] + 1) * size), row["length"]
                base = max(0, first - halo - 4)
                with system.open_input_file(place) as file:
                    file.seek(base)
                    raw = file.read(last + 4 * LOOK + 4 - base)
                skip = 0
                while base and skip < min(4, len(raw)) and raw[skip] & 0xC0 == 0x80:
                    skip += 1
                here, there = aligned(raw, first - base), aligned(raw, last - base)
                parts = [raw[skip:here].decode("utf-8", "replace"), raw[here:there].decode("utf-8", "replace")]
                text = "".join(parts) + raw[there : aligned(raw, len(raw) - 4) if last < n else len(raw)].decode("utf-8", "replace")
                a, b = len(parts[0]), len(parts[0]) + len(parts[1])
                for k, (s, e, level) in enumerate(cut_range(text, a, b, first == 0, last >= n, limit, overlap)):
                    start = base + skip + len(text[:s].encode())
                    out.append((row["path"], row["_range"], k, start, start + len(text[s:e].encode()), level, text[s:e]))
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], ["path", "_range", "_k", "start", "end", "boundary", "piece"])

    pieces = cut(ranges.select("path", "length", "_range").mapInArrow(emit, "path string, _range long, _k int, start long, end long, boundary string, piece string"))
    counts = pieces.groupBy("path", "_range").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("path").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("path", "_range", before.alias("_before"))
    return pieces.join(offsets, ["path", "_range"]).select("path", (F.col("_k") + F.col("_before")).alias("piece_no"), "start", "end", "boundary", "piece")


def store_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages of all oversized current objects and sources, each delivery of a source once."""
    objects = current_wide(table(spark, folder, "knowledge_object"), "body", where=F.char_length("body") > LIMIT)
    sources = table(spark, folder, "source_item").filter((F.char_length("text") > LIMIT) & F.col("id").isNotNull()).select("id", "text").dropDuplicates(["id"])
    items = objects.select(F.lit("knowledge_object").alias("table_name"), F.col("id").alias("record_id"), F.col("body").alias("text"))
    items = items.unionByName(sources.select(F.lit("source_item").alias("table_name"), F.col("id").alias("record_id"), "text"))
    return split_oversized(items, ["table_name", "record_id"], "text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The items that were split: those with a first piece."""
    return store_passages(spark, folder).filter("piece_no = 0").select("table_name", "record_id")


def p3_passages(spark: SparkSession, folder: str) -> DataFrame:
    return store_passages(spark, folder)


def p3_coverage(spark: SparkSession, folder: str) -> DataFrame:
    """Each split item with its length as covered by its passages, and whether they keep the rules."""
    own = Window.partitionBy("table_name", "record_id").orderBy("piece_no")
    pieces = store_passages(spark, folder).select("table_name", "record_id", "piece_no", "start", "end", F.char_length("piece").alias("n")).withColumn("shared", F.lag("end").over(own) - F.col("start"))
    fine = (F.col("n") <= LIMIT) & (F.col("n") == F.col("end") - F.col("start")) & F.when(F.col("piece_no") == 0, F.col("start") == 0).otherwise(F.col("shared").between(1, OVERLAP))
    return pieces.groupBy("table_name", "record_id").agg(F.max("end").alias("n_chars"), F.min(fine).alias("keeps_rules"))


def p3_files(spark: SparkSession, folder: str) -> DataFrame:
    """All source texts as a few big files, split by byte ranges of 64 KB: bytes covered, and whether all pieces keep the rules."""
    path = f"{shared_dir(spark).rstrip('/')}/lorestack/{uuid.uuid4().hex}"
    table(spark, folder, "source_item").filter("text is not null").select("text").coalesce(4).write.text(path)
    own = Window.partitionBy("path").orderBy("piece_no")
    pieces = split_files(spark, path, size=1 << 16).withColumn("shared", F.lag("end").over(own) - F.col("start")).withColumn("skips", F.col("piece_no") - F.coalesce(F.lag("piece_no").over(own), F.lit(-1)))
    # overlaps of files are measured in characters: at most four bytes each
    fine = (F.char_length("piece") <= LIMIT) & (F.octet_length("piece") == F.col("end") - F.col("start")) & (F.col("skips") == 1) & F.when(F.col("piece_no") == 0, F.col("start") == 0).otherwise(F.col("shared").between(1, 4 * OVERLAP))
    files = pieces.groupBy("path").agg(F.max("end").alias("n"), F.min(fine).alias("fine"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_bytes"), F.coalesce(F.min("fine"), F.lit(True)).alias("keeps_rules"))


_SQL = """
WITH head AS (SELECT DISTINCT ON (id) id, body FROM knowledge_object ORDER BY id, head_version DESC, ingested_at)
SELECT 'knowledge_object' AS table_name, id AS record_id, length(body) AS n_chars FROM head WHERE length(body) > 2000
UNION ALL SELECT 'source_item', id, max(length(text)) FROM source_item WHERE length(text) > 2000 GROUP BY id
"""
SQL = {
    "p3_found": f"SELECT table_name, record_id FROM ({_SQL})",
    "p3_files": "SELECT CAST(coalesce(sum(strlen(text) + 1), 0) AS BIGINT) AS n_bytes, true AS keeps_rules FROM source_item WHERE text IS NOT NULL",
    "p3_coverage": f"SELECT table_name, record_id, n_chars, true AS keeps_rules FROM ({_SQL})",
}
QUERIES = {"p3_found": p3_found, "p3_passages": p3_passages, "p3_coverage": p3_coverage, "p3_files": p3_files}
