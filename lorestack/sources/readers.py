"""Readers that turn captured material into text and structure."""

from __future__ import annotations

import html
import re
import zlib
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types by file extension, extensions that are read, folders that are not.
MEDIA_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "pdf": "application/pdf",
    "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tiff": "image/tiff", "eml": "message/rfc822", "mp3": "audio/mpeg", "wav": "audio/wav", "mp4": "video/mp4",
}
READABLE = ("md", "markdown", "txt", "html", "htm", "json", "csv", "pdf")
SKIPPED_FOLDERS = ("node_modules", ".git", "__pycache__", "dist", "build", "target", "venv")
MAX_BYTES = 10 * 1024 * 1024


def media_type(uri: Column) -> Column:
    """The media type that an address ends in; null if unknown."""
    extension = F.lower(F.regexp_extract(F.regexp_replace(uri, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), extension)


def plan_folder(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """files (path, length) with `reason`, why a file is skipped; null: it is read."""
    path = F.col("path")
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    reason = (
        F.when(path.rlike(r"(^|/)(" + "|".join(map(re.escape, SKIPPED_FOLDERS)) + ")/"), "skipped folder")
        .when(path.rlike(r"(^|/)\.[^/]+"), "hidden")
        .when(~extension.isin(*READABLE), "unsupported type")
        .when(F.col("length") == 0, "empty")
        .when(F.col("length") > max_bytes, "too large")
    )
    return files.withColumn("reason", reason)


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder with size and time of change, without their content; Spark lists no hidden and no empty files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def unseen(files: DataFrame, sources: DataFrame) -> DataFrame:
    """Files whose path, size and time of change no recorded source has."""
    return files.join(sources.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


class _Page(HTMLParser):
    BREAKS = {"p", "div", "br", "li", "tr", "table", "ul", "ol", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
    SILENT = {"script", "style", "noscript", "svg"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.headings, self.title = [], [], [], ""
        self.silent, self.href, self.link, self.level, self.heading, self.in_title = 0, None, [], 0, [], False

    def handle_starttag(self, tag, attrs):
        if tag in self.SILENT:
            self.silent += 1
        elif tag == "title":
            self.in_title = True
        elif tag == "a":
            self.href, self.link = dict(attrs).get("href"), []
        elif re.fullmatch("h[1-6]", tag):
            self.level, self.heading = int(tag[1]), []
        self.out.append("\n\n" if tag in self.BREAKS else " ")

    def handle_endtag(self, tag):
        if tag in self.SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.href is not None:
            self.links.append({"href": self.href, "text": " ".join("".join(self.link).split())})
            self.href = None
        elif re.fullmatch("h[1-6]", tag) and self.level:
            self.headings.append({"level": self.level, "text": " ".join("".join(self.heading).split())})
            self.level = 0
        self.out.append("\n\n" if tag in self.BREAKS else " ")

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.title += data
            return
        self.out.append(data)
        if self.href is not None:
            self.link.append(data)
        if self.level:
            self.heading.append(data)


def read_html(text: str | None) -> dict:
    page = _Page()
    page.feed(text or "")
    page.close()
    body = re.sub(r"[^\S\n]+", " ", "".join(page.out))
    return {"title": " ".join(page.title.split()), "text": re.sub(r"\s*\n\s*\n\s*", "\n\n", body).strip(), "links": page.links, "headings": page.headings}


def parse_html(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, title, text, links, headings) of pages; null pages give empty text."""
    kind = df.schema[key].dataType.simpleString()

    def read(frames):
        for frame in frames:
            rows = [read_html(t) for t in frame[text]]
            yield pd.DataFrame({key: frame[key], **{c: [r[c] for r in rows] for c in ("title", "text", "links", "headings")}})

    return df.select(key, text).mapInPandas(read, f"{key} {kind}, title string, text string, links array<struct<href: string, text: string>>, headings array<struct<level: int, text: string>>")


def flatten_json(text: str | None, depth: int = 6, items: int = 200) -> str:
    """JSON as lines of 'path: value'; text that isn't JSON stays as it is."""
    import json

    try:
        value = json.loads(text or "")
    except ValueError:
        return text or ""
    lines: list[str] = []

    def walk(x, path: str, level: int) -> None:
        if isinstance(x, dict) and level < depth:
            for k, v in x.items():
                walk(v, f"{path}.{k}" if path else str(k), level + 1)
        elif isinstance(x, list) and level < depth:
            for i, v in enumerate(x[:items]):
                walk(v, f"{path}[{i}]", level + 1)
        else:
            lines.append(f"{path}: {json.dumps(x, ensure_ascii=False) if isinstance(x, (dict, list)) else x}")

    walk(value, "", 0)
    return "\n".join(lines)


_STREAM = re.compile(rb"<<(?:[^<>]|<<.*?>>|<[^<>]*>)*>>\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|')|\[(?:[^\[\]]|\\.)*\]\s*TJ|<[0-9A-Fa-f\s]+>\s*Tj|(?:T\*|Td|TD|ET)", re.S)
_STRING = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>", re.S)


def _shown(raw: bytes) -> str:
    if raw[:1] == b"<":
        data = bytes.fromhex(re.sub(rb"\s", b"", raw[1:-1]).decode().ljust(2 * ((len(re.sub(rb"\s", b"", raw[1:-1])) + 1) // 2), "0"))
        return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")
    plain = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    data = re.sub(rb"\\([0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else plain.get(m[1], m[1]), raw[1:-1], flags=re.S)
    return data[2:].decode("utf-16-be", "replace") if data[:2] == b"\xfe\xff" else data.decode("cp1252", "replace")


def read_pdf(data: bytes) -> tuple[str, int]:
    """(text, pages) of a PDF without encryption: strings shown by its content streams."""
    pages = len(re.findall(rb"/Type\s*/Page\b(?!s)", data))
    out: list[str] = []
    for m in _STREAM.finditer(data):
        body = m.group(1)
        if b"FlateDecode" in m.group(0)[: m.start(1) - m.start()]:
            try:
                body = zlib.decompressobj().decompress(body)
            except zlib.error:
                continue
        if b"Tj" not in body and b"TJ" not in body:
            continue
        for shown in _SHOWN.finditer(body):
            if shown.group()[-2:] in (b"T*", b"Td", b"TD", b"ET"):
                out.append("\n")
            else:
                out.extend(_shown(s.group()) for s in _STRING.finditer(shown.group()))
    return re.sub(r"\n\s*\n+", "\n", "".join(out)).strip(), pages


_FRONT = re.compile(r"---\r?\n(.*?)\r?\n---\r?\n?", re.S)
_HEADING = re.compile(r"^(#{1,6})\s+(.+)$", re.M)


def first_line(text: str) -> str | None:
    """The first line with content, cut to 120 characters."""
    line = next((x.strip() for x in re.split(r"\r?\n", text) if x.strip()), None)
    return line if line is None or len(line) <= 120 else line[:117] + "…"


def _brackets(text: str) -> tuple[str, list[dict], list[str]]:
    """(text with the words of [words](href) and [[page]] alone, links, pages), in one scan that never looks back."""
    out, links, pages, at = [], [], [], 0
    while (start := text.find("[", at)) >= 0:
        if text.startswith("[[", start) and (end := text.find("]]", start + 2)) >= 0:
            out += [text[at:start], text[start + 2 : end]]
            pages.append(text[start + 2 : end].strip())
            at = end + 2
            continue
        shut = text.find("]", start + 1)
        if shut < 0:
            break
        if not text.startswith("(", shut + 1):
            out.append(text[at : shut + 1])
            at = shut + 1
            continue
        end = text.find(")", shut + 2)
        if end < 0:
            break
        words, href = text[start + 1 : shut], (text[shut + 2 : end].split() or [""])[0]
        if words and href:
            links.append({"href": href, "text": words})
        out += [text[at:start], words]
        at = end + 1
    return "".join([*out, text[at:]]), links, pages


def read_markdown(raw: str | None) -> dict:
    """title (front matter, first heading of level 1, or first line), text without marks, front matter, headings with their
    offsets, links and linked pages."""
    body, front = raw or "", {}
    if m := _FRONT.match(body):
        body = body[m.end() :]
        pairs = (re.match(r"([\w-]+)\s*:\s*(.*)$", line.strip()) for line in re.split(r"\r?\n", m[1]))
        front = {p[1]: re.sub(r"^[\"']|[\"']$", "", p[2]) for p in pairs if p}
    headings = [{"level": len(m[1]), "text": m[2].strip(), "offset": m.start()} for m in _HEADING.finditer(body)]
    text = re.sub(r"```.*?```", lambda m: re.sub(r"```\w*\n?", "", m[0]), body, flags=re.S)
    text = re.sub(r"^#{1,6}\s+", "", text, flags=re.M)
    text = re.sub(r"[*_]{1,3}([^*_]+)[*_]{1,3}", r"\1", text)
    text, links, pages = _brackets(text)
    text = re.sub(r"^[-*+]\s+", "", re.sub(r"^>\s?", "", text, flags=re.M), flags=re.M).strip()
    title = front.get("title") or next((h["text"] for h in headings if h["level"] == 1), None) or first_line(text)
    return {"title": title, "text": text, "front": front, "headings": headings, "links": links, "pages": pages}


def read_csv(raw: str | None, limit: int = 500) -> dict:
    """text ('column: value; ...' of the first `limit` rows), columns and the number of rows of one table."""
    import csv

    rows = [[c.strip() for c in next(csv.reader([line]), [])] for line in re.split(r"\r?\n", raw or "") if line]
    if not rows:
        return {"text": "", "columns": [], "rows": 0}
    head = rows[0]
    lines = ("; ".join(f"{h}: {r[i] if i < len(r) else ''}" for i, h in enumerate(head)) for r in rows[1 : limit + 1])
    return {"text": "\n".join(lines), "columns": head, "rows": len(rows) - 1}


def read_text(raw: str, kind: str) -> dict:
    """title, text, and the counts of headings, links and rows of a text of a media type."""
    if kind == "text/html":
        page = read_html(raw)
        return {"title": page["title"] or first_line(page["text"]), "text": page["text"], "headings": len(page["headings"]), "links": len(page["links"]), "rows": 0}
    if kind == "text/markdown":
        page = read_markdown(raw)
        return {"title": page["title"], "text": page["text"], "headings": len(page["headings"]), "links": len(page["links"]), "rows": 0}
    if kind == "text/csv":
        page = read_csv(raw)
        return {"title": None, "text": page["text"], "headings": 0, "links": 0, "rows": page["rows"]}
    text = flatten_json(raw) if kind == "application/json" else raw
    return {"title": first_line(text) if kind == "text/plain" else None, "text": text, "headings": 0, "links": 0, "rows": 0}


def parse_texts(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """(key, title, text, headings, links, rows): every text read by its media type; null texts as empty ones."""
    of = df.schema[key].dataType.simpleString()

    def read(frames):
        for frame in frames:
            rows = [read_text(t or "", k or "text/plain") for t, k in zip(frame["t"], frame["m"])]
            yield pd.DataFrame({"key": frame["key"], **{c: [r[c] for r in rows] for c in ("title", "text", "headings", "links", "rows")}})

    return df.select(F.col(key).alias("key"), F.col(text).alias("t"), F.col(kind).alias("m")).mapInPandas(read, f"key {of}, title string, text string, headings int, links int, rows int")


def read_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, media_type, title, text, note) of files (path, content, and their length): text as read, or why there is none.

    Files over `max_bytes` aren't read. One file at a time is handed to a worker's reader."""

    def read(frames):
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                kind = MEDIA_TYPES.get(path.rsplit(".", 1)[-1].lower(), "application/pdf" if content is not None and content[:4] == b"%PDF" else "text/plain")
                title, text, note = None, "", None
                if content is None:
                    note = "too large"
                elif kind.split("/")[0] in ("image", "audio", "video"):
                    note = f"no reader for {kind}"
                elif kind == "application/pdf":
                    text = read_pdf(content)[0]
                    note = None if text else "encrypted" if b"/Encrypt" in content else "no text in the file"
                    title = first_line(text)
                else:
                    page = read_text(content.decode("utf-8", "replace"), kind)
                    title, text = page["title"], page["text"]
                yield pd.DataFrame([(path, kind, title, text, note)], columns=["path", "media_type", "title", "text", "note"])

    size = F.col("length") if "length" in files.columns else F.octet_length("content")
    bounded = files.select("path", F.when(size <= max_bytes, F.col("content")).alias("content"))
    return bounded.mapInPandas(read, "path string, media_type string, title string, text string, note string")


def read_csv_rows(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    """The rows of each CSV file as 'column: value; ...', at most `limit` a file, as the reading of tables shows them."""
    files = spark.read.format("binaryFile").load(path)
    lines = read_files(files).filter("media_type = 'text/csv' and text <> ''").select("path", F.posexplode(F.split("text", "\n")).alias("row", "line"))
    return lines.filter(F.col("row") < limit).select("line")
