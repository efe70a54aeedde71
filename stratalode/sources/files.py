"""Readers of the formats that can be ingested, validation of bytes, and text sinks."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.chunking import parse_csv, table_pages

#: Extension to source type; fixed values.
TYPES = {
    "pdf": "PDF", "docx": "DOCX", "pptx": "PPTX", "xlsx": "XLSX", "csv": "CSV", "txt": "TEXT", "md": "TEXT", "markdown": "TEXT",
    "aac": "AUDIO", "aif": "AUDIO", "aiff": "AUDIO", "flac": "AUDIO", "m4a": "AUDIO", "mp3": "AUDIO", "oga": "AUDIO", "ogg": "AUDIO", "opus": "AUDIO", "wav": "AUDIO", "webm": "AUDIO", "wma": "AUDIO",
}
AUDIO_BYTES, SHEET_CELLS = 100 * 1024 * 1024, 200_000
_PAGES = "source string, chunk_type string, page_index int, content string"

Extractor = Callable[[str, bytes], Iterator[tuple[str, int, str]]]


def source_type(path: Column) -> Column:
    out = F.lit(None).cast("string")
    kind = F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1))
    for extension, name in TYPES.items():
        out = F.when(kind == extension, name).otherwise(out)
    return out


def walked(spark: SparkSession, folder: str) -> DataFrame:
    """Files under a folder without hidden ones and archive litter, with a type; contents are read only if asked for. Empty files are not listed by the reader."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.filter(~name.startswith(".") & ~F.col("path").contains("/__MACOSX/")).withColumn("source_type", source_type(F.col("path"))).filter("source_type is not null")


def rejected(files: DataFrame) -> DataFrame:
    """``files`` (path, content, length, source_type) with ``reason``, null where the bytes fit the type."""
    head = F.hex(F.substring("content", 1, 8192))
    binary = head.rlike("^(?:[0-9A-F]{2})*?00")
    kind = F.col("source_type")
    reason = (
        F.when((kind == "PDF") & ~head.startswith("255044462D"), "no PDF header")
        .when(kind.isin("DOCX", "PPTX", "XLSX") & ~head.startswith("504B0304"), "no zip header")
        .when(kind.isin("TEXT", "CSV") & binary, "binary content")
        .when((kind == "AUDIO") & (F.col("length") == 0), "empty audio")
        .when((kind == "AUDIO") & (F.col("length") > AUDIO_BYTES), "audio over 100 MB")
    )
    return files.withColumn("reason", reason)


def deduplicated(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose bytes are new, first path of equals, with the managed name made of their hash."""
    named = files.withColumn("managed_path", T.managed_name(F.col("content"), T.file_extension(F.col("path"))))
    first = named.groupBy("managed_path").agg(F.min("path").alias("path"))
    return named.join(first, ["managed_path", "path"], "left_semi").join(known.select("managed_path"), "managed_path", "left_anti")


def _text(name: str, raw: bytes) -> Iterator[tuple[str, int, str]]:
    text = raw.decode("utf-8", "replace").removeprefix("﻿")
    if text.strip():
        yield "TEXT", 0, text


def _csv(name: str, raw: bytes) -> Iterator[tuple[str, int, str]]:
    for page in table_pages(parse_csv(raw.decode("utf-8", "replace"))):
        yield "TABLE", 0, page


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def sheets(raw: bytes) -> Iterator[tuple[str, list[list[str]]]]:
    """(name, rows) of the sheets of a workbook; all cells as text."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        cells = 0
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).find("m:sheets", _NS):
            target = links[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            rows = []
            for row in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{{{_NS['m']}}}row"):
                values: dict[int, str] = {}
                for c in row:
                    column = 0
                    for ch in (c.get("r") or "A").rstrip("0123456789"):
                        column = column * 26 + ord(ch) - 64
                    v = c.find("m:v", _NS)
                    text = "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    values[column - 1] = shared[int(text)] if c.get("t") == "s" and text else text
                    cells += 1
                    if cells > SHEET_CELLS:
                        raise ValueError(f"more than {SHEET_CELLS} cells")
                rows.append([values.get(i, "") for i in range(max(values, default=-1) + 1)])
            yield sheet.get("name"), rows


def _xlsx(name: str, raw: bytes) -> Iterator[tuple[str, int, str]]:
    for i, (sheet, rows) in enumerate(sheets(raw)):
        for page in table_pages(rows, sheet):
            yield "TABLE", i, page


#: Extractors by type; PDF, Office text and audio need a model or a converter and are added by the caller.
EXTRACTORS: dict[str, Extractor] = {"TEXT": _text, "CSV": _csv, "XLSX": _xlsx}


def pages(files: DataFrame, extractors: dict[str, Extractor] | None = None) -> DataFrame:
    """(source, chunk_type, page_index, content) of files (path, content, source_type); types without an extractor give none."""
    known = EXTRACTORS | (extractors or {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, k, i, t) for p, raw, s in zip(pdf["path"], pdf["content"], pdf["source_type"], strict=True) if s in known for k, i, t in known[s](p, raw)]
            yield pd.DataFrame(rows, columns=["source", "chunk_type", "page_index", "content"])

    return files.select("path", "content", "source_type").mapInPandas(run, _PAGES)


def ordered_pages(parts: DataFrame) -> DataFrame:
    """Parts of scanned pages in reading order: text, then images, then tables of each page."""
    kind = F.when(F.col("chunk_type") == "TEXT", 0).when(F.col("chunk_type") == "IMAGE", 1).otherwise(2)
    from pyspark.sql import Window

    return parts.withColumn("place", F.row_number().over(Window.partitionBy("source", "page_index").orderBy(kind, "pos")))


def accepted_ocr(images: DataFrame) -> DataFrame:
    """OCR results worth keeping: confidence of 80 beside text, 50 on pages without; no image of over 50 million pixels."""
    least = F.when(F.col("has_text"), 80).otherwise(50)
    return images.filter((F.col("confidence") >= least) & (F.col("width") * F.col("height") <= 50_000_000) & (T.trimmed(F.col("text")) != ""))


def table_text(rows: Column) -> Column:
    """Array of rows of cells as lines; blank cells and rows dropped."""
    cells = lambda r: F.array_join(F.filter(F.transform(r, T.collapsed), lambda c: c != ""), " | ")
    return F.array_join(F.filter(F.transform(rows, cells), lambda x: x != ""), "\n")


_LOG = "time string, level string, subsystem string, message string, fields map<string,string>, error struct<name:string,message:string>, _bad string"


def read_log(spark: SparkSession, path: str, *, stream: bool = False) -> DataFrame:
    """JSON-lines log with ``valid``: lines that are no JSON, lack a field or have an unknown level are kept as invalid."""
    reader = (spark.readStream if stream else spark.read).schema(_LOG).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad")
    sound = F.col("_bad").isNull() & F.col("time").isNotNull() & F.col("subsystem").isNotNull() & F.col("message").isNotNull() & F.col("level").isin("debug", "info", "warn", "error")
    return reader.json(path).withColumn("valid", F.coalesce(sound, F.lit(False))).drop("_bad")


def write_log(rows: DataFrame, path: str, *, most_rows: int = 20_000) -> None:
    """Append as JSON lines in files of bounded length."""
    rows.write.mode("append").option("maxRecordsPerFile", most_rows).json(path)


def to_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def from_lines(lines: DataFrame, schema: str) -> DataFrame:
    """Parsed lines; those that do not parse are dropped."""
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x"), "value").filter(F.ltrim("value").startswith("{") & F.expr("try_parse_json(value) is not null"))
    return parsed.select("x.*")


def chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(name, title, body) of Markdown files with front matter, in natural order by ``place``."""
    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "([^/]+)$", 1).alias("name"), F.col("value"))
    front = F.regexp_extract("value", "^---\\r?\\n([\\s\\S]*?)\\r?\\n---", 1)
    title = F.trim(F.regexp_extract(front, "(?m)^title:\\s*(.+)$", 1))
    body = F.regexp_replace("value", "^---\\r?\\n[\\s\\S]*?\\r?\\n---\\r?\\n?", "")
    return files.select("name", F.when(title != "", title).otherwise(T.title_of(F.col("name"))).alias("title"), body.alias("body"), T.natural_key(F.col("name")).alias("sort_key"))


def report(facts: DataFrame, entries: DataFrame) -> DataFrame:
    """Diagnostics report: named facts in order, then log lines; one text."""
    a = facts.agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(": ", "name", "value").alias("line")))).alias("x")).select(F.array_join("x.line", "\n").alias("facts"))
    b = entries.agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("x")).select(F.array_join("x.line", "\n").alias("log"))
    return a.crossJoin(F.broadcast(b)).select(F.concat("facts", F.lit("\n\n"), "log").alias("report"))
