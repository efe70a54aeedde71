"""WARC archives: a sink, and a reader that finds records by boundary-chain verification.

Writing needs no Python: a record is a string expression, and Spark's text writer ends each with CRLF CRLF.

Reading splits files anywhere. Spark's text reader cuts at the magic line, so a task sees the stretches between
magic lines of its byte range, in order, and turns each into a candidate: its offset and, from Content-Length,
its successor's. A payload may hold the magic line too, so candidates are only believed if the chain of
successors from the start of the file reaches them. Each task jumps pointers inside its range (doubling them
until every candidate knows where it leaves the range); the few range exits are chained per file in the same
way; each range then marks what its entry reaches. Payloads stay where they are read, except those cut by magic
lines of their own, which are put together in a second pass.

Defined cases: null html is an empty payload; a null page_id is written as ``null`` and read as null, and sorts
after all others; of equal payloads every row with the smallest page_id is a response, so a repeated row is one
too; a null url has no target header, control characters in a url are percent-encoded; an empty table gives an
empty folder and no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys

MAGIC = "WARC/1.0\r\n"
END = "\r\n\r\n"
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_ID = "urn:page:"
_DATE = "2024-01-01T00:00:00Z"
_IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


#: Revisits that may be broadcast: about 100 bytes each, 20 MB in all. More are joined by a shuffle.
BROADCAST_ROWS = 200_000


def base32(digits: Column) -> Column:
    """Upper-case base32 of 20 bytes given as 40 hexadecimal digits."""
    parts = []
    for group in range(8):
        bits = F.conv(F.substring(digits, group * 5 + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*parts)


def with_revisits(spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page, url, payload, bytes, sha1, refers): refers is the page whose payload of at least ``least_bytes`` this one repeats."""
    page, payload = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(page.alias("page"), F.col(id_col).cast("long").alias("number"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary"))})
    light = keys.stored(spark, rows.filter(F.col("bytes") >= least_bytes).select("page", "number", "sha1"))
    first = light.groupBy("sha1").agg(F.min("number").alias("refers"), F.count("*").alias("n")).filter("n > 1 and refers is not null").select("sha1", "refers")
    again = keys.stored(spark, light.join(first, "sha1").filter("number is null or number != refers").select("page", "sha1", "refers").distinct())
    again = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again.hint("shuffle_hash")
    return rows.drop("number").join(again, ["page", "sha1"], "left")


def records(rows: DataFrame) -> DataFrame:
    """One string per record, without the CRLF CRLF that ends it."""
    encoded = F.col("url")
    for code in [*range(33), 127]:
        encoded = F.replace(encoded, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    encoded = F.when(F.col("url").rlike("[\\x00-\\x20\\x7F]"), encoded).otherwise(F.col("url"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(END))
    revisit = F.col("refers").isNotNull()
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    value = F.concat(
        F.lit(f"{MAGIC}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"\r\nWARC-Record-ID: <{_ID}"), F.col("page"), F.lit(f">\r\nWARC-Date: {_DATE}\r\n"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("WARC-Target-URI: "), encoded, F.lit("\r\n"))),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_ID}"), F.col("refers").cast("string"), F.lit(f">\r\nWARC-Profile: {_IDENTICAL}\r\n"))).otherwise(""),
        F.lit("WARC-Payload-Digest: sha1:"), base32(F.col("sha1")), F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
        http, F.when(revisit, "").otherwise(F.col("payload")),
    )
    return rows.select(value.alias("value"))


def write_warc(spark: SparkSession, pages: DataFrame, path: str, **options) -> None:
    """Write one record per row of ``pages`` to ``.txt`` part files under ``path``, which are plain WARC files."""
    records(with_revisits(spark, pages, **options)).write.option("lineSep", END).text(path)


def parse(segment: bytes) -> tuple[dict[bytes, bytes], int, int] | None:
    """(header fields, start of the block, its length) of what follows a magic line, or None if it is no record."""
    stop = segment.find(b"\r\n\r\n")
    if stop < 0:
        return None
    fields = {}
    for line in segment[:stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    length = fields.get(b"content-length", b"")
    return (fields, stop + 4, int(length)) if length.isdigit() else None


def _payload(block: bytes) -> tuple[int, bytes]:
    """(Content-Length of the HTTP head, payload) of an HTTP response block."""
    head, _, payload = block.partition(b"\r\n\r\n")
    length = next((x.partition(b":")[2] for x in head.lower().split(b"\r\n") if x.startswith(b"content-length:")), b"")
    return (int(length) if length.strip().isdigit() else len(payload)), payload


def _describe(fields: dict[bytes, bytes], block: bytes | None) -> tuple:
    """(page, type, refers, bytes, digest) of a record; bytes and digest are those of the payload read, for a revisit those it names."""
    kind = fields.get(b"warc-type", b"").decode("utf-8", "replace")
    page, refers = (fields.get(k, b"").decode("utf-8", "replace").strip("<>").removeprefix(_ID) or None for k in (b"warc-record-id", b"warc-refers-to"))
    if block is None:
        return page, kind, refers, None, None
    stated, payload = _payload(block)
    if kind == "revisit":
        return page, kind, refers, stated, fields.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:")
    return page, kind, refers, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()


def jump(following: np.ndarray) -> np.ndarray:
    """Where each place ends up if it follows ``following`` (its own index: stop) to the end; pointers double each round."""
    while True:
        onward = following[following]
        if (onward == following).all():
            return following
        following = onward


def reached(offsets: np.ndarray, successors: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Mask of the offsets (ascending) that chains from those marked in ``start`` reach, by pointer doubling."""
    n = len(offsets)
    if not n:
        return start
    at = np.minimum(np.searchsorted(offsets, successors), n - 1)
    hop = np.append(np.where(offsets[at] == successors, at, n), n)  # n: no such candidate
    mark = np.append(start, False)
    for _ in range(max(1, int(n).bit_length())):
        mark[hop[np.flatnonzero(mark)]] = True
        hop = hop[hop]
    return mark[:n]


_CANDIDATE = "file string, block long, part long, rel long, size long, succ long, exit long, whole boolean, page string, type string, refers string, bytes long, digest string"


def _segments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MAGIC).option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, int, int, bytes]]:
    """(file, block, number in the block, offset from the block's first segment, bytes) of every segment of a task."""
    here, part, at = None, 0, 0
    for batch in batches:
        for file, block, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, block) != here:
                here, part, at = (file, block), 0, 0
            yield file, block, part, at, value
            part, at = part + 1, at + len(value) + len(MAGIC)


def _candidates(segments: DataFrame) -> DataFrame:
    """Every segment as a candidate record; ``exit``: where the chain from it leaves the task's range, null if it breaks."""

    def flush(rows: list[tuple], end: int) -> pa.RecordBatch:
        rel = np.array([r[3] for r in rows], np.int64)
        succ = np.array([-1 if r[5] is None else r[5] for r in rows], np.int64)
        n = len(rows)
        # Places n and n+1 stand for having left the range and for a broken chain.
        at = np.minimum(np.searchsorted(rel, succ), n - 1)
        hop = np.concatenate([np.where(succ >= end - len(MAGIC), np.arange(n), np.where((succ >= 0) & (rel[at] == succ), at, n)), [n]])
        last = jump(hop)[:n]
        out = [None if k == n else int(succ[k]) for k in last.tolist()]
        columns = [list(c) for c in zip(*rows, strict=True)]
        columns.insert(6, out)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    long, text = pa.int64(), pa.string()
    names = [x.split()[0] for x in _CANDIDATE.split(", ")]
    kinds = [text, long, long, long, long, long, long, pa.bool_(), text, text, text, long, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        end = 0
        for file, block, part, at, value in _numbered(batches):
            if rows and (file, block) != rows[0][:2]:
                yield flush(rows, end)
                rows = []
            end = at + len(value) + len(MAGIC)
            got = parse(value) if part or block else None  # nothing stands before a file's first magic line
            if got is None:
                rows.append((file, block, part, at - len(MAGIC), len(value), None, False, None, None, None, None, None))
                continue
            fields, start, length = got
            whole = len(value) >= start + length
            rows.append((file, block, part, at - len(MAGIC), len(value), at + start + length + 4, whole, *_describe(fields, value[start : start + length] if whole else None)))
        if rows:
            yield flush(rows, end)

    return segments.mapInArrow(run, _CANDIDATE)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(page, type, refers, bytes, digest) of every record that the chain from its file's start reaches."""
    found = keys.stored(spark, _candidates(_segments(spark, path)))
    sizes = found.groupBy("file", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("total"))
    bases = sizes.select("file", "block", F.sum("total").over(_before("file", "block")).alias("base")).fillna(0)
    placed = found.join(bases, ["file", "block"]).withColumns({c: F.col(c) + F.col("base") for c in ("rel", "succ", "exit")})
    placed = keys.stored(spark, placed)

    # Chains between ranges: only offsets where a chain enters a range matter.
    entries = placed.filter("exit is not null").select("file", F.col("exit").alias("rel")).unionByName(placed.select("file", F.lit(0).cast("long").alias("rel"))).distinct()
    edges = entries.join(placed.select("file", "block", "rel", "exit"), ["file", "rel"])

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rel")
        offsets = pdf["rel"].to_numpy()
        mark = reached(offsets, pdf["exit"].fillna(-1).to_numpy().astype(np.int64), offsets == 0)
        return pdf.loc[mark, ["file", "block", "rel"]].rename(columns={"rel": "entry"})

    reached_entries = edges.groupBy("file").applyInPandas(chain, "file string, block long, entry long")

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rel")
        offsets = pdf["rel"].to_numpy()
        mark = reached(offsets, pdf["succ"].fillna(-1).to_numpy().astype(np.int64), offsets == pdf["entry"].to_numpy())
        return pdf.loc[mark, ["file", "block", "part", "rel"]]

    light = placed.join(reached_entries, ["file", "block"]).select("file", "block", "part", "rel", "succ", "entry")
    true = light.groupBy("file", "block").applyInPandas(inside, "file string, block long, part long, rel long")
    kept = keys.stored(spark, placed.join(true.select("file", "block", "part"), ["file", "block", "part"]))
    result = kept.filter("whole").select("page", "type", "refers", "bytes", "digest")
    cut = kept.filter("not whole")
    if cut.isEmpty():
        return result

    # Records whose payload holds magic lines: every segment up to the successor belongs to them.
    spans = cut.select("file", F.col("rel").alias("start"), F.col("succ").alias("stop"))
    pieces = placed.select("file", "block", "part", "rel").join(spans, (placed["file"] == spans["file"]) & (F.col("rel") >= F.col("start")) & (F.col("rel") < F.col("stop"))).select(placed["file"], "block", "part", "rel", "start")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, block, part, _, value in _numbered(batches):
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block]), pa.array([part]), pa.array([value], pa.binary())], names=["file", "block", "part", "value"])

    bodies = _segments(spark, path).mapInArrow(number, "file string, block long, part long, value binary").join(pieces, ["file", "block", "part"])

    def rebuild(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = MAGIC.encode().join(pdf.sort_values("rel")["value"])
        fields, start, length = parse(raw)
        return pd.DataFrame([_describe(fields, raw[start : start + length])], columns=["page", "type", "refers", "bytes", "digest"])

    return result.unionByName(bodies.groupBy("file", "start").applyInPandas(rebuild, result.schema))


def _before(*columns: str):
    from pyspark.sql import Window

    return Window.partitionBy(columns[0]).orderBy(*columns[1:]).rowsBetween(Window.unboundedPreceding, -1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = keys.shared_dir(spark)
    write_warc(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"), path, least_bytes=0)
    back = read_warc(spark, path)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    return back.select(number("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to"))
