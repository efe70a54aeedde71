"""Readers over small files, and streams against their batch answers."""

import io
import json
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratalode.operators import sync
from stratalode.plans import schema
from stratalode.sources import files as S
from stratalode.streaming import maintenance as M


def workbook() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si><si><t>Ada</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="s"><v>1</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_walk_validate_and_extract(spark, tmp_path):
    d = tmp_path / "in"
    (d / "__MACOSX").mkdir(parents=True)
    contents = {"a.txt": "﻿Hello there".encode(), "b.csv": b'h,"x ""y"""\r\n1,2\n', "c.xlsx": workbook(), "d.pdf": b"not a pdf", "e.txt": b"x\0y", ".hidden.txt": b"no", "__MACOSX/f.txt": b"no", "g.exe": b"no"}
    for name, raw in contents.items():
        (d / name).write_bytes(raw)
    found = S.rejected(S.walked(spark, str(d))).withColumn("name", F.regexp_extract("path", "([^/]+)$", 1)).cache()
    assert {r["name"]: r["reason"] for r in found.collect()} == {"a.txt": None, "b.csv": None, "c.xlsx": None, "d.pdf": "no PDF header", "e.txt": "binary content"}
    pages = {r["source"].rsplit("/", 1)[1]: (r["chunk_type"], r["content"]) for r in S.pages(found.filter("reason is null")).collect()}
    assert pages == {"a.txt": ("TEXT", "Hello there"), "b.csv": ("TABLE", 'h | x "y"\n1 | 2'), "c.xlsx": ("TABLE", "Sheet: One\nname |  | 7\nAda")}
    none = spark.createDataFrame([], "managed_path string")
    assert S.deduplicated(found.unionByName(found), none).select("managed_path").distinct().count() == 5


def test_log_round_trip(spark, tmp_path):
    good = {"time": "t", "level": "info", "subsystem": "s", "message": "m", "fields": {"a": "1"}}
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join([json.dumps(good), "{broken", json.dumps(good | {"level": "loud"})]))
    assert sorted(r["valid"] for r in S.read_log(spark, str(path)).collect()) == [False, False, True]
    lines = S.to_lines(spark.range(2)).unionByName(spark.createDataFrame([("{bad",)], "value string"))
    assert S.from_lines(lines, "id long").count() == 2


def test_ocr_tables_and_chapters(spark, tmp_path):
    rows = spark.createDataFrame([(79, True, 1, 1, "x"), (80, True, 1, 1, "x"), (50, False, 1, 1, "x"), (99, True, 10_000, 10_000, "x")], "confidence int, has_text boolean, width long, height long, text string")
    assert S.accepted_ocr(rows).count() == 2
    cells = F.array(F.array(F.lit(" a "), F.lit("")), F.array(F.lit(" ")), F.array(F.lit("b"), F.lit("c")))
    assert spark.range(1).select(S.table_text(cells)).first()[0] == "a\nb | c"
    (tmp_path / "2. Two.md").write_text("---\ntitle: Second\n---\nBody")
    (tmp_path / "10. Ten.md").write_text("No front matter")
    got = S.chapters(spark, str(tmp_path)).orderBy("sort_key").collect()
    assert [(r["title"], r["body"]) for r in got] == [("Second", "Body"), ("10. Ten", "No front matter")]


def test_all_schemas_parse(spark):
    assert all(len(schema.schema(t)) for t in schema.TABLES)


LOG = [(1, 1, 10, "put", "m", 1.0), (2, 1, 0, "remove", "m", 0.0), (3, 2, 20, "put", "m", 1.0), (4, 1, 10, "put", "m", 5.0), (5, 3, 30, "put", "other", 3.0), (6, 2, 21, "put", "m", 2.0)]
LOG_SCHEMA = "seq long, document_id long, chunk_id long, kind string, embedding_model string, value double"


def test_versioned_index_equals_batch(spark, tmp_path):
    source = tmp_path / "log"
    for k in range(3):
        spark.createDataFrame(LOG[2 * k : 2 * k + 2], LOG_SCHEMA).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    M.versioned_index(spark, stream, str(tmp_path / "index"), "m", str(tmp_path / "cp")).awaitTermination(120)
    last = max(int(p.name[1:]) for p in (tmp_path / "index").iterdir())
    empty = spark.createDataFrame([], "document_id long, chunk_id long, value double")
    want = sync.applied(empty, spark.createDataFrame(LOG, LOG_SCHEMA), "m")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "index" / f"v{last}")).collect())) == sorted(map(tuple, want.collect()))


def test_ownership_stream(spark, tmp_path):
    pytest.importorskip("pyarrow")
    rows = [("h", "a", None, 1), ("h", "b", None, 2), ("h", "c", "a", 3), ("h", "a", None, 4)]
    spark.createDataFrame(rows, "content_hash string, path string, replaces string, seq long").coalesce(1).write.parquet(str(tmp_path / "up"))
    stream = spark.readStream.schema("content_hash string, path string, replaces string, seq long").parquet(str(tmp_path / "up"))
    q = M.claim_contents(stream).writeStream.format("memory").queryName("claims").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("claims").collect()), key=repr) == sorted([("h", "a", "synced", None), ("h", "b", "duplicate", "a"), ("h", "c", "synced", None), ("h", "a", "duplicate", "c")], key=repr)


def test_bursts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    rows = [("k", t), ("k", t + timedelta(seconds=1)), ("k", t + timedelta(seconds=9)), ("z", t + timedelta(seconds=90))]
    frame = spark.createDataFrame(rows, "key string, ts timestamp")
    batch = {(r["key"], r["n"]) for r in M.debounced(frame, key="key").collect()}
    assert batch == {("k", 2), ("k", 1), ("z", 1)}
    frame.coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = M.debounced(spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "e")), key="key")
    q = stream.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["key"], r["n"]) for r in spark.table("bursts").collect()} == {("k", 2), ("k", 1)}
