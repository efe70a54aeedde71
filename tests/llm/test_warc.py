import base64
import hashlib
import random

import numpy as np
import pytest

from stratalode.llm import warc as op


def brute(pages):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    first = {}
    for p, _, h in pages:
        if p is not None:
            first[digest(h)] = min(p, first.get(digest(h), p))
    out = []
    for p, _, h in pages:
        d = digest(h)
        refers = first.get(d) if first.get(d) != p else None
        out.append((None if p is None else str(p), "revisit" if refers is not None else "response", None if refers is None else str(refers), len((h or "").encode()), d))
    return sorted(out, key=repr)


def roundtrip(spark, pages, tmp_path, part_bytes):
    frame = spark.createDataFrame([(*p, 7) for p in pages], "page_id long, url string, html string, bytes int").repartition(2)
    op.write_warc(spark, frame, str(tmp_path / "w"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", part_bytes)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = op.read_warc(spark, str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    return sorted(((None if r["page"] == "null" else r["page"], r["type"], r["refers"], r["bytes"], r["digest"]) for r in rows), key=repr)


def pages(seed):
    rng = random.Random(seed)
    magic = "WARC/1.0\r\n"
    fake = magic + "WARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    bodies = [None, "", "same", "é" * 50, magic, fake * 3, "x\r\n\r\n" + fake, "WWARC/1.0\r\n", "a\r\n" * 30, "z" * 3000]
    out = [(i, rng.choice([None, "http://x/a b\n", "u"]), rng.choice(bodies) if rng.random() < 0.6 else "".join(rng.choice("WARC/1.0\r\n\x00é") for _ in range(rng.randint(0, 400)))) for i in range(80)]
    return out + [out[2], (None, None, "same"), (None, None, None)]


@pytest.mark.parametrize(("seed", "part_bytes", "most"), [(1, "128m", 1000), (2, "700", 0)])
def test_round_trip_with_magic_in_payloads(spark, tmp_path, monkeypatch, seed, part_bytes, most):
    monkeypatch.setattr(op, "BROADCAST_ROWS", most)
    rows = pages(seed)
    assert roundtrip(spark, rows, tmp_path, part_bytes) == brute(rows)


def test_reached_by_doubling():
    offsets = np.array([0, 5, 9, 12, 20])
    assert op.reached(offsets, np.array([9, 12, 20, 99, 30]), offsets == 0).tolist() == [True, False, True, False, True]


def test_empty_table(spark, tmp_path):
    frame = spark.createDataFrame([], "page_id long, url string, html string")
    op.write_warc(spark, frame, str(tmp_path / "w"))
    assert op.read_warc(spark, str(tmp_path / "w")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    got = op.query(spark, sf_dir).select("page_id", "record_type", "refers_to", "payload_bytes", "payload_digest").collect()
    text = lambda x: None if x is None else str(x)
    assert sorted(((text(a), b, text(c), d, e) for a, b, c, d, e in got), key=repr) == brute(rows)
