import random
import zlib
from collections import defaultdict

import pytest

from stratalode.llm import sharding as op


def test_tree_agrees_with_a_sorted_list():
    rng = random.Random(0)
    tree, pairs = op.CapacityTree(), []
    for step in range(2000):
        if pairs and rng.random() < 0.4:
            pairs.remove(x := rng.choice(pairs))
            tree.remove(x)
        else:
            pairs.append(x := (rng.randrange(100), step))
            tree.add(x)
        room = rng.randrange(110)
        assert tree.tightest(room) == min((p for p in pairs if p[0] >= room), default=None)


def test_plan_is_item_by_item_best_fit():
    rng = random.Random(1)
    sizes = sorted((rng.randint(1, 40) for _ in range(200)), reverse=True)
    bins = []
    for s in sizes:
        fits = [b for b in range(len(bins)) if bins[b] >= s]
        b = min(fits, key=lambda b: (bins[b], b)) if fits else len(bins)
        if b == len(bins):
            bins.append(100)
        bins[b] -= s
    classes = [(s, sizes.count(s), float(s)) for s in sorted(set(sizes), reverse=True)]
    got = defaultdict(float)
    for size, shard, k in op.best_fit_decreasing(classes, 100):
        got[shard] += size * k
    assert sorted(100 - x for x in bins) == sorted(got.values())


def check(spark, docs, **how):
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, shard int").repartition(3)
    rows = op.pack(spark, frame, **how).collect()
    want = sorted(((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs), key=repr)
    assert sorted(((r["id"], r["size"], r["text_crc32"]) for r in rows), key=repr) == want
    slots, homes, sizes = defaultdict(list), defaultdict(set), defaultdict(int)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"], r["size"]].add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(x) == 1 for x in homes.values())
    return sizes


@pytest.mark.parametrize("bucket_rows", [op.BUCKET_ROWS, 7])
def test_groups_slots_and_balance(spark, monkeypatch, bucket_rows):
    monkeypatch.setattr(op, "BUCKET_ROWS", bucket_rows)
    rng = random.Random(2)
    docs = [(i, "é" * rng.randint(0, 300)) for i in range(400)] + [(1000 + i, "copy " * 30) for i in range(40)] + [(None, None), (None, "x"), (5, "y"), (5, "y"), (6, "z" * 9000)]
    sizes = check(spark, docs, shards=8)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 0.02 * max(sizes.values())


def test_capacity(spark):
    docs = [(i, "x" * (i % 50)) for i in range(200)]
    sizes = check(spark, docs, shards=None, capacity=600)
    assert max(sizes.values()) <= 600
    with pytest.raises(ValueError, match="larger"):
        op.pack(spark, spark.createDataFrame([(1, "x" * 700)], "doc_id long, text string"), capacity=600)


def test_empty_table(spark):
    assert op.pack(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    rows = op.query(spark, sf_dir).collect()
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    totals = defaultdict(int)
    for r in rows:
        assert r["size"] == len(docs[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(docs[r["doc_id"]].encode()) and r["law"] == "bytes" and r["grown_shard"] is None
        totals[r["shard"]] += r["size"]
    assert max(totals.values()) <= 1.05 * min(totals.values())
