"""Bounds of the operators at their edges."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest

from stratalode.llm import decontaminate, repeats, sharding, substring_dedup, suffix_dedup

from .test_suffix_dedup import brute, random_docs, run


def test_capacity_holds_for_groups_over_64_kb(spark):
    # Two sizes of one class (16 leading bits): its mean lies under the larger one.
    sizes = [2**17, 2**17 + 3] * 6
    docs = spark.createDataFrame([(i, chr(97 + i) * (s - 1)) for i, s in enumerate(sizes)], "doc_id long, text string")
    shards = defaultdict(int)
    for r in sharding.pack(spark, docs, shards=None, capacity=2**18 + 3).collect():
        shards[r["shard"]] += r["size"]
    assert sum(shards.values()) == sum(sizes) and max(shards.values()) <= 2**18 + 3
    with pytest.raises(ValueError, match="larger"):
        sharding.pack(spark, docs, shards=None, capacity=2**17 + 2)


def test_places_of_long_windows_survive_packing():
    position, low, high = np.array([70_000, 2**31 - 1]), np.array([70_000 - 65_535, 2**31 - 1 - 1024]), np.array([70_000 - 1024, 2**31 - 1])
    w = repeats.pack(position, low, high)
    assert (w >= 0).all() and all((a == b).all() for a, b in zip(repeats.unpack(w), (position, low, high), strict=True))


def test_windows_over_2047_words_are_found(spark):
    rng = random.Random(4)
    word = lambda c: f"{c}{rng.randrange(10**6)}{c}"
    passage = [word("w") for _ in range(2500)]
    docs = [(i, " ".join([word(c) for _ in range(1500)] + passage + [word(c) for _ in range(1500)])) for i, c in enumerate("ab")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["id"]: (r["n_removed"], r["kept_text"]) for r in substring_dedup.substring_dedup(spark, frame, window=2400).collect()}
    words = docs[1][1].split()
    assert got == {0: (0, docs[0][1]), 1: (2500, " ".join(words[:1500] + words[4000:]))}
    raw = [t.encode() for _, t in docs]
    first = " ".join(passage).encode()
    got = {r["id"]: (r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(spark, frame, window=5000).collect()}
    assert got == {i: (len(first) + 2, b[: b.index(first) - 1] + b[b.index(first) + len(first) + 1 :]) for i, b in enumerate(raw)}


def test_too_long_windows_are_refused(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    for dedup in (substring_dedup.substring_dedup, suffix_dedup.suffix_dedup):
        with pytest.raises(ValueError, match="too long"):
            dedup(spark, frame, window=200_000)


@pytest.mark.parametrize(("seed", "window"), [(1, 12), (2, 20), (3, 31)])
def test_hot_groups_of_suffixes_match_brute_force(spark, monkeypatch, seed, window):
    monkeypatch.setattr(suffix_dedup, "PIECE_SUFFIXES", 3)
    monkeypatch.setattr(suffix_dedup, "HOT_SUFFIXES", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = random_docs(seed, 50)
        assert run(spark, docs, window) == brute(docs, window)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_hot_group_is_not_held_whole(monkeypatch):
    solved = []
    reach = suffix_dedup.repeated_reach
    monkeypatch.setattr(suffix_dedup, "repeated_reach", lambda heads, *rest: solved.append(len(heads)) or reach(heads, *rest))
    rng = random.Random(5)
    some = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    gram = b"m" * 20
    rows = [(b"a" * 10, some(30), some(20), i, 500) for i in range(30)] + [(gram[:10], gram[10:] + some(20), some(20), 100 + i, 500) for i in range(3000)] + [(b"z" * 10, some(30), some(20), 9000 + i, 500) for i in range(30)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 50], strict=True), (pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lead", "head", "tail", "j", "place"]) for k in range(0, len(rows), 50)]
    got = pa.Table.from_batches(suffix_dedup.pieces(iter(batches), 40, 20, 100, 200))
    assert max(solved) <= 250 and sum(solved) == 60
    windows = got.filter(pa.compute.is_valid(got["a"]))
    assert set(windows["j"].to_pylist()) == set(range(100, 3100))


def test_workers_hold_no_more_than_one_benchmark_block(spark):
    items = spark.createDataFrame([(i, f"item {i} has words of its own") for i in range(40)], "item_id long, text string")
    blocks = decontaminate.test_blocks(spark, items, "item_id", "text", 10, 200)
    assert len(blocks) > 1
    assert sorted(n for test in decontaminate.one_by_one(blocks) for n in test.names) == sorted(map(str, range(40)))
    assert not any(hasattr(b, "_value") for b in blocks)
