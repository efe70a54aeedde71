import math
from collections import defaultdict

import pytest

from stratalode.llm import mixing as op


def test_exponent_meets_entropy_and_limit():
    shares = [0.7, 0.2, 0.06, 0.04]
    low, high = op.entropy(op.tempered(shares, 1.0)), math.log(4)
    want = (low + high) / 2
    assert abs(op.entropy(op.tempered(shares, op.solve_exponent(shares, target_entropy=want))) - want) < 1e-9
    a = op.solve_exponent(shares, repetition_limit=2.0)
    assert abs(op.repetition(shares, op.tempered(shares, a)) - 2.0) < 1e-9
    assert op.solve_exponent(shares, target_entropy=9.0) == 0.0 and op.solve_exponent(shares, target_entropy=0.1) == 1.0
    assert op.solve_exponent(shares, repetition_limit=1e9) == 0.0 and op.solve_exponent([1.0], repetition_limit=2.0) == 0.0
    with pytest.raises(ValueError, match="entropy or"):
        op.solve_exponent(shares)


def brute(docs, hashes, block_tokens, limit):
    """docs: (key, source, tokens); hashes: the engine's hash of (seed, key), (seed, epoch, block) and (seed, epoch, key)."""
    by = defaultdict(list)
    for k, s, n in docs:
        by[s].append((k, n))
    tokens = {s: sum(n for _, n in x) for s, x in by.items()}
    _, weights, budgets = op.plan(tokens, repetition_limit=limit)
    out = []
    for s, x in by.items():
        blocks = -(-tokens[s] // block_tokens)
        home = {k: hashes[17, k] % blocks for k, _ in x}
        at, epoch = 0, 0
        while at < budgets[s]:
            for b in sorted(set(home.values()), key=lambda b: (hashes[17, epoch, b], b)):
                for k, n in sorted((r for r in x if home[r[0]] == b), key=lambda r: (hashes[17, epoch, r[0]], r[0])):
                    if at < budgets[s]:
                        out.append((k, s, n, epoch, b, at))
                    at += n
            epoch += 1
    return sorted(out, key=repr), weights, budgets


def engine_hashes(spark, keys, epochs, blocks):
    from pyspark.sql import functions as F

    seed, out = F.lit(17), {}
    one = spark.createDataFrame([(k,) for k in keys], "k long").select("k", F.xxhash64(seed, "k").alias("h"))
    out |= {(17, r["k"]): r["h"] for r in one.collect()}
    numbers = sorted({*keys, *range(blocks)})
    two = spark.createDataFrame([(e, k) for e in range(epochs) for k in numbers], "e long, k long").select("e", "k", F.xxhash64(seed, "e", "k").alias("h"))
    return out | {(17, r["e"], r["k"]): r["h"] for r in two.collect()}


@pytest.mark.parametrize("block_tokens", [40, 10_000])
def test_placements_match_brute_force(spark, block_tokens):
    docs = [(i, ("a" if i % 3 else "b") if i % 10 else None, "w " * (i % 7)) for i in range(120)] + [(500 + i, "tiny", "one two") for i in range(4)]
    frame = spark.createDataFrame([(*d, 3) for d in docs], "doc_id long, source string, text string, epoch int").repartition(3)
    got = op.placements(spark, frame, key_col="doc_id", block_tokens=block_tokens, repetition_limit=3.0)
    rows = [(r["key"], op.NO_SOURCE if r["source"] is None else r["source"], r["n_tokens"], r["epoch"], r["block"], r["position"]) for r in got.collect()]
    light = [(d, op.NO_SOURCE if s is None else s, max(1, len(t.split()))) for d, s, t in docs]
    want, weights, budgets = brute(light, engine_hashes(spark, [d for d, _, _ in light], 8, 40), block_tokens, 3.0)
    assert sorted(rows, key=repr) == want
    assert {r[0] for r in rows} == {d for d, _, _ in light}
    used = defaultdict(int)
    for _, s, n, *_ in rows:
        used[s] += n
    assert all(budgets[s] <= used[s] < budgets[s] + 10 for s in budgets)
    assert max(used[s] / sum(n for _, x, n in light if x == s) for s in used) < 3.3


def test_mix_keeps_columns_and_rows(spark):
    docs = [(1, "a", "x y z", "q"), (1, "a", "x y z", "q"), (None, None, None, "q"), (2, "b", "", "q")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, text string, epoch string")
    out = op.mix(spark, frame, repetition_limit=2.0)
    assert out.schema == frame.schema
    rows = [tuple(r) for r in out.collect()]
    assert set(rows) == set(docs) and rows.count(docs[0]) >= 2


def test_empty_table(spark):
    assert op.mix(spark, spark.createDataFrame([], "doc_id long, source string, text string"), repetition_limit=2.0).count() == 0


def test_query_uses_every_document(spark, sf_dir):
    got = op.query(spark, sf_dir)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    keys = sorted((r["mix_key"], r["source"]) for r in got.collect())
    half = keys[: len(keys) // 2]
    assert len({s for _, s in half}) == len({s for _, s in keys})
