import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import suffix_dedup as op


def brute(docs, window):
    texts = [(d, (t or "").encode()) for d, t in docs]
    seen = Counter(b[s : s + window] for _, b in texts for s in range(len(b) - window + 1))
    out = []
    for d, b in texts:
        gone = bytearray(len(b))
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = b"\1" * window
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, window):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, lows string").repartition(3)
    got = op.suffix_dedup(spark, frame, window=window)
    return sorted((tuple(r) for r in got.select("id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=repr)


def random_docs(seed, n):
    rng = random.Random(seed)
    letters = "abcé\n"[: 2 + seed]
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 90))) for _ in range(6)]
    docs = []
    for i in range(n):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(t))
            t = t[:k] + rng.choice(passages) + t[k:]
        docs.append((i, t))
    near = docs[1][1] + passages[0] + passages[1]
    docs += [(500 + i, near[:i] + "#" + near[i + 1 :]) for i in range(0, len(near), 9)]
    return docs + [docs[3], (docs[4][0], docs[5][1]), (None, docs[6][1]), (None, None), (900, ""), (902, " \t "), (903, "z" * 300)]


@pytest.mark.parametrize(("seed", "window"), [(1, 12), (2, 20), (3, 31), (2, 2)])
def test_random_documents_match_brute_force(spark, seed, window):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = random_docs(seed, 50)
        assert run(spark, docs, window) == brute(docs, window)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_order_and_common_prefix():
    rng = random.Random(0)
    rows = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))).encode() for _ in range(300)]
    matrix = op._words(rows, 30)
    order, shared = op.classes(matrix)
    padded = [r.ljust(32, b"\0") for r in rows]
    assert [padded[i] for i in order] == sorted(padded)
    for a, b, n in zip(order, order[1:], shared[1:], strict=False):
        x, y = np.frombuffer(padded[a], np.uint8), np.frombuffer(padded[b], np.uint8)
        assert n == (32 if (x == y).all() else int((x != y).argmax()))


def test_empty_table(spark):
    assert op.suffix_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op.query(spark, sf_dir).collect()), key=repr) == brute(docs, 400)
