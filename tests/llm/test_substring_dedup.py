import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratalode.llm import substring_dedup as op


def brute(docs, window):
    """docs: (id, text) rows; ids null last, then text, then any order of equal rows."""
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    seen, out = set(), []
    for d, t in order:
        ws = (t or "").encode().split()
        gone = set()
        for s in range(len(ws) - window + 1):
            w = tuple(ws[s : s + window])
            if w in seen:
                gone |= set(range(s, s + window))
            seen.add(w)
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def run(spark, docs, window):
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, j string").repartition(3)
    got = op.substring_dedup(spark, frame, window=window)
    return sorted((tuple(r) for r in got.select("id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()), key=repr)


def random_docs(seed, n, vocabulary, odd=True):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz"[:vocabulary]) + rng.choice(["", "é", ","])
    passages = [[word() for _ in range(rng.randint(3, 40))] for _ in range(5)]
    docs = []
    for i in range(n):
        ws = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(ws))
            ws[k:k] = rng.choice(passages)
        docs.append((i, rng.choice([" ", "\n", "  "]).join(ws)))
    if odd:
        docs += [docs[3], (docs[4][0], docs[5][1]), (None, docs[6][1]), (None, None), (900, ""), (901, docs[7][1]), (902, " \t "), (903, "z " * 300)]
    return docs


@pytest.mark.parametrize(("seed", "window", "odd"), [(1, 6, True), (2, 7, False), (3, 20, True), (4, 2, False)])
def test_random_documents_match_brute_force(spark, seed, window, odd):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = random_docs(seed, 60, 2 + 4 * seed, odd)
        assert run(spark, docs, window) == brute(docs, window)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_table(spark):
    assert run(spark, [(1, None)], 20) == brute([(1, None)], 20)
    assert op.substring_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op.query(spark, sf_dir).collect()), key=repr) == brute(docs, 20)


def test_levels_at_most_double():
    assert op.levels(20) == [5, 10, 20] and op.levels(2) == [2] and op.levels(7) == [4, 7]
    for window in range(1, 300):
        lengths = op.levels(window)
        assert lengths[-1] == window and lengths[0] <= op.FIRST_LEVEL
        assert all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:], strict=False))


def test_near_copies_and_self_repeats_match_brute_force(spark):
    """Long repeated stretches that start and end anywhere, within a document and across many, copies among them."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(400)}"
    base = [word() for _ in range(400)]
    docs = []
    for i in range(40):
        ws = list(base)
        for _ in range(rng.randint(0, 6)):
            ws[rng.randrange(len(ws))] = word()
        if i % 3 == 0:
            ws = ws[rng.randrange(50) :] + ws[: rng.randrange(200)]
        docs.append((i, " ".join(ws)))
    docs += [(100 + i, docs[i][1]) for i in range(10)]
    assert run(spark, docs, 20) == brute(docs, 20)
