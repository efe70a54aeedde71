import random

import numpy as np
import pytest

from stratalode.llm import jaccard_join as op

FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(t, n):
    ws = (t or "").translate(FOLD).encode().split()
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if len(ws) >= n else ({tuple(ws)} if ws else set())


def brute(docs, n, percent):
    order = sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [shingles(t, n) for _, t in order]
    parent = list(range(len(order)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        shared = {}
        for x in s:
            for k in index[x]:
                if k < i:
                    shared[k] = shared.get(k, 0) + 1
        for k, c in shared.items():
            if 100 * c >= percent * (len(s) + len(sets[k]) - c):
                a, b = find(i), find(k)
                parent[max(a, b)] = min(a, b)
    return sorted(((d, len(sets[i]), order[find(i)][0]) for i, (d, _) in enumerate(order)), key=repr)


def run(spark, docs, n=4, percent=85):
    frame = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, lead int").repartition(3)
    return sorted((tuple(r) for r in op.jaccard_join(spark, frame, n=n, percent=percent).collect()), key=repr)


def near_docs(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = []
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        for k in range(rng.randint(1, 12)):
            ws = list(base)
            for _ in range(rng.randint(0, max(1, len(ws) // 25))):
                ws[rng.randrange(len(ws))] = rng.choice(vocabulary)
            docs.append((group * 100 + k, rng.choice([" ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for w in ws)))
    rng.shuffle(docs)
    return docs + [docs[3], (docs[4][0], docs[5][1]), (None, docs[6][1]), (None, None), (9000, ""), (9001, " \n"), (9002, "one two"), (9003, "ONE  two"), (9004, "a b c d " * 500)]


@pytest.mark.parametrize(("seed", "n", "percent"), [(1, 4, 85), (2, 5, 80), (3, 1, 60)])
def test_random_groups_match_brute_force(spark, seed, n, percent):
    docs = near_docs(seed)
    assert run(spark, docs, n, percent) == brute(docs, n, percent)


def test_a_prefix_never_misses_a_link():
    rng = np.random.default_rng(0)
    levels = rng.integers(0, 12, op.SKETCH).astype(np.uint8)
    for _ in range(200):
        x = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        y = np.unique(np.concatenate([rng.choice(x, 55, replace=False), rng.integers(0, 1 << 63, 3, dtype=np.uint64)]))
        tokens, lengths, choice = op.prefixes(np.concatenate([x, y]), np.array([0, len(x), len(x) + len(y)]), levels, 80)
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 80 * (len(x) + len(y) - shared):
            assert len(np.intersect1d(tokens[: lengths[0]], tokens[lengths[0] :])) >= choice.min()


def test_drop_near_duplicates_keeps_columns_and_first_rows(spark):
    docs = near_docs(4)
    frame = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, j string")
    kept = op.drop_near_duplicates(spark, frame)
    assert kept.schema == frame.schema
    leads = {r[2] for r in brute(docs, 5, 80)}
    assert {r["doc_id"] for r in kept.collect()} >= leads and kept.count() < len(docs)


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    rng = np.random.default_rng(1)
    sets = [np.zeros(0, np.uint64)] + [np.unique(rng.integers(0, 1 << 63, rng.integers(0, 300), dtype=np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate([x[: rng.integers(0, len(x) + 1)], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for x in sets]
    words = np.stack(op.parities(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(x) for x in sets])]))).view(np.uint64)
    for a in range(len(sets)):
        for b in range(a):
            assert np.bitwise_count(words[:, a] ^ words[:, b]).sum() <= len(np.setxor1d(sets[a], sets[b]))


def test_parts_of_a_hot_document_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(op, "PART_PAIRS", 2)
    docs = near_docs(5)
    assert run(spark, docs) == brute(docs, 4, 85)


def test_a_column_named_like_the_key_stays(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g", "keep1"), (2, "a b c d e f g", "keep2"), (3, None, "keep3")], "doc_id long, text string, _j string")
    assert sorted(r["_j"] for r in op.drop_near_duplicates(spark, frame).collect()) == ["keep1", "keep3"]


def test_empty_table(spark):
    assert op.jaccard_join(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in op.query(spark, sf_dir).collect()), key=repr) == brute(docs, 4, 85)
