import hashlib
import re

import pytest
from pyspark.sql import functions as F

from stratalode.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, window=10):
    tokens = {i: WORD.findall((t or "").translate(FOLD)) for i, t in items}
    spots = {}
    for i, ws in tokens.items():
        size = min(window, len(ws))
        for k in range(len(ws) - size + 1 if ws else 0):
            spots.setdefault(tuple(ws[k : k + size]), set()).add(str(i))
    sizes = {len(w) for w in spots}
    out = []
    for d, t in docs:
        ws = WORD.findall((t or "").translate(FOLD))
        hit, found = set(), set()
        for size in sizes:
            for k in range(len(ws) - size + 1):
                if names := spots.get(tuple(ws[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= names
        out.append((d, len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


ITEM = "The quick brown fox jumps over the lazy dog while twelve boxing wizards leap"
CASES = [
    (1, None), (2, ""), (3, "   \n"), (4, ITEM), (4, ITEM), (5, f"intro words {ITEM.upper()} trailing"), (6, "quick brown fox jumps over the lazy dog while twelve boxing wizards leap " * 3),
    (7, "short item"), (8, "a Short, ITEM b"), (9, "short"), (10, "x " * 50_000 + ITEM), (11, "the quick brown fox jumps over the lazy dog while"), (12, "Été short été"), (None, "short item"), (13, "one"), (14, "the quick brown fox jumps over the lazy dog"),
]
ITEMS = [(1, ITEM), (2, "short item"), (10, "short item"), (3, None), (4, ""), (5, "été"), (6, "...")]


@pytest.mark.parametrize("block_bytes", [op.BLOCK_BYTES, 40])
def test_small_cases_match_brute_force(spark, block_bytes):
    docs = spark.createDataFrame([(d, t, 1) for d, t in CASES], "doc_id long, text string, n_words int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = op.contamination(spark, docs, items, block_bytes=block_bytes).select("doc_id", "n_words", "n_hit", F.size("items"), "items_sha256", F.col("n_hit") > 0)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(CASES, ITEMS)
    kept = op.remove_contaminated(spark, docs, items, block_bytes=block_bytes)
    assert kept.schema == docs.schema
    assert sorted((r[0], r[1]) for r in kept.collect()) == sorted((d, t) for d, t in CASES if not next(x for x in brute([(d, t)], ITEMS))[5])


def test_longest_match_and_location(spark):
    docs = spark.createDataFrame([(1, f"zero {ITEM} end")], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    row = op.contamination(spark, docs, items).first()
    assert (row["longest_match"], row["match_item"], row["match_item_word"], row["match_doc_word"]) == (14, "1", 0, 1)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    assert op.contamination(spark, docs, items).count() == 0
    assert op.contamination(spark, some, items).first()["n_hit"] == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = op.query(spark, sf_dir).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)
