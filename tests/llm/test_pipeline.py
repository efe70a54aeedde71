"""The pipeline against brute force over the same documents, stage by stage."""

import numpy as np
import pytest

import corpus_pipeline as pipeline

from .test_decontaminate import brute as contaminated
from .test_jaccard_join import brute as classes
from .test_quality_rules import brute_row
from .test_token_store import expected


def test_stages_match_brute_force(spark, sf_dir):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {d for d, t in rows.items() if brute_row(d, t)[7]}
    frame = pipeline.keys.stored(spark, pipeline.STAGES[0][1](spark, docs, sf_dir))
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == want
    want = {lead for _, _, lead in classes([(d, rows[d]) for d in want], 5, 80)}
    frame = pipeline.keys.stored(spark, pipeline.STAGES[1][1](spark, frame, sf_dir))
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == want
    want = {x[0] for x in contaminated([(d, rows[d]) for d in want], items) if not x[5]}
    frame = pipeline.keys.stored(spark, pipeline.STAGES[2][1](spark, frame, sf_dir))
    assert frame.columns == docs.columns and {r["doc_id"] for r in frame.collect()} == want
    frame = pipeline.keys.stored(spark, pipeline.STAGES[3][1](spark, frame, sf_dir))
    mixed = [(r["doc_id"], r["text"]) for r in frame.collect()]
    assert frame.columns == docs.columns and {d for d, _ in mixed} == want and len(mixed) < 2.5 * len(want)
    got = sorted((tuple(r) for r in pipeline.STAGES[4][1](spark, frame, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == [x[:4] for x in expected(mixed)]
    assert np.all(np.diff([r[0] for r in got]) >= 0)


def test_stage_names():
    assert len(pipeline.STAGES) == 5 and pipeline.ORACLE_SQL is None


GOOD = "the quick brown fox of the old house was seen by a man that walked to it with his dog and sat on the grass until the rain was over for good"


def odd_table(spark):
    long = " ".join(f"the word{i} of and a" for i in range(30_000))
    texts = [(1, GOOD, "a"), (1, GOOD, "a"), (2, GOOD + " again", None), (3, None, "a"), (4, "", "b"), (5, " \n ", "b"), (6, long, "b"), (None, GOOD + " and so the story of the fox goes on for a while in this very text", "b"), (7, "###" * 50, "b")]
    return spark.createDataFrame([(d, t, "en", s, len(t or ""), "mine", 5) for d, t, s in texts], "doc_id long, text string, lang string, source string, n_chars int, _j string, j int")


def test_every_stage_handles_odd_rows(spark, sf_dir):
    docs = odd_table(spark)
    for name, stage in pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            got = stage(spark, rows, sf_dir)
            if name != "token_ids":
                assert got.columns == docs.columns, name
                assert {(r["_j"], r["j"]) for r in got.collect()} <= {("mine", 5)}, name
    kept = pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in kept.collect()} <= {1, 2, 6, None}
    one = pipeline.STAGES[1][1](spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0) for r in one.collect()).count(1) == 1 and {3, 4, 5, 6, 7} <= {r["doc_id"] for r in one.collect()}
    assert pipeline.STAGES[2][1](spark, docs, sf_dir).count() == docs.count()
    mixed = pipeline.STAGES[3][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in docs.collect()} and mixed.count() >= docs.count()
    assert pipeline.STAGES[4][1](spark, docs, sf_dir).count() == docs.count()
    assert pipeline.STAGES[4][1](spark, docs.limit(0), sf_dir).count() == 0
