import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratalode.llm import textvec as tv
from stratalode.llm import token_store as op

pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")

ODD = ["", None, "  \n ", "Hello, World!", "don't they've I'M 's 't x's", "a1b2 33 foo_bar _x_ --y", "É é é ß ſ ﬁ İ", "a b c\x1c\x85d", "<|endoftext|> x<|startoftext|>y", "日本語 テキスト 🙂🙂", "of%%% *** | !! THE!!", "x" * 3000, "word " * 9000, "ñandú, ÀÖ× ÷a ÿ", "(a) [b] `c` ~d~ {e}"]


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_str(op.tokenizer_spec())


def expected(docs):
    t, at, out = tokenizer(), 0, []
    for d, text in sorted(docs, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    return out


def test_words_encode_as_whole_texts_do():
    import pyarrow as pa

    coder, t = op.PieceEncoder(op.tokenizer_spec()), tokenizer()
    assert not coder.whole
    for _ in range(2):
        ids, offsets = coder.encode(tv.column_texts(pa.array(ODD, pa.string())), 1)
        for i, text in enumerate(ODD):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1], text


def test_hash_clashes_and_small_caches_change_nothing(monkeypatch):
    import pyarrow as pa

    t, real = tokenizer(), tv.span_hashes
    monkeypatch.setattr(op, "CACHE_PIECES", 3)
    monkeypatch.setattr(tv, "span_hashes", lambda data, s, e, seed=0: real(data, s, e, seed) % np.uint64(2) if seed == 0 else real(data, s, e, seed))
    coder = op.PieceEncoder(op.tokenizer_spec())
    for _ in range(2):
        ids, offsets = coder.encode(tv.column_texts(pa.array(ODD[:11], pa.string())), 1)
        for i, text in enumerate(ODD[:11]):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1], text


def test_long_texts_are_cut_at_white_space(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(tv, "SLICE_BYTES", 50)
    coder, t = op.PieceEncoder(op.tokenizer_spec()), tokenizer()
    for text in ("some words, it's 12 Éa <|endoftext|> " * 40, "x" * 400 + " y", "z" * 500):
        parts = list(tv.cut_at(tv.column_texts(pa.array([text])).data, tv.SPACE, 50))
        assert b"".join(p.text(0) for p in parts).decode() == text
        assert coder.encode(tv.column_texts(pa.array([text])), 1)[0].tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_other_tokenizers_get_whole_texts():
    import json

    spec = json.loads(op.tokenizer_spec())
    assert op.piecewise(json.dumps(spec))
    for change in ({"normalizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "a b<"}]}):
        assert not op.piecewise(json.dumps({**spec, **change}))
    spec["model"]["end_of_word_suffix"] = ""
    assert not op.piecewise(json.dumps(spec))


def test_round_trip(spark, tmp_path):
    docs = list(enumerate(ODD)) + [(3, "Hello, World!"), (3, "Hello"), (None, "null id"), (None, None)] + [(100 + i, "the same passage " * 400 + str(i)) for i in range(5)]
    frame = spark.createDataFrame([(d, t, 0) for d, t in docs], "doc_id long, text string, start int").repartition(3)
    path = str(tmp_path / "store")
    op.write_store(spark, frame, path, op.tokenizer_spec(), end_id=1)
    want = expected(docs)
    got = sorted((tuple(r) for r in op.verified_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == [x[:4] for x in want]
    assert [r["ids"] for r in op.read_ids(spark, path).orderBy("start").collect()] == [x[4] for x in want]
    chunks = spark.read.parquet(f"{path}/pieces").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    assert spark.read.parquet(f"{path}/manifest").agg(F.sum("tokens"), F.sum("documents")).first() == (sum(x[2] for x in want), len(want))


@pytest.mark.parametrize("broken", ["chunk", "lost chunk", "lost document", "lost part", "manifest"])
def test_damage_is_found(spark, tmp_path, broken):
    frame = spark.createDataFrame([(i, f"some words here {i} " * (1 + i % 3)) for i in range(40)], "doc_id long, text string")
    path, other = str(tmp_path / "store"), str(tmp_path / "other")
    op.write_store(spark, frame, path, op.tokenizer_spec(), end_id=1)
    pieces, recipes, manifest = (spark.read.parquet(f"{path}/{x}") for x in ("pieces", "recipes", "manifest"))
    if broken == "chunk":
        pieces = pieces.withColumn("data", F.when(F.col("kind") == "chunk", F.overlay("data", F.lit(b"\x09\x09"), F.lit(1))))
    elif broken == "lost chunk":
        pieces = pieces.filter(f"kind != 'chunk' or key != x'{bytes(recipes.first()['digests'][0]).hex()}'")
    elif broken == "lost document":
        recipes = recipes.filter("j != 7")
    elif broken == "lost part":
        recipes, manifest = recipes.filter("part != 0"), manifest.filter("part != 0")
    else:
        manifest = manifest.withColumn("tokens", F.col("tokens") + 1)
    pieces.write.partitionBy("kind").parquet(f"{other}/pieces")
    recipes.write.parquet(f"{other}/recipes")
    manifest.write.parquet(f"{other}/manifest")
    spark.read.parquet(f"{path}/store").write.parquet(f"{other}/store")
    with pytest.raises(Exception, match="not match"):
        op.verified_documents(spark, other).collect()


def test_crc_of_parts():
    parts = [b"abc", b"", b"x" * 1000, b"tail"]
    after = np.array([sum(map(len, parts[i + 1 :])) for i in range(4)])
    crcs = np.array([zlib.crc32(p) for p in parts])
    assert int(np.bitwise_xor.reduce(op.crc_shift(crcs, after))) == zlib.crc32(b"".join(parts))


def test_equal_passages_give_equal_chunks():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 40_000, 20_000).astype(np.uint32)
    digests = []
    for lead in (0, 17, 301):
        ids = np.concatenate([rng.integers(0, 40_000, lead).astype(np.uint32), passage])
        ends = op.cuts(ids, np.array([0, len(ids)]))
        assert (np.diff(np.concatenate([[0], ends])) <= op.GREATEST).all() and ends[-1] == len(ids)
        digests.append({hashlib.md5(ids[a:b].tobytes()).digest() for a, b in zip([0, *ends], ends, strict=False)})
    assert len(digests[0] & digests[1] & digests[2]) >= 0.8 * len(digests[0])


def test_empty_table(spark):
    assert op.encode_documents(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_on_whole_table(spark, sf_dir):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in op.query(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda r: r[1])
    assert got == [x[:4] for x in expected(docs)]
