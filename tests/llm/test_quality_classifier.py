import zlib

import numpy as np
import pyarrow as pa

from stratalode.llm import quality_classifier as op
from stratalode.llm import textvec as tv


def test_margin_is_the_log_density_difference():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, len(op.NAMES))), rng.normal(1, 2, (200, len(op.NAMES)))])
    y = np.repeat([0.0, 1.0], [300, 200])
    model = op.Discriminant.fit(x, y)
    z = (x - model.center) / model.scale
    density = []
    for m, inverse in zip(model.means, model.inverse, strict=True):
        factor = np.linalg.inv(inverse)
        cov = factor @ factor.T
        d = z - m
        density.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1])
    diff = density[1] - density[0]
    assert np.allclose(model.margin(x), np.sign(diff) * np.log1p(np.abs(diff)))
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_statistics_do_not_depend_on_neighbours():
    texts = ["one two two three", "", "A|B! c\nc\nc", "x " * 50, "é", "one two two three"]
    whole = op.statistics(tv.column_texts(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], op.statistics(tv.column_texts(pa.array([t])))[0])


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "x " * 30_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, None), (3, 7), (None, 1)], "doc_id long, quality int")
    rows = op.quality_scores(spark, docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["score"] <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in op.quality_scores(spark, docs, none).collect()} == {0.5}
    assert op.quality_scores(spark, docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").collect()}
    rows = op.query(spark, sf_dir).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in held]) >= 0.85
