"""Zero-shot tagging: how much closer a document's best chunks are to a tag than to everyday topics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Topics that a tag is measured against; fixed values.
BACKGROUND = (
    "architecture", "astronomy", "board games", "cars", "chemistry", "cooking", "dance", "fashion", "finance", "fishing", "furniture", "gardening",
    "jewelry", "marketing", "movies", "music", "photography", "poetry", "real estate", "religion", "sports", "travel", "video games", "weather",
)
ABOVE, MOST_TAGS, TOP_CHUNKS = 0.08, 5, 3


def label_text(tag: str) -> str:
    """What is embedded for a tag: dashes and underscores are spaces."""
    return " ".join(tag.replace("-", " ").replace("_", " ").split())


def best_scores(vectors: DataFrame, labels: dict[str, list[float]], *, document: str = "document_id", best: int = TOP_CHUNKS) -> DataFrame:
    """(document, label, score): mean of the best chunks' dot products.

    A task scores a batch against all labels in one matrix product and hands on a document's best rows only.
    """
    names = list(labels)
    matrix = np.array([labels[n] for n in names], np.float32).astype(np.float64).T
    kind = vectors.schema[document].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not names:
                continue
            scores = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64) @ matrix
            key = batch.column(0).to_numpy(zero_copy_only=False)
            for d in np.unique(key):
                rows = np.sort(scores[key == d], axis=0)[::-1][:best]
                n = rows.shape[0]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d, n * len(names)), batch.schema[0].type), pa.array(names * n), pa.array(rows.reshape(-1))], names=[document, "label", "score"])

    rows = vectors.select(document, "embedding").filter(F.col("embedding").isNotNull()).mapInArrow(run, f"{document} {kind}, label string, score double")
    top = Window.partitionBy(document, "label").orderBy(F.desc("score"))
    return rows.withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= best).groupBy(document, "label").agg(F.avg("score").alias("score"))


def autotag(vectors: DataFrame, tags: dict[str, list[float]], topics: dict[str, list[float]], assigned: DataFrame | None = None, *, document: str = "document_id", above: float = ABOVE, most: int = MOST_TAGS) -> DataFrame:
    """(document, tag, score, place): the best tags above the median topic; tags already assigned go after the cut to ``most``."""
    scores = best_scores(vectors, {f"t:{k}": v for k, v in tags.items()} | {f"b:{k}": v for k, v in topics.items()}, document=document)
    floor = scores.filter(F.col("label").startswith("b:")).groupBy(document).agg(F.median("score").alias("floor"))
    rated = scores.filter(F.col("label").startswith("t:")).select(document, F.substring("label", 3, 1000).alias("tag"), "score").join(floor, document)
    order = Window.partitionBy(document).orderBy(F.desc("score"), "tag")
    picked = rated.filter(F.col("score") - F.col("floor") >= above).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    return picked if assigned is None else picked.join(assigned, [document, "tag"], "left_anti")


def totals(documents: DataFrame, vectors: DataFrame, added: DataFrame, *, document: str = "document_id") -> DataFrame:
    """Tags applied, documents tagged, unchanged, and skipped for want of vectors."""
    has = vectors.select(document).distinct().withColumn("_v", F.lit(True))
    got = added.groupBy(document).agg(F.count("*").alias("_n"))
    all_ = documents.select(document).distinct().join(has, document, "left").join(got, document, "left")
    return all_.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("applied"), F.count_if(F.col("_n") > 0).alias("tagged"), F.count_if(F.col("_v") & F.col("_n").isNull()).alias("unchanged"), F.count_if(F.col("_v").isNull()).alias("skipped"))
