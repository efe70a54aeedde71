"""Exact vector retrieval.

A scan scores Arrow batches with one matrix product each and passes on a batch's own best rows only, so what reaches
the final top-k is at most k rows a batch; contents are joined to the winners afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "stand-in/64"
#: Rows that a plan may prove at most for a side to be broadcast.
BROADCAST_ROWS = 100_000


def searchable(chunks: DataFrame, model: str) -> DataFrame:
    """Embedded chunks of one model, spreadsheets of plain text left out."""
    out = chunks.filter(F.col("embedding").isNotNull() & (F.col("embedding_model") == model))
    return out.filter(F.col("source_type") != "CSV") if "source_type" in chunks.columns else out


def stale(chunks: DataFrame, model: str, *, local_only: bool = True) -> DataFrame:
    """Chunks whose vector is of another model or missing."""
    out = chunks.filter(~F.col("embedding_model").eqNullSafe(F.lit(model)))
    if "source_type" in chunks.columns:
        out = out.filter(F.col("source_type") != "CSV")
    return out if local_only or "local_only" not in chunks.columns else out.filter(~F.col("local_only"))


def top_vectors(vectors: DataFrame, query: list[float], *, top_k: int, id_col: str = "chunk_id", extra: tuple[str, ...] = ()) -> DataFrame:
    """(id, *extra, score) of the best rows by dot product; ties: smaller id. Rows of another dimension are left out."""
    if top_k <= 0 or not query:
        return vectors.select(id_col, *extra).withColumn("score", F.lit(0.0)).limit(0)
    wanted = np.asarray(query, np.float32).astype(np.float64)
    picked = vectors.select(F.col(id_col), *extra, "embedding").filter(F.size("embedding") == len(query))
    schema = picked.drop("embedding").withColumn("score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            scores = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64) @ wanted
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            best = np.lexsort((ids, -scores))[:top_k]
            rows = batch.take(pa.array(best))
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(scores[best])], names=schema.names)

    return picked.mapInArrow(run, schema).orderBy(F.desc("score"), id_col).limit(top_k)


def vector_of(vectors: DataFrame, key, id_col: str = "chunk_id") -> list[float]:
    """One stored vector, as a query."""
    row = vectors.filter(F.col(id_col) == key).select("embedding").first()
    return list(row[0]) if row and row[0] is not None else []


def search_semantic(chunks: DataFrame, query: list[float], *, model: str = MODEL, top_k: int = 5, id_col: str = "chunk_id", documents: list | None = None) -> DataFrame:
    found = searchable(chunks, model)
    if documents:
        found = found.filter(F.col("document_id").isin(list(dict.fromkeys(documents))))
    return top_vectors(found, query, top_k=top_k, id_col=id_col, extra=("document_id",))


def bounded(frame: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``frame`` with a broadcast hint if its plan proves that it has at most ``most`` rows, else as it is."""
    rows = frame._jdf.queryExecution().optimizedPlan().maxRows()
    return F.broadcast(frame) if rows.isDefined() and rows.get() <= most else frame


def with_content(winners: DataFrame, chunks: DataFrame, id_col: str = "chunk_id") -> DataFrame:
    """Late materialisation: contents of the winners, which are broadcast where their own limit bounds them."""
    return chunks.join(bounded(winners), id_col)


def reembedded(chunks: DataFrame, fresh: DataFrame, model: str, *, id_col: str = "chunk_id") -> DataFrame:
    """``chunks`` with new vectors (id, content_hash, embedding) put where the content is still what was embedded.

    A chunk that changed meanwhile keeps its old state and stays stale.
    """
    new = fresh.select(id_col, F.col("content_hash").alias("_h"), F.col("embedding").alias("_e"))
    same = F.col("_h") == F.sha2("content", 256)
    rows = chunks.join(new, id_col, "left")
    return rows.withColumns({"embedding": F.when(same, F.col("_e")).otherwise(F.col("embedding")), "embedding_model": F.when(same, F.lit(model)).otherwise(F.col("embedding_model"))}).select(*chunks.columns)


def index_counts(chunks: DataFrame, model: str) -> DataFrame:
    """How many chunks have a vector of the model, and how many wait for one."""
    ready = F.col("embedding").isNotNull() & F.col("embedding_model").eqNullSafe(F.lit(model))
    return chunks.agg(F.count_if(ready).alias("ready"), F.count_if(~ready).alias("stale"))
