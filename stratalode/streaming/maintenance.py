"""Streaming forms of the incremental operators. Each is tested against its batch answer over the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import sync


def reconcile_stream(listings: DataFrame, read_tracked, write, checkpoint: str):
    """Each micro-batch is one whole listing: reconcile it with what is tracked then, and hand the outcomes on."""

    def step(batch: DataFrame, number: int) -> None:
        write(sync.reconcile(batch, read_tracked()), number)

    return listings.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def versioned_index(spark: SparkSession, changes: DataFrame, path: str, model: str, checkpoint: str):
    """Apply change micro-batches to an index kept as numbered versions; readers of a version see it whole.

    A batch that is run again after a failure writes the same version from the same predecessor.
    """

    def step(batch: DataFrame, number: int) -> None:
        empty = spark.createDataFrame([], "document_id long, chunk_id long, value double")
        before = spark.read.parquet(f"{path}/v{number - 1}") if number else empty
        sync.applied(before, batch, model).write.mode("overwrite").parquet(f"{path}/v{number}")

    return changes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def debounced(events: DataFrame, *, key: str, ts: str = "ts", quiet: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """One row per burst of a key's events: bursts end after a quiet time; events later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(key, F.session_window(ts, quiet)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def log_tail(entries: DataFrame, *, after: int | None = None, level: str = "debug", subsystem: str | None = None) -> DataFrame:
    """Log entries after a cursor, at or above a level, of a subsystem; works on batches and streams alike."""
    ranks = {"debug": 0, "info": 1, "warn": 2, "error": 3}
    rank = F.lit(None).cast("int")
    for name, r in ranks.items():
        rank = F.when(F.col("level") == name, r).otherwise(rank)
    out = entries if after is None else entries.filter(F.col("id") > after)
    out = out.filter(rank >= ranks[level])
    return out if subsystem is None else out.filter(F.col("subsystem") == subsystem)


_STATE = "owner string, document string"
_OUT = "content_hash string, path string, state string, message string"


def claim_contents(uploads: DataFrame) -> DataFrame:
    """Ownership of contents over time, keyed by content hash: the first path owns it, later ones are duplicates, a path that replaces the owner takes over.

    Uploads: (content_hash, path, replaces, seq).
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        owner = state.get[0] if state.exists else None
        rows = []
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if owner is None or owner == row.path or (row.replaces is not None and row.replaces == owner):
                owner = row.path
                rows.append((key[0], row.path, "synced", None))
            else:
                rows.append((key[0], row.path, "duplicate", owner))
        state.update((owner, key[0]))
        yield pd.DataFrame(rows, columns=["content_hash", "path", "state", "message"])

    return uploads.groupBy("content_hash").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
