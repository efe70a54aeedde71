"""Transcripts: segments, speaker turns, and times of text positions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .chunking import sentence_windows


def normalized_segments(raw: DataFrame) -> DataFrame:
    """Whole milliseconds, ends not before starts, blank texts dropped; from (recording, pos, start_s, end_s, text)."""
    start = F.round(F.col("start_s") * 1000).cast("long")
    end = F.greatest(start, F.round(F.col("end_s") * 1000).cast("long"))
    return raw.select("recording", "pos", start.alias("start_ms"), end.alias("end_ms"), T.trimmed(F.col("text")).alias("text")).filter("text != ''")


def cue_ends(cues: DataFrame, *, by: str, order: str, start: str = "start_ms", duration: str = "duration_ms") -> DataFrame:
    """``end_ms`` of each cue: its duration, or without one the start of the next cue; never before its start."""
    nxt = F.lead(start).over(Window.partitionBy(by).orderBy(order))
    return cues.withColumn("end_ms", F.greatest(F.col(start), F.coalesce(F.col(start) + F.col(duration), nxt, F.col(start))))


def caption_track(tracks: DataFrame, *, by: str) -> DataFrame:
    """One track per video: English before others, made before generated, else the first listed."""
    order = Window.partitionBy(by).orderBy((~F.col("language").startswith("en")).cast("int"), F.col("generated").cast("int"), "pos")
    return tracks.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def speaker_turns(segments: DataFrame, *, by: str, order: str, speaker: str = "speaker") -> DataFrame:
    """``turn`` from 0: runs of neighbours with equal speakers, where two unknown speakers are equal."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col(speaker).eqNullSafe(F.lag(speaker).over(w))).cast("int"))
    return segments.withColumn("_c", change).withColumn("turn", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_c")


def turn_texts(segments: DataFrame, *, by: str, order: str, speaker: str = "speaker") -> DataFrame:
    """One row per turn: content joined by spaces, and the timeline of character ranges and times."""
    spoken = segments.withColumn("spoken", T.collapsed(F.col("text"))).filter("spoken != ''")
    turns = speaker_turns(spoken, by=by, order=order, speaker=speaker)
    w = Window.partitionBy(by, "turn").orderBy(order)
    start = F.coalesce(F.sum(F.char_length("spoken") + 1).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = turns.withColumn("char_start", start).withColumn("char_end", F.col("char_start") + F.char_length("spoken"))
    entry = F.struct(F.col(order).alias("o"), "spoken", "char_start", "char_end", "start_ms", "end_ms")
    g = placed.groupBy(by, "turn").agg(F.first(speaker).alias(speaker), F.array_sort(F.collect_list(entry)).alias("x"))
    timeline = F.transform("x", lambda e: F.struct(e["char_start"].alias("char_start"), e["char_end"].alias("char_end"), e["start_ms"].alias("start_ms"), e["end_ms"].alias("end_ms")))
    return g.select(by, "turn", speaker, F.array_join("x.spoken", " ").alias("content"), timeline.alias("timeline"))


def time_at(timeline: Column, at: Column) -> Column:
    """Time of a character position: interpolated inside an entry, the start of the next one between two, the last end after all."""
    reached = F.get(F.filter(timeline, lambda e: at < F.greatest(e["char_end"], e["char_start"] + 1)), F.lit(0))
    share = (at - reached["char_start"]) / F.greatest(reached["char_end"] - reached["char_start"], F.lit(1))
    inside = F.floor(reached["start_ms"] + (reached["end_ms"] - reached["start_ms"]) * share + 0.5).cast("long")
    return F.when(reached.isNull(), F.element_at(timeline, -1)["end_ms"]).when(at <= reached["char_start"], reached["start_ms"]).otherwise(inside)


def transcript_chunks(turns: DataFrame, *, by: str) -> DataFrame:
    """Sentence windows of every turn with interpolated times, numbered through the recording."""
    kind = turns.schema[by].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(r, t, i, c, a, b) for r, t, text in zip(pdf[by], pdf["turn"], pdf["content"], strict=True) for i, (c, a, b) in enumerate(sentence_windows(text))]
            yield pd.DataFrame(rows, columns=[by, "turn", "piece", "content", "a", "b"])

    pieces = turns.select(by, "turn", "content").mapInPandas(run, f"{by} {kind}, turn long, piece int, content string, a int, b int")
    joined = pieces.join(turns.select(by, "turn", "speaker", "timeline"), [by, "turn"])
    start = time_at(F.col("timeline"), F.col("a"))
    timed = joined.withColumn("start_ms", start).withColumn("end_ms", F.greatest("start_ms", time_at(F.col("timeline"), F.col("b"))))
    place = Window.partitionBy(by).orderBy("turn", "piece")
    return timed.withColumn("chunk_index", F.row_number().over(place) - 1).select(by, "chunk_index", "content", "start_ms", "end_ms", "speaker")


def active_at(probes: DataFrame, chunks: DataFrame, *, by: str, probe_time: str, start: str, value: str) -> DataFrame:
    """Backward as-of: for each probe the last chunk of its key that has started. One shuffle by key, no range join.

    Both sides become one stream in time order; the last chunk seen so far is carried over the probes.
    """
    a = chunks.filter(F.col(start).isNotNull()).select(F.col(by), F.col(start).alias("_t"), F.lit(0).alias("_k"), F.col(value).alias("_v"), F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    b = probes.select(F.col(by), F.col(probe_time).alias("_t"), F.lit(1).alias("_k"), F.lit(None).cast(chunks.schema[value].dataType).alias("_v"), "probe_id")
    seen = Window.partitionBy(by).orderBy("_t", "_k", "_v").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(seen)).filter("_k = 1").select("probe_id", by, F.col("_last").alias(value))


def forward_filled(rows: DataFrame, *, by: str, order: str, value: str, name: str = "filled") -> DataFrame:
    """Each row's last known value; rows before the first known one get that."""
    w = Window.partitionBy(by).orderBy(order)
    first = F.first(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), first))


def numbered_by_appearance(rows: DataFrame, *, by: str, order: str, value: str, name: str = "speaker") -> DataFrame:
    """Numbers from 1 in the order in which values first appear."""
    first = rows.groupBy(by, value).agg(F.min(order).alias("_first"))
    numbers = first.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy("_first"))).drop("_first")
    return rows.join(numbers, [by, value])
