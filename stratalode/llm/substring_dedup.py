"""Substring dedup by level-wise doubling over words.

A window that occurs once cannot be part of a longer window that occurs twice. The levels go from a short length
to the asked one, each at most twice the last (20 words: 5, 10, 20). At each level every window of the asked length
that is still a candidate is looked at through one stretch of the level's length inside it, the one of smallest hash,
which equal windows share; windows whose stretch occurs once are no candidates any more, the others are extended to the
next length. At the last length each remaining candidate is compared whole, by 128 bits, and the earliest of equals
stays. Windows of yet more than the asked length consist of windows of that length, so they cover no further word and
the levels end there.

Defined cases: null or empty text has no words; rows that share an id are ordered by text and a repeated row
counts as a later copy; null ids come last; an exact copy of an earlier row loses all its words if it has a
window at all; an empty table gives no rows. Columns besides id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys, repeats
from . import textvec as tv

RESULT = "id long, n_words long, n_removed long, kept_text string"
#: Words of the first level at most; shorter stretches repeat by chance in any large corpus and would rule out little.
FIRST_LEVEL = 5


def levels(window: int) -> list[int]:
    """Lengths from the first level to ``window``, each at most twice the one before."""
    out = [window]
    while out[0] > FIRST_LEVEL:
        out.insert(0, -(-out[0] // 2))
    return out


def _hashes(texts: tv.Texts) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = tv.words(texts)
    return tv.span_hashes(texts.data, starts, ends), first


def _all_starts(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of every document of a slice: its start in the slice and its document."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    return tv.ranges(first[:-1], counts), np.repeat(np.arange(len(counts)), counts)


def _marked_starts(first: np.ndarray, marks: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that the marks of the last level leave, in order and each once, however often a mark comes."""
    _, low, high = repeats.unpack(marks)
    document = np.repeat(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), high - low + 1)
    starts = first[document] + tv.ranges(low, high - low + 1)
    starts, at = np.unique(starts, return_index=True)
    return starts, document[at]


def _stretches(values: np.ndarray, first: np.ndarray, starts: np.ndarray, document: np.ndarray, window: int, length: int) -> tuple[np.ndarray, ...]:
    """(hash, second hash, document, packed place) of one stretch for each run of candidates that share it."""
    if length == window:
        base = starts - first[document]
        return *(tv.windows(values, window, seed)[starts] for seed in (0, 1)), document, repeats.pack(base, base, base)
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    grams = tv.windows(values, length)
    place = tv.leftmost_minima(grams, window - length + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1]) | (starts[1:] != starts[:-1] + 1)
    at = np.flatnonzero(new)
    high = starts[np.append(at[1:], len(starts)) - 1]
    place, document = place[at], document[at]
    base = first[document]
    return grams[place], np.zeros(len(at), np.uint64), document, repeats.pack(place - base, starts[at] - base, high - base)


def _level(frame: DataFrame, window: int, length: int) -> DataFrame:
    """(j, w) of the candidates of (j, text[, marks]) whose stretch of ``length`` repeats; at the last length, of all but the earliest."""
    last, from_marks = length == window, "marks" in frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = repeats.with_marks(batch, 2) if from_marks else keys.without_copies(batch)
            j = batch.column(0).to_numpy()
            for at, texts in tv.slices(batch.column(1)):
                values, first = _hashes(texts)
                left = _marked_starts(first, *repeats.lists(batch.column(2), at, len(texts))) if from_marks else _all_starts(first, window)
                a, u, document, w = _stretches(values, first, *left, window, length)
                yield repeats.anchor_batch(a, u, j[at + document], w, symmetric=not last)

    rows = frame.mapInArrow(run, repeats.ANCHOR_SCHEMA)
    return repeats.verdicts(repeats.sorted_by_gram(rows), symmetric=not last).filter(F.col("kind") == repeats.WHOLE).select("j", "w")


def substring_dedup(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """One row per document row: id, n_words, n_removed, kept_text (the words left, joined by one space).

    A word goes if a window of ``window`` words covers it whose sequence also starts earlier. ``window`` is at most 65,538.
    """
    lengths = levels(window)
    repeats.checked(window, lengths[0])
    rows = keys.keyed(spark, documents, id_col, text_col)
    # A copy of an earlier row goes whole and is first nowhere, so from the second level on only the earliest row of each text counts.
    copies = keys.stored(spark, keys.copies(rows).filter("j != lead").select("j", F.lit(True).alias("copy")))
    gone = _level(rows.select("j", "text"), window, lengths[0])
    for at, length in enumerate(lengths[1:]):
        # The first level is the large one: its shuffle ends with a written table. The others and the cut read one exchange of the texts, so all take its columns.
        marks = (gone if at else keys.stored(spark, gone)).join(copies.hint("shuffle_hash"), "j", "left_anti")
        gone = _level(repeats.marked(rows, marks).select("j", "text", "marks", "id"), window, length)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for at, texts in tv.slices(batch.column(1)):
                _, _, first = tv.words(texts)
                marks, offsets = repeats.lists(batch.column(3), at, len(texts))
                base = np.repeat(first[:-1], np.diff(offsets))
                _, low, high = repeats.unpack(marks)
                out = tv.covered(base + low, base + high + window, int(first[-1]))
                n_words = np.diff(first)
                whole = np.flatnonzero(copy[at : at + len(texts)] & (n_words >= window))
                out[tv.ranges(first[whole], n_words[whole])] = True
                sums = np.concatenate([[0], np.cumsum(out)])
                removed = sums[first[1:]] - sums[first[:-1]]
                kept = []
                for i, (r, n) in enumerate(zip(removed.tolist(), n_words.tolist(), strict=True)):
                    tokens = texts.text(i).split() if r < n else []
                    kept.append(b" ".join(compress(tokens, (~out[first[i] : first[i + 1]]).tolist()) if r else tokens).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(n_words), pa.array(removed), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept_text"])

    return repeats.marked(rows, gone).join(copies.hint("shuffle_hash"), "j", "left").select("id", "text", "copy", "marks").mapInArrow(cut, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = substring_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), window=20)
    return got.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
