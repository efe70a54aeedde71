"""Where the same run of units (words or bytes) occurs again: the part that both substring operators share.

Every window of ``window`` units contains ``window - gram + 1`` grams; the one with the smallest hash is
its anchor. Equal windows have equal anchors at equal places, so it is enough to shuffle anchors, which are
about 2 / (window - gram + 2) of all positions. An anchor row holds the hash of its gram, the hash of the
span that all windows of that anchor cover, the document and the place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

ANCHOR_SCHEMA = "a long, u long, j long, w long"
VERDICT_SCHEMA = "j long, w long, kind int"
#: All windows of the anchor occur elsewhere (earlier, if order counts).
WHOLE = 1
#: Some other span has the same gram; windows must be compared one by one.
MIXED = 2
#: Bits of each of the two distances in a packed place; 31 are left for the position, as much as a document can have.
DISTANCE_BITS = 16
FARTHEST = (1 << DISTANCE_BITS) - 1


def checked(window: int, gram: int) -> None:
    """Raise if distances of anchors to their window starts do not fit a packed place."""
    if window - gram > FARTHEST:
        raise ValueError(f"a window of {window} is too long: window - gram is {window - gram}, at most {FARTHEST}")


def pack(position: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of an anchor with the distances to its first and last window start."""
    return position << 2 * DISTANCE_BITS | (position - low) << DISTANCE_BITS | (position - high)


def unpack(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    position = w >> 2 * DISTANCE_BITS
    return position, position - (w >> DISTANCE_BITS & FARTHEST), position - (w & FARTHEST)


def span_values(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """Hash of values[start:end] for each span of 64-bit values."""
    _, base, inverse = tv._SEEDS[seed]
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * tv.powers(base, len(values)), out=total[1:])
    return tv.mix((total[ends] - total[starts]) * tv.powers(inverse, len(values) + 1)[starts] + (ends - starts).astype(np.uint64))


def anchors(values: np.ndarray, grams: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram hash, span hash, document, packed place in the document) of the anchors of a slice.

    values: a hash per unit; grams: a hash per gram start; first: each document's first unit, with one entry more.
    """
    minima = tv.leftmost_minima(grams, window - gram + 1)
    if not len(minima):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    counts = np.maximum(np.diff(first) - window + 1, 0)
    starts = tv.ranges(first[:-1], counts)
    place = minima[starts]
    document = np.repeat(np.arange(len(counts)), counts)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (document[1:] != document[:-1])
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(starts)) - 1
    low, high, position, document = starts[at], starts[last], place[at], document[at]
    base = first[document]
    return grams[position], span_values(values, low, high + window, 1), document, pack(position - base, low - base, high - base)


def anchor_batch(a: np.ndarray, u: np.ndarray, j: np.ndarray, w: np.ndarray, *, symmetric: bool) -> pa.RecordBatch:
    """Anchor rows of a slice, of which one goes for each span that the slice holds more than once.

    What the slice itself shows is settled here, so that a passage that fills a corpus reaches its gram's task once
    a slice. Settled rows carry their place inverted and go to a task of their own hash, just to be written.
    """
    a, u = a.view(np.int64), u.view(np.int64)
    order = np.lexsort((w, j, u, a))
    a, u, j, w = a[order], u[order], j[order], w[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (u[1:] != u[:-1])
    settled = ~new
    if symmetric:
        settled |= np.append(settled[1:], False)
    at = np.flatnonzero(settled)
    spread = tv.mix(j[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w[at].astype(np.uint64)).view(np.int64)
    zero = np.zeros(len(at), np.int64)
    columns = [np.concatenate(x) for x in ((a[new], spread), (u[new], zero), (j[new], j[at]), (w[new], ~w[at]))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "u", "j", "w"])


def verdicts(sorted_rows: DataFrame, *, symmetric: bool) -> DataFrame:
    """Judge anchor rows that come sorted by (a, u, j, w), one gram's rows in one partition.

    Rows stream through with constant state, however many share a gram. If ``symmetric``, a span that occurs
    twice makes all its rows WHOLE; else all but the first. The first row of each of several spans of a gram is MIXED.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((4, 0), np.int64)  # the first row of the last span, which later rows may still concern
        told_whole = told_mixed = False  # what that row has been told already
        lone = True  # whether that span is the first of its gram
        for batch in batches:
            fresh = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            if not fresh.shape[1]:
                continue
            had = held.shape[1]
            rows = np.concatenate([held, fresh], axis=1)
            a, u, j, w = rows
            n = len(a)
            new_a = np.ones(n, bool)
            new_a[1:] = a[1:] != a[:-1]
            new_u = new_a.copy()
            new_u[1:] |= u[1:] != u[:-1]
            index = np.arange(n)
            first = np.maximum.accumulate(np.where(new_u, index, 0))
            again = ~new_u & ((j != j[first]) | (w != w[first]))
            whole = again | (w < 0)
            if symmetric:
                whole[first[again]] = True
            # A gram with more than one span: every span's first row is to be compared.
            group = np.cumsum(new_a) - 1
            several = np.bincount(group[new_u]) > 1
            if had and not lone:
                several[0] = True
            mixed = new_u & several[group]
            if had:
                whole[0] &= not told_whole
                mixed[0] &= not told_mixed
            keep = np.flatnonzero(whole | mixed)
            if len(keep):
                both = np.flatnonzero(whole & mixed)
                at = np.concatenate([keep, both])
                kind = np.concatenate([np.where(whole[keep], WHOLE, MIXED), np.full(len(both), MIXED)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(j[at]), pa.array(np.where(w[at] < 0, ~w[at], w[at])), pa.array(kind)], names=["j", "w", "kind"])
            tail = first[-1]
            same = had and tail == 0
            told_whole = bool(whole[tail]) or (same and told_whole)
            told_mixed = bool(mixed[tail]) or (same and told_mixed)
            lone = not several[group[-1]]
            held = rows[:, tail : tail + 1].copy()

    return sorted_rows.mapInArrow(run, VERDICT_SCHEMA)


def sorted_by_gram(rows: DataFrame) -> DataFrame:
    return rows.repartition("a").sortWithinPartitions("a", "u", "j", "w")


def marked(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """``rows`` with the array of ``w`` that ``marks`` has for their j (null if none). A document's marks are bounded by its length.

    Always an outer join of all columns, so that several of them read one exchange of the texts.
    """
    return rows.join(marks.groupBy("j").agg(F.collect_list("w").alias("marks")).hint("shuffle_hash"), "j", "left")


def lists(column: pa.ListArray, at: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of rows at .. at+n of a list column; null counts as empty."""
    part = column.slice(at, n)
    if part.null_count:
        lengths = np.where(np.asarray(part.is_valid()), np.nan_to_num(part.value_lengths().to_numpy(zero_copy_only=False)), 0).astype(np.int64)
    else:
        lengths = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.concatenate([[0], np.cumsum(lengths)])


def with_marks(batch: pa.RecordBatch, place: int) -> pa.RecordBatch:
    """The rows of a batch whose column at ``place`` is not null."""
    column = batch.column(place)
    return batch.filter(column.is_valid()) if column.null_count else batch
