"""Suffix-array dedup over bytes.

Of every ``window`` bytes one anchor position is a suffix to sort (see :mod:`repeats`); equal windows have their
anchors at equal places, so the sorted anchor suffixes show every repeated window. Anchors whose whole span occurs
twice are settled by hash, anchors whose gram occurs once cannot be in a repeated window. What is left is a suffix
array proper: splitters sampled from the leading bytes range-partition the suffixes, each bucket is ordered by
multikey quicksort (eight bytes a level, only runs of equals go on), and the common prefixes of neighbours give, at
every depth, the classes of equal suffixes; the reversed bytes before the anchors are ordered alike. A window is
repeated if another anchor has the same class on both sides. The leading bytes that the splitters cut by are no
longer than what equal windows share, so neighbours that could share a window never lie on two sides of a boundary.
A group of very many suffixes with the same leading bytes is not held: its windows are compared by hash in a shuffle.

Defined cases: null text is empty; a repeated row counts as another document, so an exact copy of at least
``window`` bytes loses everything, in every copy; shorter ones nothing; null ids are ids; an empty table gives no
rows. Columns besides id and text are ignored. Removal may cut a character in two: kept bytes are binary.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys, repeats
from . import textvec as tv

RESULT = "id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary"
SUFFIX = "lead binary, head binary, tail binary, j long, place long"
#: A repeated span of a document, or (with a and u) a window of a hot group that is still to be judged.
PIECE = "j long, low long, high long, a long, u long, w long"
#: Bytes of a suffix that splitters are sampled from.
LEADING_BYTES = 48
#: Suffixes that a bucket holds before it is solved where the leading bytes change next.
PIECE_SUFFIXES = 20_000
#: Suffixes with the same leading bytes that are held at once; the windows of a larger group are compared by a shuffle.
HOT_SUFFIXES = 60_000


def multikey_order(matrix: np.ndarray) -> np.ndarray:
    """Order of the rows of a uint64 matrix, column by column; only runs of equal rows go on to the next column."""
    order = np.arange(len(matrix))
    group = np.zeros(len(matrix), np.int64)
    active = np.arange(len(matrix))
    for column in range(matrix.shape[1]):
        if not len(active):
            break
        rows, runs = order[active], group[active]
        sub = np.lexsort((matrix[rows, column], runs))
        rows = rows[sub]
        order[active] = rows
        key = matrix[rows, column]
        differs = np.zeros(len(rows), bool)
        differs[1:] = (key[1:] != key[:-1]) | (runs[1:] != runs[:-1])
        differs[0] = True
        first = active[np.maximum.accumulate(np.where(differs, np.arange(len(rows)), 0))]
        group[active] = first
        lone = differs & np.append(differs[1:], True)
        active = active[~lone]
    return order


def _words(column: list[bytes], width: int) -> np.ndarray:
    """The byte strings as rows of big-endian 64-bit words, zero-padded."""
    width = -(-width // 8) * 8
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in column), ">u8").reshape(len(column), -1).astype(np.uint64)


def common_prefix(matrix: np.ndarray, order: np.ndarray, block: int = 4096) -> np.ndarray:
    """Bytes that each row, in order, shares with the row before it (0 for the first)."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), block):
        to = min(len(order), at + block)
        x = matrix[order[at:to]] ^ matrix[order[at - 1 : to - 1]]
        place = (x != 0).argmax(axis=1)
        word = x[np.arange(to - at), place]
        zeros = (word.astype(">u8").view(np.uint8).reshape(-1, 8) != 0).argmax(axis=1)
        out[at:to] = np.where(word != 0, place * 8 + zeros, matrix.shape[1] * 8)
    return out


def classes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of the rows with the common prefix of neighbours."""
    order = multikey_order(matrix)
    return order, common_prefix(matrix, order)


def repeated_reach(heads: list[bytes], tails: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the least and greatest bytes before it at which a window that repeats begins; -1 if none does.

    heads: the bytes from the anchor on; tails: those before it, reversed.
    """
    n = len(heads)
    least, greatest = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if n < 2:
        return least, greatest
    before, after = np.array([len(x) for x in tails]), np.array([len(x) for x in heads])
    order, shared = classes(_words(heads, window))
    reverse, shared_back = classes(_words(tails, window - gram))
    for k in range(int(before.max()) + 1):
        valid = np.flatnonzero((before >= k) & (after >= window - k))
        if len(valid) < 2:
            continue
        right, left = np.empty(n, np.int64), np.empty(n, np.int64)
        right[order] = np.cumsum(shared < window - k)
        left[reverse] = np.cumsum(shared_back < k)
        _, inverse, counts = np.unique(right[valid] * (n + 1) + left[valid], return_inverse=True, return_counts=True)
        again = valid[counts[inverse] > 1]
        greatest[again] = k
        least[again[least[again] < 0]] = k
    return least, greatest


def hot_windows(batch: pa.RecordBatch, window: int) -> Iterator[pa.RecordBatch]:
    """A row for every window of the spans of these suffixes, with two hashes, in the form of anchors."""
    rows = max(1, 1_000_000 // (2 * window))
    for at in range(0, batch.num_rows, rows):
        lead, head, tail, j, place = batch.slice(at, rows).columns
        spans = [t[::-1] + a + b for a, b, t in zip(lead.to_pylist(), head.to_pylist(), tail.to_pylist(), strict=True)]
        sizes = np.array([len(x) for x in spans])
        data, first = np.frombuffer(b"".join(spans), np.uint8), np.cumsum(sizes) - sizes
        counts = sizes - window + 1
        starts = tv.ranges(first, counts)
        a, u = (tv.byte_windows(data, window, seed)[starts] for seed in (0, 1))
        before = pc.binary_length(tail).to_numpy().astype(np.int64)
        low = np.repeat(place.to_numpy() - before - first, counts) + starts
        a, u, j, w = repeats.anchor_batch(a, u, np.repeat(j.to_numpy(), counts), repeats.pack(low, low, low), symmetric=True).columns
        none = pa.nulls(len(j), pa.int64())
        yield pa.RecordBatch.from_arrays([j, none, none, a, u, w], names=["j", "low", "high", "a", "u", "w"])


def pieces(batches: Iterator[pa.RecordBatch], window: int, gram: int, most: int, hottest: int) -> Iterator[pa.RecordBatch]:
    """PIECE rows of suffixes that come in the order of their leading bytes.

    A bucket is solved in pieces of about ``most`` suffixes that end where the leading bytes change. Of a group that
    shares them and reaches ``hottest``, the windows go on to be judged by hash, a batch at a time.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    hot: bytes | None = None

    def solve(table: pa.Table) -> pa.RecordBatch:
        heads = [a + b for a, b in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True)]
        least, greatest = repeated_reach(heads, table.column(2).to_pylist(), window, gram)
        at = np.flatnonzero(greatest >= 0)
        place = table.column(4).to_numpy()[at]
        none = pa.nulls(len(at), pa.int64())
        return pa.RecordBatch.from_arrays([table.column(3).combine_chunks().take(pa.array(at)), pa.array(place - greatest[at]), pa.array(place - least[at] + window), none, none, none], names=["j", "low", "high", "a", "u", "w"])

    for batch in batches:
        if not batch.num_rows:
            continue
        if hot is not None or size >= most:
            lead = batch.column(0).to_pylist()
            last = hot if hot is not None else held[-1].column(0)[-1].as_py()
            cut = next((i for i, x in enumerate(lead) if x != last), len(lead))
            if hot is not None:
                yield from hot_windows(batch.slice(0, cut), window)
            elif cut:
                held.append(batch.slice(0, cut))
                size += cut
            if cut == len(lead):
                if hot is None and size >= hottest:
                    table = pa.Table.from_batches(held)
                    group = bisect.bisect_left(table.column(0).to_pylist(), last)
                    if size - group >= hottest:
                        if group:
                            yield solve(table.slice(0, group))
                        for x in table.slice(group).to_batches():
                            yield from hot_windows(x, window)
                        held, size, hot = [], 0, last
                continue
            if held:
                yield solve(pa.Table.from_batches(held))
            held, size, hot, batch = [], 0, None, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield solve(pa.Table.from_batches(held))


def suffix_dedup(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 400) -> DataFrame:
    """One row per document row: id, n_bytes, n_removed, n_spans, the removed spans, and the bytes left. ``window`` is at most 131,071."""
    gram = max(1, window // 2)
    repeats.checked(window, gram)
    leading = min(LEADING_BYTES, gram)
    rows = keys.keyed(spark, documents, id_col, text_col)

    def anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keys.without_copies, batches):
            j = batch.column(0).to_numpy()
            for at, texts in tv.slices(batch.column(1)):
                values = tv.mix(texts.data.astype(np.uint64) + np.uint64(1))
                a, u, document, w = repeats.anchors(values, tv.byte_windows(texts.data, gram), texts.offsets, window, gram)
                yield repeats.anchor_batch(a, u, j[at + document], w, symmetric=True)

    found = rows.select("j", "text").mapInArrow(anchor_rows, repeats.ANCHOR_SCHEMA)
    judged = keys.stored(spark, repeats.verdicts(repeats.sorted_by_gram(found), symmetric=True))

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = repeats.with_marks(batch, 3)
            j = batch.column(0).to_numpy()
            for at, texts in tv.slices(batch.column(2)):
                marks, offsets = repeats.lists(batch.column(3), at, len(texts))
                document = np.repeat(np.arange(len(texts)), np.diff(offsets))
                position, low, high = repeats.unpack(marks)
                base = texts.offsets[document]
                raw = texts.data.tobytes()
                heads = [raw[p:e] for p, e in zip((base + position).tolist(), (base + high + window).tolist(), strict=True)]
                tails = [raw[s:p][::-1] for s, p in zip((base + low).tolist(), (base + position).tolist(), strict=True)]
                for part in range(0, len(heads), 4096):
                    some = slice(part, part + 4096)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[:leading] for x in heads[some]], pa.binary()), pa.array([x[leading:] for x in heads[some]], pa.binary()), pa.array(tails[some], pa.binary()), pa.array(j[at + document[some]]), pa.array(position[some])],
                        names=["lead", "head", "tail", "j", "place"],
                    )

    unclear = repeats.marked(rows, judged.filter(F.col("kind") == repeats.MIXED))
    sorted_suffixes = unclear.select("j", "id", "text", "marks").mapInArrow(suffixes, SUFFIX).repartitionByRange("lead").sortWithinPartitions("lead")
    most, hottest = PIECE_SUFFIXES, HOT_SUFFIXES
    found_pieces = keys.stored(spark, sorted_suffixes.mapInArrow(lambda batches: pieces(batches, window, gram, most, hottest), PIECE))
    windows = repeats.verdicts(repeats.sorted_by_gram(found_pieces.filter("a is not null").select("a", "u", "j", "w")), symmetric=True)
    bits = repeats.DISTANCE_BITS
    whole = judged.unionByName(windows).filter(F.col("kind") == repeats.WHOLE).select(
        "j", (F.shiftright("w", 2 * bits) - F.shiftright("w", bits).bitwiseAND(repeats.FARTHEST)).alias("low"), (F.shiftright("w", 2 * bits) - F.col("w").bitwiseAND(repeats.FARTHEST) + window).alias("high")
    )
    spans = whole.unionByName(found_pieces.filter("a is null").select("j", "low", "high")).groupBy("j").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")).hint("shuffle_hash")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copy = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            for at, texts in tv.slices(batch.column(1)):
                low, offsets = repeats.lists(batch.column(3), at, len(texts))
                high, _ = repeats.lists(batch.column(4), at, len(texts))
                base = np.repeat(texts.offsets[:-1], np.diff(offsets))
                sizes = texts.sizes()
                gone = tv.covered(base + low, base + high, len(texts.data))
                whole = np.flatnonzero(copy[at : at + len(texts)] & (sizes >= window))
                gone[tv.ranges(texts.offsets[whole], sizes[whole])] = True
                # Runs end with the document, also where the next one begins removed.
                edge = np.zeros(len(gone) + 1, bool)
                edge[texts.offsets] = True
                begins = gone & (edge[:-1] | ~np.concatenate([[False], gone[:-1]]))
                finishes = gone & (edge[1:] | ~np.concatenate([gone[1:], [False]]))
                start, end = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
                runs = np.searchsorted(start, texts.offsets)
                removed = np.concatenate([[0], np.cumsum(gone)])[texts.offsets]
                home = np.repeat(texts.offsets[:-1], np.diff(runs))
                kept_data = texts.data[~gone]
                kept_offsets = (texts.offsets - removed).astype(np.int32)
                kept = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(kept_offsets.tobytes()), pa.py_buffer(kept_data.tobytes())])
                structs = pa.StructArray.from_arrays([pa.array(start - home), pa.array(end - home)], names=["start", "end"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(sizes), pa.array(np.diff(removed)), pa.array(np.diff(runs)), pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), structs), kept],
                    names=["id", "n_bytes", "n_removed", "n_spans", "spans", "kept"],
                )

    copies = keys.copies(rows).select("j", F.lit(True).alias("copy")).hint("shuffle_hash")
    return rows.join(spans, "j", "left").join(copies, "j", "left").select("id", "text", "copy", "lows", "highs").mapInArrow(cut, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), window=400)
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
