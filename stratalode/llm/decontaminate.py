"""Benchmark decontamination by training suffix arrays.

Each slice of the training documents gets a suffix array over its words. Every suffix of
every benchmark item is searched in it by binary search, which yields the places of all
verbatim windows and, by joining neighbours on a diagonal, the longest verbatim matches.
The benchmark is the query set: it goes to the workers in blocks of bounded size, which a
worker reads one after the other, the documents are read once and nothing is shuffled.

Defined cases: a null or empty text has no words and is never contaminated; a null item text
has no windows; a null item id counts as the string ``null``; repeated rows and repeated items
are independent rows (an item id counts once in a document); an empty benchmark hits nothing;
an empty document table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import keys
from . import textvec as tv

#: Benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20


class TestSuffixes:
    """The windows of one block of benchmark items as vocabulary numbers."""

    __test__ = False

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        t = tv.column_texts(pa.array(texts, pa.string())).lower()
        starts, ends, first = tv.words(t, tv.NON_ALNUM)
        hashes = tv.span_hashes(t.data, starts, ends)
        self.vocabulary = np.unique(hashes)
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        sequence = np.searchsorted(self.vocabulary, hashes).astype(np.int64)
        lengths = np.diff(first)
        sizes = np.minimum(lengths, window)
        counts = np.where(lengths > 0, lengths - sizes + 1, 0)
        at = tv.ranges(first[:-1], counts)
        self.item = np.repeat(np.arange(len(ids)), counts)
        self.offset = at - np.repeat(first[:-1], counts)
        self.size = np.repeat(sizes, counts)
        padded = np.concatenate([sequence, np.full(window, -1, np.int64)])
        self.words = padded[at[:, None] + np.arange(window)[None, :]] if len(at) else np.zeros((0, window), np.int64)
        self.names = ids
        self.window = window
        self.shortest = int(self.size.min()) if len(at) else 0

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, -1 for those that no item holds."""
        out = np.full(len(hashes), -1, np.int64)
        some = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        if len(some):
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[some]), len(self.vocabulary) - 1)
            out[some] = np.where(self.vocabulary[at] == hashes[some], at, -1)
        return out


def suffix_array(sequence: np.ndarray, depth: int) -> np.ndarray:
    """Start positions of the suffixes of ``sequence``, ordered by their first ``depth`` entries (prefix doubling)."""
    rank = np.unique(sequence, return_inverse=True)[1].astype(np.int64)
    n, step = len(rank), 1
    while step < depth and n:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        rank = np.unique(rank * (n + 2) + after, return_inverse=True)[1].astype(np.int64)
        if int(rank.max()) == n - 1:
            break
        step *= 2
    return np.argsort(rank, kind="stable")


def search(sequence: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """For every test window the interval [low, high) of the suffix array whose suffixes begin with it."""
    width = test.window
    padded = np.concatenate([sequence, np.full(width, -2, np.int64)])
    column = np.arange(width)[None, :]
    ignored = column >= test.size[:, None]

    def bound(after_equal: bool) -> np.ndarray:
        low = np.zeros(len(test.size), np.int64)
        high = np.full(len(test.size), len(order), np.int64)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                return low
            middle = (low[open_] + high[open_]) // 2
            less = padded[order[middle][:, None] + column] - test.words[open_]
            less[ignored[open_]] = 0
            place = (less != 0).argmax(axis=1)
            sign = less[np.arange(len(open_)), place]
            right = sign <= 0 if after_equal else sign < 0
            low[open_] = np.where(right, middle + 1, low[open_])
            high[open_] = np.where(right, high[open_], middle)

    return bound(False), bound(True)


def shard_matches(numbers: np.ndarray, first: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """(word position, test window) of every occurrence of a window in a slice of documents."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not test.shortest or not len(numbers):
        return none
    # A suffix can only match if it begins a run of known words as long as the shortest window; runs end with documents.
    stop = numbers < 0
    edge = np.zeros(len(numbers) + 1, bool)
    edge[:-1] = stop
    edge[first[1:]] = True
    begin = np.concatenate([[0], np.flatnonzero(stop) + 1, first[:-1]])
    begin = np.unique(begin[begin < len(numbers)])
    edges = np.flatnonzero(edge)
    # An edge at a document's first word ends the run before it, not the run that begins there.
    place = np.searchsorted(edges, begin, "left")
    same = (edges[np.minimum(place, len(edges) - 1)] == begin) & ~stop[begin]
    ends = edges[np.minimum(place + same, len(edges) - 1)]
    lengths = np.where(stop[begin], 0, ends - begin)
    keep = lengths >= test.shortest
    begin, lengths = begin[keep], lengths[keep]
    if not len(begin):
        return none
    # The runs, one after the other, each closed by a terminator.
    size = int(lengths.sum()) + len(lengths)
    sequence, origin = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
    source = tv.ranges(begin, lengths)
    target = tv.ranges(np.cumsum(lengths + 1) - lengths - 1, lengths)
    sequence[target], origin[target] = numbers[source], source
    order = suffix_array(sequence, test.window)
    low, high = search(sequence, order, test)
    return origin[order[tv.ranges(low, high - low)]], np.repeat(np.arange(len(low)), high - low)


def one_by_one(blocks: list) -> Iterator[TestSuffixes]:
    """The values of the blocks. If there are several, none is kept by its broadcast, so a worker holds two at most, however many there are."""
    for block in blocks:
        if len(blocks) == 1 or not getattr(block, "_path", None):  # no path: Spark has decrypted it already
            yield block.value
        else:
            yield block.load_from_path(block._path)


def scan(texts: tv.Texts, tests: Iterable[TestSuffixes]) -> dict[str, list]:
    """Per document of a slice: words, hit words, ids of the items found, and the longest verbatim match with its place."""
    low = texts.lower()
    starts, ends, first = tv.words(low, tv.NON_ALNUM)
    hashes = tv.span_hashes(low.data, starts, ends)
    n, total = len(texts), len(starts)
    hit = np.zeros(total, bool)
    found: dict[int, set[str]] = {}
    longest: dict[int, tuple[int, str, int, int]] = {}
    for test in tests:
        position, window = shard_matches(test.numbers(hashes), first, test)
        if not len(position):
            continue
        hit |= tv.covered(position, position + test.size[window], total)
        document = np.searchsorted(first, position, "right") - 1
        item = test.item[window]
        for d, i in np.unique(np.stack([document, item]), axis=1).T.tolist():
            found.setdefault(d, set()).add(test.names[i])
        # Windows that follow each other both in the item and in the document make one longer match.
        order = np.lexsort((position, position - test.offset[window], item))
        p, o, i, s = position[order], test.offset[window][order], item[order], test.size[window][order]
        new = np.ones(len(p), bool)
        new[1:] = (i[1:] != i[:-1]) | (p[1:] != p[:-1] + 1) | (o[1:] != o[:-1] + 1)
        at = np.flatnonzero(new)
        lengths = np.diff(np.append(at, len(p))) - 1 + s[at]
        for d, k, length in zip(document[order][at].tolist(), at.tolist(), lengths.tolist(), strict=True):
            best = (length, test.names[i[k]], int(o[k]), int(p[k] - first[d]))
            if d not in longest or (-best[0], *best[1:]) < (-longest[d][0], *longest[d][1:]):
                longest[d] = best
    hits = np.concatenate([[0], np.cumsum(hit)])
    return {
        "n_words": np.diff(first),
        "n_hit": hits[first[1:]] - hits[first[:-1]],
        "items": [sorted(found.get(d, ())) for d in range(n)],
        "longest": [longest.get(d, (0, None, None, None)) for d in range(n)],
    }


def test_blocks(spark: SparkSession, benchmark: DataFrame, item_id: str, text_col: str, window: int, block_bytes: int) -> list:
    """The benchmark as broadcast blocks of about ``block_bytes`` of text, each item whole and in one of them."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(text_col).alias("text")).dropDuplicates()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes)
    out = []
    for b in range(n):
        rows = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == b).collect()
        block = TestSuffixes([r["id"] for r in rows], [r["text"] for r in rows], window)
        if block.shortest:
            out.append(spark.sparkContext.broadcast(block))
    return out


def contamination(
    spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document row: id, n_words, n_hit, items (array), and the longest match (length, item, item word, document word)."""
    blocks = test_blocks(spark, benchmark, item_id, item_text, window, block_bytes)
    key = T.StructField(id_col, documents.schema[id_col].dataType)
    schema = T.StructType([
        key, T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("items_sha256", T.StringType()),
        T.StructField("longest_match", T.LongType()), T.StructField("match_item", T.StringType()), T.StructField("match_item_word", T.LongType()), T.StructField("match_doc_word", T.LongType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tv.slices(batch.column(1)):
                got = scan(texts, one_by_one(blocks))
                longest = got["longest"]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(got["n_words"]), pa.array(got["n_hit"]), pa.array(got["items"], pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in got["items"]], pa.string()),
                        pa.array([x[0] for x in longest], pa.int64()), pa.array([x[1] for x in longest], pa.string()), pa.array([x[2] for x in longest], pa.int64()), pa.array([x[3] for x in longest], pa.int64()),
                    ],
                    names=schema.names,
                )

    return documents.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def remove_contaminated(spark: SparkSession, documents: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` that hold no benchmark window, all columns unchanged; read once, nothing shuffled."""
    blocks = test_blocks(spark, benchmark, item_id, item_text, window, block_bytes)
    place = documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tv.slices(batch.column(place)):
                clean = scan(texts, one_by_one(blocks))["n_hit"] == 0
                yield batch.slice(at, len(texts)).filter(pa.array(clean))

    return documents.mapInArrow(run, documents.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = keys.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = contamination(spark, documents, benchmark, window=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))
