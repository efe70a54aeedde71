"""N-gram Jaccard join with adaptive multi-match prefixes, and the classes that its links make.

Documents become sets of shingles. A global order puts shingles that a fixed-size count sketch of the whole
corpus holds for frequent last, and breaks ties by hash. Two sets with Jaccard >= t share at least L shingles
among the first n - ceil(t n) + L of each, for every L; each document picks the L that costs least, counting
the postings its prefix would meet and, per L matches needed, the candidates left to verify. A pair is a
candidate if it shares min(Lx, Ly) prefix shingles.

Only the classes of the link graph are asked for, so not every pair of a large group is looked at: first each
document is verified against the one that shares most prefix shingles with it among the leaders of its
shingles; classes follow; then all candidates whose ends are still in different classes are verified. A pair
inside a class can add nothing, a pair across classes is never left out, so the classes are exact. Every document
also has a parity bitmap of its whole set: two bitmaps differ in no more bits than their sets in shingles, so pairs
whose bitmaps differ in more than a linked pair's sets can are dropped where they meet, and no link is lost. Prefix
shingles that no other prefix holds tell the same: another set cannot have them if its prefix reaches that far in the
global order, so they count as missing from it.

Verification moves the sorted shingle hashes of the documents that a pair asks for, not texts: those of ``y`` go to
their pairs, those of ``x`` once to each of the parts that its pairs are cut into, so a document with very many
partners is neither copied for each of them nor left to one task.

Defined cases: null, empty or blank text has an empty set, size 0, no links, and is its own class; fewer words
than a shingle make one shingle; equal sets are one node from the start; rows that share an id are ordered by
text; null ids come last and a class led by one has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keys, repeats
from . import textvec as tv
from .components import components

#: Slots of the count sketch; its size does not depend on the data.
SKETCH = 1 << 20
_BLOCK = 1 << 14
#: Prefix extensions that a document chooses from.
EXTENSIONS = (1, 2, 3, 4, 6, 8)
#: What verifying one candidate costs, in postings read.
VERIFY_COST = 20.0
#: 64-bit words of a document's parity bitmap.
PARITY_WORDS = 8
#: Bytes of text in one pass of shingling, whose arrays take about a hundred times as much.
PASS_BYTES = (1 << 19) - 1
#: Pairs of one document that are verified in one part.
PART_PAIRS = 512


def shingle_sets(texts: tv.Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the distinct shingle hashes of each document, ascending."""
    low = texts.lower()
    starts, ends, first = tv.words(low)
    values = tv.span_hashes(low.data, starts, ends)
    counts = np.diff(first)
    per = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    at = tv.ranges(first[:-1], per)
    document = np.repeat(np.arange(len(texts)), per)
    hashes = repeats.span_values(values, at, np.minimum(at + n, first[1:][document]), 0)
    order = np.lexsort((hashes, document))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (document[1:] != document[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(document[new], minlength=len(texts)))])


def set_digests(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell sets apart, order-free by construction as hashes are ascending."""
    return tuple(repeats.span_values(hashes, offsets[:-1], offsets[1:], s).view(np.int64) for s in (0, 1))


def parities(hashes: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The parity bitmap of each set: bit b of PARITY_WORDS * 64 is the parity of the number of shingles that fall on b."""
    full = np.flatnonzero(np.diff(offsets))
    bit, word = np.uint64(1) << (hashes & np.uint64(63)), hashes >> np.uint64(6) & np.uint64(PARITY_WORDS - 1)
    out = [np.zeros(len(offsets) - 1, np.uint64) for _ in range(PARITY_WORDS)]
    for k, column in enumerate(out):
        if len(full):
            column[full] = np.bitwise_xor.reduceat(np.where(word == np.uint64(k), bit, np.uint64(0)), offsets[full])
    return [x.view(np.int64) for x in out]


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - 20)).astype(np.int64)


def sketch_levels(counts: np.ndarray) -> np.ndarray:
    """0 for slots within the noise of the sketch, else the binary logarithm of what stands out."""
    mean = counts.mean()
    excess = counts - mean
    level = np.floor(np.log2(np.maximum(excess, 1))).astype(np.uint8)
    return np.where(excess > 4 * np.sqrt(mean) + 16, np.maximum(level, 1), 0).astype(np.uint8)


def required(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of n shares with any set it links to, at least."""
    return -(-percent * n // 100)


def prefixes(hashes: np.ndarray, offsets: np.ndarray, levels: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix tokens, lengths, L) of every set; a token is a shingle's place in the global order, its level and 58 bits of its hash."""
    n = np.diff(offsets)
    document = np.repeat(np.arange(len(n)), n)
    level = levels[_slot(hashes)]
    order = np.lexsort((hashes, level, document))
    hashes, level = hashes[order], level[order]
    base = n - required(n, percent)
    cost = np.concatenate([[0.0], np.cumsum(np.where(level > 0, np.exp2(level.astype(np.float64)), 0.0))])
    best, choice = np.full(len(n), np.inf), np.ones(len(n), np.int64)
    for extension in EXTENSIONS:
        to = np.minimum(base + extension, n)
        postings = cost[offsets[:-1] + to] - cost[offsets[:-1]]
        total = to + postings + VERIFY_COST * postings / extension
        better = (total < best) & (extension <= np.maximum(required(n, percent), 1))
        best, choice = np.where(better, total, best), np.where(better, extension, choice)
    lengths = np.where(n > 0, np.minimum(base + choice, n), 0)
    tokens = level.astype(np.uint64) << np.uint64(58) | hashes >> np.uint64(6)
    return tokens[tv.ranges(offsets[:-1], lengths)], lengths, choice


_SIGNATURE = [f"s{k}" for k in range(PARITY_WORDS)]


def _survey(rows: DataFrame, n: int) -> DataFrame:
    """Per document its set size, digest and parity bitmap, and per task its share of the sketch, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SKETCH, np.int64)
        names = ["j", "id", "n", "d", "e", *_SIGNATURE, "block", "counts"]
        for batch in batches:
            for at, texts in tv.slices(batch.column(2), PASS_BYTES):
                hashes, offsets = shingle_sets(texts, n)
                counts += np.bincount(_slot(hashes), minlength=SKETCH)
                d, e = set_digests(hashes, offsets)
                size = len(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, size), batch.column(1).slice(at, size), pa.array(np.diff(offsets)), pa.array(d), pa.array(e), *map(pa.array, parities(hashes, offsets)), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names=names)
        if counts.any():
            k = SKETCH // _BLOCK
            none = pa.nulls(k, pa.int64())
            yield pa.RecordBatch.from_arrays([none] * (5 + PARITY_WORDS) + [pa.array(range(k), pa.int32()), pa.array([x.tobytes() for x in counts.astype(np.uint32).reshape(k, _BLOCK)], pa.binary())], names=names)

    return rows.select("j", "id", "text").mapInArrow(tv.released(run), f"j long, id long, n long, d long, e long, {', '.join(f'{c} long' for c in _SIGNATURE)}, block int, counts binary")


def _sketch(parts: DataFrame) -> np.ndarray:
    """The corpus sketch: block sums, of which the driver gets SKETCH numbers at any size of the corpus."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = np.frombuffer(raw, np.uint32 if len(raw) == 4 * _BLOCK else np.int64).astype(np.int64)
                sums[block] = sums[block] + part if block in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "counts"])

    schema = "block int, counts binary"
    summed = parts.select("block", "counts").mapInArrow(add, schema).repartition(16, "block").mapInArrow(add, schema)
    out = np.zeros(SKETCH, np.int64)
    for row in summed.collect():
        out[row["block"] * _BLOCK : (row["block"] + 1) * _BLOCK] = np.frombuffer(row["counts"], np.int64)
    return out


def _needed(n_x: Column, n_y: Column, l_x: Column, l_y: Column, percent: int) -> Column:
    """Prefix shingles that a linked pair of these sizes shares at least.

    Their overlap is at least percent (n_x + n_y) / (100 + percent). Shared shingles up to the earlier of the two
    prefix ends are in both prefixes, so at most what follows one prefix is shared outside them.
    """
    overlap = F.ceil(F.lit(percent) * (n_x + n_y) / F.lit(100.0 + percent) - 1e-9)
    after = lambda n, l: F.greatest(F.ceil(F.lit(percent) * n / 100.0 - 1e-9) - l, F.lit(0))
    return F.greatest(F.least(l_x, l_y), overlap - F.greatest(after(n_x, l_x), after(n_y, l_y)))


#: Bits of the filter that keeps texts no pair asks for from being moved; it only ever passes too many.
FILTER_BITS = 1 << 23


def _filter_bits(j: np.ndarray) -> np.ndarray:
    return (tv.mix(j.astype(np.uint64)) >> np.uint64(64 - 23)).astype(np.int64)


def _asked_sets(spark: SparkSession, pairs: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """(j, hashes) of ``rows`` that some pair may ask for, by a bitmap of fixed size over the ids of all pairs."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(FILTER_BITS // 8, np.uint8)
        for batch in batches:
            at = _filter_bits(np.concatenate([c.to_numpy() for c in batch.columns]))
            np.bitwise_or.at(out, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["bits"])

    # One megabyte a task, and at most eight tasks.
    raw = [np.frombuffer(r["bits"], np.uint8) for r in pairs.select("x", "y").coalesce(8).mapInArrow(bits, "bits binary").collect()]
    wanted = spark.sparkContext.broadcast(np.bitwise_or.reduce(raw) if raw else np.zeros(FILTER_BITS // 8, np.uint8))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = wanted.value
        for batch in batches:
            at = _filter_bits(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for lo, texts in tv.slices(batch.column(1), PASS_BYTES):
                hashes, offsets = shingle_sets(texts, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((8 * offsets).astype(np.int32).tobytes()), pa.py_buffer(hashes.tobytes())])], names=["j", "hashes"])

    return rows.select("j", "text").mapInArrow(tv.released(sets), "j long, hashes binary")


def _linked(percent: int):
    """A function over (x, part, y, hashes) sorted by x, part, y: the row without y has the hashes of x, the others those of their y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        for batch in batches:
            sets = tv.column_texts(batch.column(3))
            values, offsets = np.frombuffer(sets.data.tobytes(), np.uint64), sets.offsets // 8
            sizes = np.diff(offsets)
            heads = np.flatnonzero(np.asarray(batch.column(2).is_null()))
            shared, own_size = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for at, to in zip([-1, *heads.tolist()], [*heads.tolist(), len(sizes)], strict=True):
                if at >= 0:
                    own = values[offsets[at] : offsets[at + 1]]
                if at + 1 == to or not len(own):
                    continue
                theirs = values[offsets[at + 1] : offsets[to]]
                met = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
                sums = np.concatenate([[0], np.cumsum(met)])
                shared[at + 1 : to] = sums[offsets[at + 2 : to + 1] - offsets[at + 1]] - sums[offsets[at + 1 : to] - offsets[at + 1]]
                own_size[at + 1 : to] = len(own)
            linked = 100 * shared >= percent * (own_size + sizes - shared)
            linked[heads] = False
            yield batch.select([0, 2]).filter(pa.array(linked))

    return run


def _verify(spark: SparkSession, pairs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets link."""
    sets = _asked_sets(spark, pairs, rows, n)
    many = pairs.groupBy("x").agg(F.count("*").alias("c")).filter(F.col("c") > PART_PAIRS)
    dealt = pairs.join(many, "x", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("y"), F.ceil(F.col("c") / PART_PAIRS)), F.lit(0)).cast("long")).select("x", "part", "y")
    dealt = keys.stored(spark, dealt)
    theirs = dealt.join(sets.withColumnRenamed("j", "y"), "y").select("x", "part", "y", "hashes")
    own = dealt.select("x", "part").distinct().join(sets.withColumnRenamed("j", "x"), "x").select("x", "part", F.lit(None).cast("long").alias("y"), "hashes")
    together = own.unionByName(theirs).repartition("x", "part").sortWithinPartitions("x", "part", F.asc_nulls_first("y"))
    return together.mapInArrow(tv.released(_linked(percent)), "x long, y long")


_PLACE_BITS = 36


def _shared(postings: DataFrame) -> DataFrame:
    """(t, q, j, x, m): the postings (t, q, j) of shingles that several prefixes hold, with the first one's document x and its q as m.

    The firsts are aggregated before they are shuffled, and a hot shingle's postings are split by the skew join.
    """
    first = postings.groupBy("t").agg(F.min(F.struct("q", "j")).alias("f"), F.count("*").alias("c")).filter("c > 1")
    return postings.join(first.select("t", F.col("f.j").alias("x"), F.col("f.q").alias("m")), "t").select("t", "q", "j", "x", "m")


def _size(q: Column) -> Column:
    return q.bitwiseAND((1 << 32) - 1)


def _extension(q: Column) -> Column:
    return F.shiftright(q, 32).bitwiseAND(15)


def _fits(n_x: Column, n_y: Column, percent: int) -> Column:
    return 100 * F.least(n_x, n_y) >= percent * F.greatest(n_x, n_y)


def _near(x: str, y: str, n_x: Column, n_y: Column, percent: int) -> Column:
    """Whether the parity bitmaps of the sides x and y differ in no more bits than the sets of a linked pair do in shingles."""
    differ = sum((F.bit_count(F.col(f"{x}{c}").bitwiseXOR(F.col(f"{y}{c}"))) for c in _SIGNATURE), F.lit(0))
    return differ <= n_x + n_y - 2 * F.ceil(F.lit(percent) * (n_x + n_y) / F.lit(100.0 + percent) - 1e-9)


def _early(x: str, y: str, percent: int) -> Column:
    """Whether a shared shingle stands early enough on both sides to be among a linked pair's first L.

    A linked pair shares at least t = percent (n_x + n_y) / (100 + percent) shingles, so the k-th of them (from 0) has
    at most n - t + k before it; and at most n - t shingles of either set are not in the other. Rare shingles come first, so sets with many of their own are not even joined.
    """
    n, l, p = ((F.col(f"{x}.{c}"), F.col(f"{y}.{c}")) for c in ("n", "l", "p"))
    least = F.ceil(F.lit(percent) * (n[0] + n[1]) / F.lit(100.0 + percent) - 1e-9)
    spare = F.least(*l) - 1 - least
    own = [F.when(F.col(f"{a}.last") <= F.col(f"{b}.last"), F.col(f"{a}.most")).otherwise(F.col(f"{a}.u")) for a, b in ((x, y), (y, x))]
    # Where one match is enough, a pair that shares the shingle before this one as well has been met there.
    again = (F.least(*l) == 1) & F.coalesce(F.col(f"{x}.prior") == F.col(f"{y}.prior"), F.lit(False))
    return ~again & (p[0] <= n[0] + spare) & (p[1] <= n[1] + spare) & (own[0] <= n[0] - least) & (own[1] <= n[1] - least)


def jaccard_classes(spark: SparkSession, rows: DataFrame, *, n: int = 4, percent: int = 85) -> DataFrame:
    """(j, id, n_shingles, lead) for ``rows`` (j, id, text): lead is the smallest j of the row's class."""
    survey = keys.stored(spark, _survey(rows, n))
    light = survey.filter("block is null").drop("block", "counts")
    levels = spark.sparkContext.broadcast(sketch_levels(_sketch(survey.filter("block is not null"))))
    nodes = light.filter("n > 0").groupBy("n", "d", "e").agg(F.min("j").alias("node"))

    def prefix_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(keys.without_copies, batches):
            for at, texts in tv.slices(batch.column(1), PASS_BYTES):
                hashes, offsets = shingle_sets(texts, n)
                tokens, lengths, choice = prefixes(hashes, offsets, levels.value, percent)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(tokens.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(choice << 32 | np.diff(offsets)), lists], names=["j", "q", "tokens"])

    heads = rows.select("j", "text").mapInArrow(tv.released(prefix_rows), "j long, q long, tokens array<long>")
    heads = heads.join(nodes.select(F.col("node").alias("j")), "j", "left_semi")
    postings = heads.select("j", "q", F.posexplode("tokens").alias("p", "t")).select("t", (F.shiftleft(F.col("p").cast("long"), _PLACE_BITS) + F.col("q")).alias("q"), "j")
    shared = keys.stored(spark, _shared(postings))

    # First the document that shares most with each, of those that lead a shingle; which pairs are looked at here matters for speed alone.
    size, first_size = _size(F.col("q")), _size(F.col("m"))
    met = shared.filter((F.col("j") != F.col("x")) & _fits(size, first_size, percent)).groupBy("x", F.col("j").alias("y")).agg(F.count("*").alias("c"), F.first(_needed(size, first_size, _extension(F.col("q")), _extension(F.col("m")), percent)).alias("need"), F.first(first_size).alias("n_x"), F.first(size).alias("n_y"))
    met = met.filter("4 * c >= need")
    for side in ("x", "y"):
        met = met.join(light.select(F.col("j").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in _SIGNATURE)), side)
    star = met.filter(_near("x_", "y_", F.col("n_x"), F.col("n_y"), percent)).groupBy("y").agg(F.max_by("x", F.struct("c", -F.col("x"))).alias("x")).select("x", "y")
    links = keys.stored(spark, _verify(spark, keys.stored(spark, star), rows, n, percent))
    classes = components(spark, links.select(F.col("x").alias("a"), F.col("y").alias("b")))

    # Then every candidate pair whose ends are in different classes.
    labelled = shared.join(classes.select(F.col("v").alias("j"), "r"), "j", "left").select("t", "j", "q", F.coalesce("r", "j").alias("r"))
    # u: the document's shingles before this one that no other prefix has; at the last shared shingle, "last", there are "most".
    by = Window.partitionBy("j").orderBy("q", "t")
    labelled = labelled.withColumn("u", F.shiftright("q", _PLACE_BITS) - F.row_number().over(by) + 1)
    whole = Window.partitionBy("j")
    labelled = keys.stored(spark, labelled.withColumns({"last": F.max("t").over(whole), "most": F.max("u").over(whole)}))
    open_ = labelled.groupBy("t").agg(F.min("r").alias("low"), F.max("r").alias("high")).filter("low != high").select("t")
    across = labelled.join(open_, "t").select("t", "j", "r", size.alias("n"), _extension(F.col("q")).alias("l"), F.shiftright("q", _PLACE_BITS).alias("p"), "u", "last", "most")
    across = across.join(light.select("j", *_SIGNATURE), "j").withColumn("prior", F.lag("t").over(Window.partitionBy("j").orderBy("p", "t")))
    across = keys.stored(spark, across)
    x, y = across.alias("x"), across.alias("y")
    rest = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.r") < F.col("y.r")) & _early("x", "y", percent) & _near("x.", "y.", F.col("x.n"), F.col("y.n"), percent))
    rest = rest.groupBy(F.col("x.j").alias("x"), F.col("y.j").alias("y")).agg(F.count("*").alias("c"), F.first(F.least("x.l", "y.l")).alias("l")).filter("c >= l").select("x", "y")
    prefix = shared.groupBy("j").agg(F.collect_list("t").alias("ts"), F.first(size).alias("n"), F.first(_extension(F.col("q"))).alias("l"))
    for side in ("x", "y"):
        rest = rest.join(prefix.select(F.col("j").alias(side), F.col("ts").alias(f"t{side}"), F.col("n").alias(f"n{side}"), F.col("l").alias(f"l{side}")), side)
    enough = F.size(F.array_intersect("tx", "ty")) >= _needed(F.col("nx"), F.col("ny"), F.col("lx"), F.col("ly"), percent)
    rest = rest.filter(_fits(F.col("nx"), F.col("ny"), percent) & enough).select("x", "y")
    more = keys.stored(spark, _verify(spark, keys.stored(spark, rest), rows, n, percent))
    if not more.isEmpty():
        classes = components(spark, classes.select(F.col("v").alias("a"), F.col("r").alias("b")).unionByName(more.select(F.col("x").alias("a"), F.col("y").alias("b"))))

    members = light.select("j", "id", "n", "d", "e").join(nodes, ["n", "d", "e"], "left").select("j", "id", "n", F.coalesce("node", "j").alias("node"))
    found = members.join(classes.select(F.col("v").alias("node"), "r"), "node", "left")
    return found.select("j", "id", F.col("n").alias("n_shingles"), F.coalesce("r", "node").alias("lead"))


def jaccard_join(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the smallest id reachable by links)."""
    found = jaccard_classes(spark, keys.keyed(spark, documents, id_col, text_col), n=n, percent=percent)
    names = found.select(F.col("j").alias("lead"), F.col("id").alias("component_id"))
    return found.join(names, "lead").select("id", "n_shingles", "component_id")


def drop_near_duplicates(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with the first row of each class, all columns unchanged."""
    key = keys.free_name(documents)
    rows = keys.with_key(spark, documents, id_col, text_col, key)
    light = rows.select(F.col(key).alias("j"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    gone = jaccard_classes(spark, light, n=n, percent=percent).filter("j != lead").select(F.col("j").alias(key))
    return rows.join(gone, key, "left_anti").select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = jaccard_join(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), n=4, percent=85)
    return got.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
