"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Equal texts are one group and stay together. Groups enter by falling size, each the open shard with the least
room that still holds it, found in a balanced tree of remaining capacities; a fixed capacity so needs as few
shards as this rule gives. For a wanted number of shards the capacity is bisected: the smallest that packs all
groups into them makes shards nearly equal in bytes.

Groups of one size are interchangeable, so the plan is made over the histogram of sizes, not over groups: sizes
under 2**16 exactly, larger ones by their 16 leading bits. A fixed capacity takes each class at its largest size, so
it is never exceeded and the fit of large groups is conservative; a number of shards takes the mean size. That is at most 2**16 + 47 * 2**15 classes at any
number of documents, and it is all the driver sees. Ranks inside a class and slots inside a shard come from
counts of salted buckets, so neither a hot class nor a shard passes through one task.

Defined cases: null text counts as empty and has size 1; equal texts of any number stay in one shard; ties are
broken by hash, then id; repeated rows are rows of the same group; an empty table gives no rows. Columns
besides id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keys

#: Rows that one salted bucket holds on average.
BUCKET_ROWS = 20_000


class CapacityTree:
    """Balanced (AA) tree of (room, shard) pairs with insert, removal and least-pair-not-below search."""

    __slots__ = ("root",)

    def __init__(self, pairs=()):
        self.root = None
        for pair in pairs:
            self.add(pair)

    @staticmethod
    def _skew(t):
        if t and t[1] and t[1][3] == t[3]:
            left = t[1]
            t[1], left[2] = left[2], t
            return left
        return t

    @staticmethod
    def _split(t):
        if t and t[2] and t[2][2] and t[2][2][3] == t[3]:
            right = t[2]
            t[2], right[1] = right[1], t
            right[3] += 1
            return right
        return t

    def _insert(self, t, pair):
        if t is None:
            return [pair, None, None, 1]
        side = 1 if pair < t[0] else 2
        t[side] = self._insert(t[side], pair)
        return self._split(self._skew(t))

    def _delete(self, t, pair):
        if t is None:
            return None
        if pair != t[0]:
            side = 1 if pair < t[0] else 2
            t[side] = self._delete(t[side], pair)
        elif t[1] is None and t[2] is None:
            return None
        else:
            side = 2 if t[1] is None else 1
            near = t[side]
            while near[3 - side]:
                near = near[3 - side]
            t[0] = near[0]
            t[side] = self._delete(t[side], near[0])
        level = 1 + min(t[1][3] if t[1] else 0, t[2][3] if t[2] else 0)
        if level < t[3]:
            t[3] = level
            if t[2] and t[2][3] > level:
                t[2][3] = level
        t = self._skew(t)
        t[2] = self._skew(t[2])
        if t[2]:
            t[2][2] = self._skew(t[2][2])
        t = self._split(t)
        t[2] = self._split(t[2])
        return t

    def add(self, pair) -> None:
        self.root = self._insert(self.root, pair)

    def remove(self, pair) -> None:
        self.root = self._delete(self.root, pair)

    def tightest(self, room):
        """The least pair with at least this room, or None."""
        t, best = self.root, None
        while t:
            if t[0][0] >= room:
                best, t = t[0], t[1]
            else:
                t = t[2]
        return best


def best_fit_decreasing(classes: list[tuple[int, int, float]], capacity: float, most: int | None = None) -> list[tuple[int, int, int]] | None:
    """[(class, shard, count)] for classes (class, count, size) in falling size; None if ``most`` shards don't do.

    Groups of one size go to the tightest shard as long as they fit there: it stays the tightest.
    """
    tree, opened, plan = CapacityTree(), 0, []
    if most is not None:
        tree, opened = CapacityTree((capacity, b) for b in range(most)), most
    for name, count, size in classes:
        while count:
            found = tree.tightest(size)
            if found is None:
                if most is not None or size > capacity:
                    return None
                found, opened = (capacity, opened), opened + 1
                tree.add(found)
            room, shard = found
            k = min(count, int(room // size))
            tree.remove(found)
            tree.add((room - k * size, shard))
            plan.append((name, shard, k))
            count -= k
    return plan


def equal_plan(classes: list[tuple[int, int, float]], shards: int, rounds: int = 40) -> list[tuple[int, int, int]]:
    """The plan of the smallest capacity, found by bisection, that fits ``shards`` shards."""
    total, largest = sum(c * s for _, c, s in classes), max((s for _, _, s in classes), default=0.0)
    low, high = max(total / shards, largest), total / shards + largest
    best = best_fit_decreasing(classes, high + 1, shards)
    for _ in range(rounds):
        if high - low <= max(1.0, total / shards * 1e-6):
            break
        middle = (low + high) / 2
        plan = best_fit_decreasing(classes, middle, shards)
        if plan is None:
            low = middle
        else:
            high, best = middle, plan
    return best or []


def _ranked(rows: DataFrame, within: list[str], salt: str, order: list) -> DataFrame:
    """``rows`` with ``rank``, gapless from 0 in each ``within``: counts of salts before, then place in the salt."""
    counts = rows.groupBy(*within, salt).count()
    before = Window.partitionBy(*within).orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*within, salt, F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    placed = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*within, salt).orderBy(*order)) - 1)
    return placed.join(offsets, [*within, salt]).withColumn("rank", F.col("_offset") + F.col("_place")).drop("_offset", "_place", salt)


def pack(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int | None = 8, capacity: int | None = None) -> DataFrame:
    """(id, size, text_crc32, shard, slot) for every row: into ``shards`` nearly equal shards, or as few of ``capacity`` bytes as best fit needs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("d"), F.xxhash64(F.lit(7), text).alias("e"))
    rows = keys.stored(spark, rows)
    n_rows = rows.count()
    groups = rows.groupBy("d", "e").agg(F.sum("size").alias("bytes"))
    groups = keys.stored(spark, groups.withColumn("class", F.expr("shiftleft(shiftright(bytes, greatest(length(bin(bytes)) - 16, 0)), greatest(length(bin(bytes)) - 16, 0))")))
    histogram = groups.groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.max("bytes").alias("largest")).collect()
    classes = sorted(((r["class"], r["n"], r["largest"] if capacity else r["bytes"] / r["n"]) for r in histogram), reverse=True)
    plan = best_fit_decreasing(classes, capacity) if capacity else equal_plan(classes, shards)
    if plan is None:
        raise ValueError(f"a group of equal texts is larger than {capacity} bytes")
    ends: dict[int, list[tuple[int, int]]] = {}
    for name, shard, k in plan:
        done = ends.setdefault(name, [])
        done.append((shard, k + (done[-1][1] if done else 0)))
    count = {name: n for name, n, _ in classes}
    table = spark.createDataFrame([(name, -(-count[name] // BUCKET_ROWS), [s for s, _ in x], [e for _, e in x]) for name, x in ends.items()], "class long, salts int, shards array<int>, ends array<long>")
    salted = groups.join(table, "class").withColumn("salt", F.pmod(F.xxhash64("d"), F.col("salts")))
    placed = _ranked(salted, ["class"], "salt", ["d", "e"]).select("d", "e", F.expr("element_at(shards, size(filter(ends, x -> x <= rank)) + 1)").alias("shard"))
    buckets = max(1, -(-n_rows // (8 * BUCKET_ROWS)))
    homes = rows.join(placed, ["d", "e"]).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    return _ranked(homes, ["shard"], "bucket", ["id", "d"]).select("id", "size", "text_crc32", "shard", F.col("rank").cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = pack(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=8)
    return got.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
