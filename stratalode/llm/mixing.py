"""Mixing sources to target weights by temperature.

Source shares of all tokens are raised to an exponent and normalised. The exponent is bisected until the mixture has
the wanted entropy, or until no source is repeated more often than a limit. The budget is the least that takes every
document at least once: the most under-weighted source passes once, others repeat.

A source's documents lie in blocks by a hash of their key. Each pass over a source permutes its blocks, and the
documents in each, by hashes of seed and pass; the last pass stops where the source's budget is met. ``mix_key``, the
place in the source's stream over its budget, orders the whole mixture so that every stretch of it has the weights.

Blocks hold a 4096th of all tokens, or ``block_tokens``. Windows run over the blocks of a source and over the documents
of a block; the sources' table is broadcast up to a size, so no task is dealt a source's documents.

Defined cases: null source is a source of its own; null or empty text counts as one token, so it has a place; rows of
equal id and text are rows of their own; an empty table gives no rows. Other columns are ignored, and kept by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import keys
from .quality_rules import _GAP

#: Sources are a list that the driver holds; more than this is an error, not a cut.
MOST_SOURCES = 1_000_000
#: A table of at most so many sources goes to every task, a few MB; a larger one is joined by a shuffle.
BROADCAST_SOURCES = 20_000
#: Blocks that all tokens are cut into, or more where a block would exceed its greatest size.
BLOCKS, MOST_BLOCK_TOKENS = 4096, 4_000_000
NO_SOURCE = "\0"


def tempered(shares: list[float], exponent: float) -> list[float]:
    """Shares to the power of the exponent, normalised."""
    top = max(shares)
    raised = [(s / top) ** exponent for s in shares]
    total = math.fsum(raised)
    return [r / total for r in raised]


def entropy(weights: list[float]) -> float:
    return -math.fsum(w * math.log(w) for w in weights if w > 0)


def repetition(shares: list[float], weights: list[float]) -> float:
    """How often the most repeated source passes if every source passes at least once."""
    rates = [w / s for w, s in zip(weights, shares, strict=True)]
    return max(rates) / min(rates)


def solve_exponent(shares: list[float], *, target_entropy: float | None = None, repetition_limit: float | None = None, rounds: int = 100) -> float:
    """The exponent in [0, 1] by bisection: the greatest that reaches the entropy, or the least that keeps the limit.

    Entropy falls and repetition falls as the exponent grows. A target out of reach gives the nearer end.
    """
    if (target_entropy is None) == (repetition_limit is None):
        raise ValueError("give an entropy or a repetition limit")
    flat_enough = (lambda a: entropy(tempered(shares, a)) >= target_entropy) if target_entropy is not None else (lambda a: repetition(shares, tempered(shares, a)) > repetition_limit)
    low, high = 0.0, 1.0
    if not flat_enough(low):
        return low
    if flat_enough(high):
        return high
    for _ in range(rounds):
        middle = (low + high) / 2
        low, high = (middle, high) if flat_enough(middle) else (low, middle)
    return low if target_entropy is not None else high


def plan(tokens: dict[str, int], **target: float) -> tuple[float, dict[str, float], dict[str, int]]:
    """(exponent, weight of each source, budget of each source in tokens)."""
    names = sorted(tokens)
    total = sum(tokens.values())
    shares = [tokens[n] / total for n in names]
    exponent = solve_exponent(shares, **target)
    weights = tempered(shares, exponent)
    budget = max(s / w for s, w in zip(shares, weights, strict=True)) * total
    return exponent, dict(zip(names, weights, strict=True)), {n: max(tokens[n], round(w * budget)) for n, w in zip(names, weights, strict=True)}


def placements(spark: SparkSession, documents: DataFrame, *, key_col: str, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", block_tokens: int | None = None, seed: int = 17, **target: float) -> DataFrame:
    """(key, id, source, n_tokens, weight, epoch, block, position, mix_key), one row for each time a document is used."""
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), _GAP), lambda w: w != ""))
    light = documents.select(F.col(key_col).alias("key"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit(NO_SOURCE)).alias("source"), F.greatest(words, F.lit(1)).cast("long").alias("n_tokens"))
    light = keys.stored(spark, light)
    totals = light.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    rows = totals.limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    tokens = {r["source"]: r["tokens"] for r in rows}
    block_tokens = block_tokens or max(1, min(MOST_BLOCK_TOKENS, sum(tokens.values()) // BLOCKS))
    _, weights, budgets = plan(tokens, **target) if tokens else (1.0, {}, {})
    table = spark.createDataFrame(
        [(n, weights[n], budgets[n], tokens[n], -(-tokens[n] // block_tokens), -(-budgets[n] // tokens[n])) for n in sorted(tokens)], "source string, weight double, budget long, tokens long, blocks long, epochs long"
    )
    homes = light.join(F.broadcast(table) if len(tokens) <= BROADCAST_SOURCES else table, "source").withColumn("block", F.pmod(F.xxhash64(F.lit(seed), "key"), F.col("blocks")))
    sizes = homes.groupBy("source", "block", "epochs", "tokens", "budget").agg(F.sum("n_tokens").alias("size"))
    passes = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    over = upto("source", "epoch").orderBy(F.xxhash64(F.lit(seed), "epoch", "block"), "block")
    starts = passes.withColumn("start", F.col("epoch") * F.col("tokens") + F.coalesce(F.sum("size").over(over), F.lit(0))).filter("start < budget").select("source", "block", "epoch", "start")
    used = homes.join(starts, ["source", "block"])
    inside = upto("source", "epoch", "block").orderBy(F.xxhash64(F.lit(seed), "epoch", "key"), "key")
    placed = used.withColumn("position", F.col("start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).filter("position < budget")
    source = F.when(F.col("source") == NO_SOURCE, None).otherwise(F.col("source"))
    return placed.select("key", "id", source.alias("source"), "n_tokens", "weight", "epoch", "block", "position", (F.col("position") / F.col("budget")).alias("mix_key"))


def mix(spark: SparkSession, documents: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """``documents`` with every row as often as the mixture uses it, all columns unchanged."""
    key = keys.free_name(documents)
    rows = keys.with_key(spark, documents, id_col, text_col, key)
    uses = placements(spark, rows, key_col=key, id_col=id_col, source_col=source_col, text_col=text_col, **options).select(F.col("key").alias(key))
    return rows.join(uses.hint("shuffle_hash"), key).select(*documents.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keys.with_key(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "_j")
    uses = placements(spark, rows, key_col="_j", repetition_limit=2.0)
    return uses.select(F.col("id").alias("doc_id"), "source", "n_tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "position", F.round("mix_key", 9).alias("mix_key"))
