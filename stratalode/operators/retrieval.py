"""Hybrid retrieval: candidates of both methods, reranking, positions, context and source cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .lexical import confident
from .semantic import bounded

CONTEXT_LIMIT, PREVIEW_LIMIT = 1200, 200
MODES = ("bm25", "semantic", "hybrid")


def candidates(semantic: DataFrame, lexical: DataFrame, *, id_col: str = "chunk_id") -> DataFrame:
    """(id, position): semantic ranks first, then lexical; the first occurrence of an id stays. Inputs have ``rank``."""
    both = semantic.select(id_col, F.lit(0).alias("src"), "rank").unionByName(lexical.select(id_col, F.lit(1).alias("src"), "rank"))
    first = both.groupBy(id_col).agg(F.min(F.struct("src", "rank")).alias("at"))
    # At most twice the asked number of rows: one window over a bounded list.
    return first.select(id_col, F.row_number().over(Window.orderBy("at")).alias("position"), F.col("at.src").alias("src"))


def deduplicated(pairs: DataFrame, *, id_col: str = "chunk_id", position: str = "position", content: str = "content") -> DataFrame:
    """One row per id: its first position with its last content."""
    return pairs.groupBy(id_col).agg(F.min(position).alias(position), F.max_by(content, position).alias(content))


def token_overlap(query: str, content: Column) -> Column:
    """Stand-in relevance in [0, 1]: Jaccard of the query's and the passage's distinct terms. No model, and no claim to be one."""
    terms = F.array_distinct(F.array(*[F.lit(t) for t in T.query_terms(query)]).cast("array<string>"))
    words = F.array_distinct(T.index_tokens(content))
    union = F.size(F.array_union(terms, words))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(terms, words)) / union)


def rerank(pairs: DataFrame, relevance: Column, *, id_col: str = "chunk_id", top_k: int | None = None) -> DataFrame:
    """``pairs`` ordered by relevance, then by first position. A relevance that is null, not finite or outside [0, 1] is an error."""
    sound = relevance.isNotNull() & ~F.isnan(relevance) & relevance.between(0.0, 1.0)
    checked = F.when(sound, relevance).otherwise(F.raise_error(F.lit("relevance must lie in [0, 1]")).cast("double"))
    scored = pairs.withColumn("score", checked).orderBy(F.desc("score"), "position")
    return scored if top_k is None else scored.limit(top_k)


def positions(chunks: DataFrame, *, document: str = "document_id", order: tuple[str, ...] = ("page_index", "chunk_index")) -> DataFrame:
    """``chunks`` with ``position`` from 1 and ``total_chunks``, over the whole document."""
    by = Window.partitionBy(document)
    return chunks.withColumns({"position": F.row_number().over(by.orderBy(*order)), "total_chunks": F.count("*").over(by)})


def window_bounds(total: Column, start: int, count: int, *, most: int = 8) -> tuple[Column, Column]:
    """First and last position of a read of ``count`` chunks from ``start``, moved into 1 .. total."""
    count = max(1, min(count, most))
    first = F.least(F.greatest(F.lit(start), F.lit(1)), F.greatest(total, F.lit(1)))
    return first, F.least(first + count - 1, total)


def chunk_window(chunks: DataFrame, start: int, count: int = 4, **layout) -> DataFrame:
    """Consecutive chunks of every document of ``chunks`` from ``start`` on."""
    placed = positions(chunks, **layout)
    first, last = window_bounds(F.col("total_chunks"), start, count)
    return placed.filter(F.col("position").between(first, last))


def context_block(matches: DataFrame, *, rank: str = "rank", by: list[str] | None = None) -> DataFrame:
    """One text of all matches in rank order: a line each with the compacted content and its source."""
    source = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.when(F.col("source_path") != "", F.col("source_path")), F.lit("unknown"))
    line = F.concat(F.lit("- "), T.compact(F.col("content"), CONTEXT_LIMIT), F.lit(" (source: "), source, F.lit(")"))
    listed = matches.groupBy(*(by or [])).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("line")))).alias("x"))
    text = F.when(F.size("x") > 0, F.concat(F.lit("Relevant context:\n"), F.array_join("x.line", "\n"))).otherwise("")
    return listed.select(*(by or []), text.alias("context_block"), F.size("x").alias("n_matches"))


def source_cards(matches: DataFrame, placed: DataFrame | None = None, *, id_col: str = "chunk_id") -> DataFrame:
    """Title, description with a preview, and the position if known."""
    rows = matches if placed is None else matches.join(placed.select(id_col, "position", "total_chunks"), id_col, "left")
    return rows.withColumn("description", T.location_label(F.col("source_type"), F.col("page_index"), T.compact(F.col("content"), PREVIEW_LIMIT)))


def retrieve(semantic: DataFrame, lexical: DataFrame, chunks: DataFrame, query: str, *, mode: str = "hybrid", confidence: str = "low", top_k: int = 5, relevance: Column | None = None) -> DataFrame:
    """Matches of a mode, filtered by confidence, with position; of the ranked lists ``semantic`` and ``lexical`` the first twice ``top_k`` count."""
    semantic, lexical = (x.orderBy("rank").limit(2 * top_k) for x in (semantic, lexical))
    if mode not in MODES:
        mode = "hybrid"
    if mode == "hybrid":
        rows = chunks.join(bounded(candidates(semantic, lexical)), "chunk_id")
        matches = rerank(rows, token_overlap(query, F.col("content")) if relevance is None else relevance, top_k=top_k)
    else:
        picked = (semantic if mode == "semantic" else lexical).filter(F.col("rank") <= top_k).select("chunk_id", "score", F.col("rank").alias("position"))
        matches = chunks.join(bounded(picked), "chunk_id")
    order = [F.desc("score"), "position"]
    kept = confident(matches, mode, confidence)
    return kept.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("position", "src")


def without_score(matches: DataFrame) -> DataFrame:
    """Matches as callers see them; the score only ordered them."""
    return matches.drop("score")


def search_arguments(args: dict, *, cap: int = 20, default: int = 5) -> dict:
    """Checked arguments of the search tool: query of at most 2,000 characters, known mode, bounded number of results."""
    query = args.get("query")
    if not isinstance(query, str) or not query.strip():
        raise ValueError("query must be a non-empty string")
    try:
        top_k = int(float(args.get("top_k", default)))
    except (TypeError, ValueError):
        top_k = default
    mode = args.get("mode")
    return {"query": query.strip()[:2000], "mode": mode if mode in (*MODES, "all") else "hybrid", "top_k": max(1, min(cap, top_k))}


def all_methods(lists: dict[str, DataFrame]) -> DataFrame:
    """Ranked lists of several methods as one frame with a ``method`` column."""
    out = None
    for name, frame in lists.items():
        part = frame.select(F.lit(name).alias("method"), "rank", "chunk_id", "score")
        out = part if out is None else out.unionByName(part)
    return out
