"""Lexical retrieval: BM25 with the embedded full-text engine's formula, plain or stemmed.

Scoring one query needs the lengths of all chunks and the frequencies of the query's terms only, so no postings are
shuffled: one pass counts terms per chunk, one global aggregate gives N, the mean length and the document frequencies
(every stored chunk counts, visible or not), and scores follow in the same projection. ``postings`` builds the index
tables for many queries.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from .porter import stem

K1, B = 1.2, 0.75
#: What the logarithm is replaced by where it is not positive.
IDF_FLOOR = 1e-6


def visible(frame: DataFrame, *, include_local_only: bool = False, documents: list | None = None, paths: list | None = None, kinds: list | None = None) -> DataFrame:
    """Rows of active documents, not local-only unless asked for, within the given lists (an empty list is no filter)."""
    out = frame.filter("active")
    if not include_local_only:
        out = out.filter(~F.col("local_only"))
    for column, values in (("document_id", documents), ("source_path", paths), ("chunk_type", kinds)):
        if values:
            out = out.filter(F.col(column).isin(list(dict.fromkeys(values))))
    return out


def _terms(query: str, stemmed: bool) -> Counter:
    terms = T.query_terms(query)
    return Counter(stem(t) for t in terms) if stemmed else Counter(terms)


def idf(n: Column, df: Column) -> Column:
    raw = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(raw > 0, raw).otherwise(F.lit(IDF_FLOOR))


def bm25_scores(chunks: DataFrame, query: str, *, id_col: str = "chunk_id", content_col: str = "content", stemmed: bool = False) -> DataFrame:
    """``chunks`` that match with ``score``; a term repeated in the query counts as often."""
    wanted = _terms(query, stemmed)
    if not wanted:
        return chunks.withColumn("score", F.lit(0.0)).limit(0)
    terms = sorted(wanted)
    if stemmed:
        counted = chunks.withColumn("_t", T.index_tokens(F.col(content_col))).withColumn("_dl", F.size("_t"))
        # Only words that can have one of the stems are stemmed: a stem keeps the first two letters.
        heads = sorted({t[:2] for t in terms})
        counted = counted.withColumn("_t", stems(F.filter("_t", lambda w: F.substring(w, 1, 2).isin(heads))))
        equal = lambda t: lambda w: w == t  # noqa: E731  (a second parameter would be the index)
        tf = {f"_tf{i}": F.size(F.filter("_t", equal(t))) for i, t in enumerate(terms)}
    else:
        # Terms are counted in the text; no array of its words is made.
        counted = chunks.withColumn("_t", T.folded(F.col(content_col))).withColumn("_dl", F.regexp_count("_t", F.lit("[\\p{L}\\p{N}]+")))
        tf = {f"_tf{i}": T.term_occurrences(F.col("_t"), t) for i, t in enumerate(terms)}
    counted = counted.withColumns(tf).drop("_t")
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(c) > 0).cast("long")).alias(f"_df{i}") for i, c in enumerate(tf)])
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("_dl") / F.col("_avg"))
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        c = F.col(f"_tf{i}")
        score = score + F.lit(float(wanted[t])) * idf(F.col("_n"), F.col(f"_df{i}")) * c * (K1 + 1) / (c + length)
    hit = F.lit(False)
    for c in tf:
        hit = hit | (F.col(c) > 0)
    # One row of statistics: its size does not depend on the data.
    scored = counted.filter(hit).crossJoin(F.broadcast(stats)).withColumn("score", score)
    return scored.select(*chunks.columns, "score")


@F.pandas_udf(ArrayType(StringType()))
def stems(words: pd.Series) -> pd.Series:
    cache: dict[str, str] = {}
    out = []
    for ws in words:
        got = []
        for w in ws if ws is not None else ():
            s = cache.get(w)
            if s is None:
                s = cache[w] = stem(w)
            got.append(s)
        out.append(got)
    return pd.Series(out)


def search_bm25(chunks: DataFrame, query: str, *, top_k: int = 5, id_col: str = "chunk_id", stemmed: bool = False, **filters) -> DataFrame:
    """The ``top_k`` best visible chunks; statistics cover all chunks. Ties: smaller id."""
    scored = bm25_scores(chunks, query, id_col=id_col, stemmed=stemmed)
    return visible(scored, **filters).orderBy(F.desc("score"), id_col).limit(max(0, top_k))


def ranked(frame: DataFrame, *order, name: str = "rank") -> DataFrame:
    """Number the rows of a result that a limit has bounded, from 1."""
    return frame.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def postings(chunks: DataFrame, *, id_col: str = "chunk_id", content_col: str = "content", stemmed: bool = False) -> dict[str, DataFrame]:
    """Index tables: postings (term, chunk, tf), lengths (chunk, dl), terms (term, df), corpus (n, avgdl).

    Stems are made of distinct terms and joined back.
    """
    tokens = chunks.select(F.col(id_col).alias("chunk_id"), T.index_tokens(F.col(content_col)).alias("t"))
    lengths = tokens.select("chunk_id", F.size("t").alias("dl"))
    rows = tokens.select("chunk_id", F.inline(T.term_counts(F.col("t"))))  # counted where the text is, before any shuffle
    if stemmed:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield pdf.assign(stem=[stem(t) for t in pdf["term"]])

        table = rows.select("term").distinct().mapInPandas(run, "term string, stem string")
        rows = rows.join(table, "term").groupBy("chunk_id", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))
    terms = rows.groupBy("term").agg(F.count("*").alias("df"))
    return {"postings": rows, "lengths": lengths, "terms": terms, "corpus": lengths.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))}


def search_postings(index: dict[str, DataFrame], queries: DataFrame, *, top_k: int = 5) -> DataFrame:
    """(query_id, chunk_id, score) for queries (query_id, term, weight), by joins on the index tables."""
    hits = queries.join(index["terms"], "term").join(index["postings"], "term").join(index["lengths"], "chunk_id").crossJoin(F.broadcast(index["corpus"]))
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("dl") / F.col("avgdl"))
    one = F.col("weight") * idf(F.col("n"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + length)
    scored = hits.groupBy("query_id", "chunk_id").agg(F.sum(one).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_k)


def confident(matches: DataFrame, mode: str, confidence: str, *, query_col: str | None = None) -> DataFrame:
    """Matches that reach a confidence of ``low`` (all), ``medium`` or ``high``; BM25 goes by the best score of the list."""
    if confidence == "low":
        return matches
    fixed = {"semantic": {"medium": 0.55, "high": 0.70}, "hybrid": {"medium": 0.20, "high": 0.50}}
    if mode in fixed:
        return matches.filter(F.col("score") >= fixed[mode][confidence])
    share, least = {"medium": (0.35, 0.8), "high": (0.60, 1.5)}[confidence]
    if query_col:
        top = F.max("score").over(Window.partitionBy(query_col))
        return matches.withColumn("_top", top).filter(F.col("score") >= F.greatest(F.col("_top") * share, F.lit(least))).drop("_top")
    best = matches.agg(F.max("score").alias("_top"))
    return matches.crossJoin(F.broadcast(best)).filter(F.col("score") >= F.greatest(F.col("_top") * share, F.lit(least))).drop("_top")
