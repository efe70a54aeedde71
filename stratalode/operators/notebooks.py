"""Notebooks and sessions: search, excerpts within a budget, history, compaction, import and export."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def search_pages(pages: DataFrame, query: str, *, limit: int = 100, shown: bool = True) -> DataFrame:
    """Pages (notebook_title, page_title, content, …) that hold every term, scored by titles and occurrences."""
    terms = list(dict.fromkeys(query.strip().lower().split()))
    if not terms:
        return pages.withColumns({"match_count": F.lit(0).cast("long"), "score": F.lit(0).cast("long")}).limit(0)
    book, title, body = (F.lower(F.col(c)) for c in ("notebook_title", "page_title", "content"))
    everything = F.concat_ws("\n", book, title, body)
    hit, score, count = F.lit(True), F.lit(0), F.lit(0).cast("long")
    for t in terms:
        hit = hit & everything.contains(t)
        score = score + F.when(title.contains(t), 5).otherwise(0) + F.when(book.contains(t), 3).otherwise(0)
        count = count + T.occurrences(body, t)
    found = pages.filter(hit).withColumn("_c", count).withColumns({"match_count": F.greatest(F.lit(1).cast("long"), F.col("_c")), "score": score + F.least(F.col("_c"), F.lit(20))}).drop("_c")
    if shown:
        found = found.withColumn("snippet", T.snippet(F.col("content"), terms))
    return found.orderBy(F.desc("score"), F.lower("notebook_title"), F.lower("page_title")).limit(max(0, limit))


def find_in_page(text: str, query: str, most: int = 500) -> list[tuple[int, int]]:
    """Ranges of a literal in a page, ignoring case, left to right without overlap."""
    if not query:
        return []
    return [m.span() for _, m in zip(range(most), re.finditer(re.escape(query), text, re.IGNORECASE), strict=False)]


def packed(rows: DataFrame, *, by: str, order: str, text: str = "content", prefix: Column | None = None, budget: int = 20_000, each: int = 1200) -> DataFrame:
    """Excerpts in order until a character budget is spent: each cut to ``each``, the last to what is left; blanks keep their number.

    A row that is cut uses all that is left, so one running sum decides. Texts are cut before they are dealt out by group,
    and columns that nobody asks for, like the whole text, stay behind.
    """
    w = Window.partitionBy(by).orderBy(order)
    numbered = rows.withColumn("_text", T.compact(F.col(text), each)).withColumn("number", F.row_number().over(w)).filter("_text != ''")
    head = F.lit("") if prefix is None else prefix
    sep = F.when(F.row_number().over(w) == 1, 0).otherwise(2)
    cost = numbered.withColumn("_prefix", head).withColumn("_over", F.char_length("_prefix") + sep)
    used = F.coalesce(F.sum(F.col("_over") + F.char_length("_text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = cost.withColumn("_room", F.lit(budget) - used - F.col("_over")).filter("_room > 0")
    return room.withColumn("excerpt", F.concat("_prefix", F.when(F.char_length("_text") <= F.col("_room"), F.col("_text")).otherwise(F.substring("_text", 1, F.col("_room").cast("int"))))).drop("_text", "_prefix", "_over", "_room")


def history(messages: DataFrame, *, by: str, order: str, last: int = 20) -> DataFrame:
    """The last messages of each session, then only those of user and assistant."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return messages.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= last).filter(F.col("role").isin("user", "assistant")).drop("_n")


def message_size(messages: DataFrame) -> Column:
    """Characters of a message: its content, and its reasoning and tool calls (JSON text) where the table has them."""
    parts = [c for c in ("content", "reasoning", "tool_calls") if c in messages.columns]
    return sum((F.char_length(F.coalesce(c, F.lit(""))) for c in parts), F.lit(0))


def message_sizes(messages: DataFrame, *, by: str) -> DataFrame:
    return messages.groupBy(by).agg(F.sum(message_size(messages)).alias("chars"))


# What a trimmed tool result says, and results that stay: the last two and short ones.
NOTE, KEEP_LAST, KEEP_UNDER = "Older tool result trimmed to fit the context window. Re-run the tool if you need the details again.", 2, 320


def compacted(messages: DataFrame, *, by: str, order: str, budget: int, exempt: tuple[str, ...] = ()) -> DataFrame:
    """``messages`` with the oldest tool results replaced by a note until the session fits its budget."""
    size = message_size(messages)
    length = F.char_length(F.coalesce("content", F.lit("")))
    query = F.get_json_object("content", "$.query")
    stub = F.to_json(F.struct(F.lit(True).alias("compacted"), query.alias("query"), F.lit(NOTE).alias("note")))
    tool = (F.col("role") == "tool") & ~F.coalesce(F.col("name"), F.lit("")).isin(*exempt, "\0")
    later = F.sum(tool.cast("int")).over(Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0))
    rows = messages.withColumns({"_size": size, "_stub": stub, "_late": later, "_tool": tool})
    able = F.col("_tool") & (F.col("_late") > KEEP_LAST) & (length > KEEP_UNDER)
    saving = F.when(able, length - F.char_length("_stub")).otherwise(0)
    rows = rows.withColumns({"_able": able, "_saving": saving, "_excess": F.sum("_size").over(Window.partitionBy(by)) - budget})
    before = F.coalesce(F.sum("_saving").over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_before", before).withColumn("content", F.when(F.col("_able") & (F.col("_before") < F.col("_excess")), F.col("_stub")).otherwise(F.col("content"))).select(*messages.columns)


def streamed_turns(deltas: DataFrame, *, by: list[str], order: str) -> DataFrame:
    """Fold of stream deltas: content and reasoning concatenated in order."""
    joined = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(c, F.lit("")).alias("d")))), lambda x: x["d"]), "")
    return deltas.groupBy(*by).agg(joined("content").alias("content"), joined("reasoning").alias("reasoning"))


def sources_of(messages: DataFrame) -> DataFrame:
    """(id, chunk_id) of the sources that message metadata names."""
    shape = "outputs array<struct<type:string, chunkId:string>>"
    return messages.select("id", F.explode(F.filter(F.from_json("metadata", shape)["outputs"], lambda o: o["type"] == "source")).alias("o")).select("id", F.col("o.chunkId").alias("chunk_id")).filter("chunk_id is not null")


def goals(wanted: DataFrame, previous: DataFrame) -> DataFrame:
    """A new list of goals; those that were there before, by text without case, keep their state."""
    old = previous.groupBy(F.lower(T.trimmed(F.col("text"))).alias("_k")).agg(F.max("done").alias("_done"))
    return wanted.withColumn("_k", F.lower(T.trimmed(F.col("text")))).join(old, "_k", "left").withColumn("done", F.coalesce("done", "_done", F.lit(False))).drop("_k", "_done")


def goal_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("remaining"))


def imported_pages(files: DataFrame, *, most: int = 100) -> DataFrame:
    """(sort_order, title, content) of files (name, content) in natural order; blank or too many files are an error row."""
    body = F.when(F.lower(F.col("name")).endswith(".txt"), T.hard_breaks(F.col("content"))).otherwise(F.replace(T.without_byte_order_mark(F.col("content")), F.lit("\r\n"), F.lit("\n")))
    # At most a hundred files make a notebook: the first of them in order, then one bounded window.
    order = [T.natural_key(F.col("name")), F.col("name")]
    rows = files.orderBy(*order).limit(most + 1).withColumn("sort_order", F.row_number().over(Window.orderBy(*order)) - 1)
    error = F.when(F.col("sort_order") >= most, f"more than {most} pages").when(T.trimmed(body) == "", "no text")
    title = T.trimmed(T.title_of(F.col("name")))
    return rows.select("sort_order", F.when(title == "", "Imported page").otherwise(title).alias("title"), body.alias("content"), error.alias("error"))


def exported_names(pages: DataFrame, *, by: str, order: str) -> DataFrame:
    """Unique file names of a notebook's pages: later pages of a taken name get the next free number."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        used, names = set(), []
        for slug in pdf.sort_values(order)["slug"]:
            name, n = slug, 2
            while name in used:
                name, n = f"{slug}-{n}", n + 1
            used.add(name)
            names.append(f"{name}.md")
        return pdf.sort_values(order).assign(file=names)[[by, order, "file"]]

    number = F.row_number().over(Window.partitionBy(by).orderBy(order))
    slugs = pages.select(by, order, T.slug(F.col("title"), F.concat(F.lit("page-"), number.cast("string"))).alias("slug"))
    return slugs.groupBy(by).applyInPandas(run, f"{by} {pages.schema[by].dataType.simpleString()}, {order} {pages.schema[order].dataType.simpleString()}, file string")


_HEADING, _TABLE = "## Citations", ["| Source | Page |", "| --- | --- |"]
_TARGET = re.compile(r"\]\(([^)]*)\)")


def with_citations(text: str, rows: list[str]) -> str:
    """Markdown with a citations table that has the given rows once each, by link target, after those it had."""
    lines = text.split("\n")
    start = next((i for i, x in enumerate(lines) if x.strip() == _HEADING), None)
    old, end = [], None
    if start is not None:
        end = start + 1
        while end < len(lines) and (not lines[end].strip() or lines[end].startswith("|")):
            old += [lines[end]] if lines[end].startswith("|") and lines[end] not in _TABLE else []
            end += 1
    key = lambda r: m[1] if (m := _TARGET.search(r)) else " ".join(r.split())
    merged = list({key(r): r for r in reversed([*old, *rows])}.values())[::-1]
    merged.sort(key=[*old, *rows].index)
    if not merged:
        return text
    block = "\n".join([_HEADING, "", *_TABLE, *merged])
    parts = [text.rstrip(), block] if start is None else ["\n".join(lines[:start]).rstrip(), block, "\n".join(lines[end:])]
    return "\n\n".join(p for p in parts if p)


def citations_added(pages: DataFrame, rows: DataFrame, *, key: str) -> DataFrame:
    """(key, content) of pages (key, content) with the citation rows (key, position, row) merged in."""
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "row"))).alias("x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "content": [with_citations(t or "", json.loads(r) if r else []) for t, r in zip(pdf["content"], pdf["rows"], strict=True)]})

    joined = pages.join(lists, key, "left").select(key, "content", F.to_json("x.row").alias("rows"))
    return joined.mapInPandas(run, f"{key} {pages.schema[key].dataType.simpleString()}, content string")


def moved_page(pages: DataFrame, page: str, target: str) -> DataFrame:
    """Pages with one moved to the end of another notebook, its title made unique there."""
    there = pages.filter(F.col("notebook_id") == target)
    facts = there.agg((F.coalesce(F.max("sort_order"), F.lit(-1)) + 1).alias("_o"), F.collect_set(F.lower("title")).alias("_titles"))
    free = F.filter(F.transform(F.sequence(F.lit(2), F.size("_titles") + 2), lambda n: F.concat(F.col("title"), F.lit(" "), n.cast("string"))), lambda t: ~F.array_contains(F.col("_titles"), F.lower(t)))[0]
    mine = F.col("id") == page
    rows = pages.crossJoin(F.broadcast(facts))
    title = F.when(mine & F.array_contains("_titles", F.lower("title")), free).otherwise(F.col("title"))
    return rows.withColumns({"title": title, "sort_order": F.when(mine, F.col("_o")).otherwise(F.col("sort_order")).cast("int"), "notebook_id": F.when(mine, F.lit(target)).otherwise(F.col("notebook_id"))}).select(*pages.columns)


def notebook_context(sources: DataFrame, chunks: DataFrame, documents: DataFrame, notebook, *, most: int = 100) -> DataFrame:
    """The chunks that a notebook cites (notebook_id, chunk_id, sort_order), in order, with their document's title; of active documents only."""
    cited = sources.filter(F.col("notebook_id") == F.lit(notebook)).orderBy("sort_order", "chunk_id").limit(most)
    titles = documents.filter("active").select(F.col("id").alias("document_id"), "title")
    return F.broadcast(cited).join(chunks, "chunk_id").join(titles, "document_id")
