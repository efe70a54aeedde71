"""Catalogue of documents: listing, tags, groups, counts. Pages are cut before anything is joined to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .semantic import bounded

PAGE_LIMIT = 200
SORTS = ("title", "title-desc", "oldest", "newest", "most-chunks", "least-chunks")


def group_label(folder: Column, origin: Column) -> Column:
    return F.coalesce(folder, F.when(origin == "MANUAL", "manual").otherwise("individual"))


def scoped(documents: DataFrame, *, active: bool | None = None, include_local_only: bool = True, ids: list | None = None, id_col: str = "id") -> DataFrame:
    out = documents if active is None else documents.filter(F.col("active") == active)
    out = out if include_local_only else out.filter(~F.col("local_only"))
    return out.filter(F.col(id_col).isin(ids)) if ids else out


def with_any_tag(documents: DataFrame, tags: DataFrame, names: list[str], *, key: str) -> DataFrame:
    return documents.join(tags.filter(F.col("tag").isin(names)), key, "left_semi")


def with_token(documents: DataFrame, tags: DataFrame, token: str, *, key: str) -> DataFrame:
    """Documents whose title or one of whose tags has the token, ignoring the case of A-Z."""
    tagged = tags.filter(T.ascii_contains(F.col("tag"), token)).select(key).distinct().withColumn("_tagged", F.lit(True))
    return documents.join(tagged, key, "left").filter(T.ascii_contains(F.col("title"), token) | F.col("_tagged").isNotNull()).drop("_tagged")


def matching(documents: DataFrame, tags: DataFrame, *, key: str = "id", mode: str = "all", group: str | None = None, any_tags: list[str] | None = None, query: str = "") -> DataFrame:
    """Library predicate: group, mode, any of the tags, and every token of the query."""
    out = documents if mode == "all" else documents.filter(F.col("active") == (mode == "active"))
    if group:
        out = out.filter(F.col("group") == group)
    if any_tags:
        out = with_any_tag(out, tags, any_tags, key=key)
    for token in query.split():
        out = with_token(out, tags, token, key=key)
    return out


def sort_order(sort: str, key: str) -> list[Column]:
    title = T.ascii_lower(F.col("title"))
    first = {"title": title.asc(), "title-desc": title.desc(), "oldest": F.col("created_at").asc(), "newest": F.col("created_at").desc(), "most-chunks": F.col("chunk_count").desc(), "least-chunks": F.col("chunk_count").asc()}
    return [first.get(sort, title.asc()), F.col(key).asc()]


def page(documents: DataFrame, *, sort: str = "title", key: str = "id", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, numbered from 1 across pages; a single ordered take with offset."""
    order = sort_order(sort, key)
    cut = documents.orderBy(*order).offset(max(0, offset)).limit(max(0, min(limit, PAGE_LIMIT)))
    return cut.withColumn("row", F.row_number().over(Window.orderBy(*order)) + F.lit(max(0, offset)))


def tag_lists(tags: DataFrame, *, key: str) -> DataFrame:
    return tags.groupBy(key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def chunk_counts(chunks: DataFrame, *, key: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunk_count"))


def listed(rows: DataFrame, tags: DataFrame, chunks: DataFrame | None = None, *, key: str = "id") -> DataFrame:
    """A page with its documents' tags and chunk counts; the page is at most PAGE_LIMIT rows and goes to the other sides."""
    small = bounded(rows.select(key))
    out = rows.join(tag_lists(tags.join(small, key, "left_semi"), key=key), key, "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    if chunks is not None:
        out = out.join(chunk_counts(chunks.join(small, key, "left_semi"), key=key), key, "left").fillna(0, ["chunk_count"])
    return out


def group_counts(documents: DataFrame) -> DataFrame:
    return documents.groupBy("group").agg(F.count("*").alias("n"), F.count_if("active").alias("n_active"), F.count_if("local_only").alias("n_local_only"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: global counts, each a partial count per task and one sum."""
    out = None
    for name, frame in tables.items():
        one = frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def next_sort_order(rows: DataFrame, *, by: str, order: str = "sort_order") -> DataFrame:
    return rows.groupBy(by).agg((F.coalesce(F.max(order), F.lit(-1)) + 1).alias("next_order"))


def index_state(indexed: DataFrame, stored: DataFrame) -> DataFrame:
    a, b = indexed.agg(F.count("*").alias("indexed")), stored.agg(F.count("*").alias("stored"))
    return a.crossJoin(F.broadcast(b)).withColumn("state", F.when(F.col("indexed") == F.col("stored"), "ready").otherwise("out-of-sync"))


def after_key(rows: DataFrame, key: str, last, limit: int) -> DataFrame:
    """Keyset page: rows with a key after ``last``."""
    out = rows if last is None else rows.filter(F.col(key) > F.lit(last))
    return out.orderBy(key).limit(limit)


def same_ids(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """Whether two id lists are permutations of each other, repeats counted."""
    odd = current.exceptAll(wanted).unionAll(wanted.exceptAll(current))
    return odd.agg((F.count("*") == 0).alias("same"))


def has_local_only(documents: DataFrame) -> DataFrame:
    return documents.filter("local_only").limit(1).agg((F.count("*") > 0).alias("has_local_only"))


def corpus_listing(documents: DataFrame, *, key: str = "id", limit: int = 50, offset: int = 0) -> DataFrame:
    """Titles and paths of active documents in alphabetical order, one page, with the total."""
    active = documents.filter("active")
    total = active.agg(F.count("*").alias("total"))
    return page(active, key=key, limit=limit, offset=offset).select("row", key, "title", "source_path").crossJoin(F.broadcast(total))


def transcript(chunks: DataFrame, document) -> DataFrame:
    """Chunks of one recording in order, with their times and speakers."""
    return chunks.filter(F.col("document_id") == F.lit(document)).orderBy("chunk_index")


def pending_groups(groups: DataFrame, pending: DataFrame) -> DataFrame:
    """All groups with their pending uploads; a group that only has uploads is one too."""
    waiting = pending.groupBy("group").agg(F.array_sort(F.collect_list("name")).alias("pending"))
    return groups.join(waiting, "group", "full_outer").withColumn("pending", F.coalesce("pending", F.array().cast("array<string>")))


def with_folder(documents: DataFrame, files: DataFrame, *, key: str = "id") -> DataFrame:
    """``documents`` with the folder that holds them (null if none) and the group that this makes; at most one row a document."""
    held = files.filter("document_id is not null").groupBy(F.col("document_id").alias(key)).agg(F.min("folder_id").alias("folder_id"))
    return documents.join(held, key, "left").withColumn("group", group_label(F.col("folder_id"), F.col("origin")))


def malformed_counts(files: DataFrame) -> DataFrame:
    """Files of each folder that could not be read, 0 where there are none."""
    return files.groupBy("folder_id").agg(F.count_if(F.col("state") == "malformed").alias("malformed"))


def not_shown(rows: DataFrame, shown: DataFrame, *, key: str = "id") -> DataFrame:
    """Rows of a further page without those that were shown already; a repeated key counts once."""
    return rows.dropDuplicates([key]).join(shown.select(key).distinct(), key, "left_anti")


def pruned(selection: DataFrame, existing: DataFrame, *, whole: bool, key: str = "id") -> DataFrame:
    """A selection without ids that are gone; left as it is where the listing is not the whole library."""
    return selection.join(existing.select(key).distinct(), key, "left_semi") if whole else selection


def distinct_counts(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.agg(*[F.count_distinct(c).alias(c) for c in columns])


def download_progress(files: DataFrame, *, by: str) -> DataFrame:
    """Bytes done and in all over the files of a download, and the share done; unknown sizes count as what is done."""
    total = F.sum(F.greatest("done", F.coalesce("total", "done")))
    return files.groupBy(by).agg(F.sum("done").alias("done"), total.alias("total")).withColumn("share", F.when(F.col("total") > 0, F.col("done") / F.col("total")).otherwise(0.0))


def model_names(names: DataFrame, *, name: str = "name") -> DataFrame:
    """Names without repeats in the order of a dictionary: case decides only between equals, lower before upper."""
    return names.select(name).distinct().orderBy(F.lower(name), F.desc(name))
