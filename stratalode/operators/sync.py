"""Folder reconciliation and incremental index maintenance, as set operations on whole listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Extensions that can be ingested; fixed values.
EXTENSIONS = tuple("pdf docx pptx xlsx csv txt md markdown aac aif aiff flac m4a mp3 oga ogg opus wav webm wma".split())


def settled(state: Column, document: Column, same: Column) -> Column:
    """Whether a tracked file needs no upload: ignored always; changed never; synced only while it has its document."""
    return F.when(state == "ignored", True).when(~same, False).otherwise((state != "synced") | document.isNotNull())


def ingestable(path: Column, extensions: tuple[str, ...] = EXTENSIONS) -> Column:
    return F.lower(F.regexp_extract(path, "\\.([^./]+)$", 1)).isin(*extensions)


def reconcile(listing: DataFrame, tracked: DataFrame) -> DataFrame:
    """(path, outcome): upload, unchanged, malformed, stale, or skipped for files that cannot be ingested (present all the same)."""
    a = listing.select("path", F.col("last_modified").alias("_m"), F.col("size").alias("_s"), F.lit(True).alias("_here"))
    both = a.join(tracked, "path", "full_outer")
    same = (F.col("last_modified") == F.col("_m")) & (F.col("size") == F.col("_s"))
    done = settled(F.col("state"), F.col("document_id"), same)
    outcome = (
        F.when(F.col("_here").isNull(), "stale")
        .when(~ingestable(F.col("path")), "skipped")
        .when(F.col("state").isNotNull() & done & (F.col("state") == "malformed"), "malformed")
        .when(F.col("state").isNotNull() & done, "unchanged")
        .otherwise("upload")
    )
    return both.select("path", outcome.alias("outcome"), F.coalesce("_m", "last_modified").alias("last_modified"), F.coalesce("_s", "size").alias("size"))


def renames(reconciled: DataFrame) -> DataFrame:
    """(path, replaces): uploads paired one to one with stale files of equal time and size, in path order."""
    turn = Window.partitionBy("last_modified", "size").orderBy("path")
    pick = lambda kind, name: reconciled.filter(F.col("outcome") == kind).select("last_modified", "size", F.row_number().over(turn).alias("n"), F.col("path").alias(name))
    return pick("upload", "path").join(pick("stale", "replaces"), ["last_modified", "size", "n"]).select("path", "replaces")


def totals(reconciled: DataFrame) -> DataFrame:
    return reconciled.groupBy("outcome").agg(F.count("*").alias("n"))


def ingested(uploads: DataFrame, tracked: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """New tracking rows of uploads (path, last_modified, size, content_hash): the first path of a content owns it, others are duplicates.

    An owner that is tracked keeps its content unless the upload replaces its path.
    """
    owners = tracked.filter("state = 'synced'").select("content_hash", F.col("path").alias("owner"))
    if replaced is not None:
        owners = owners.join(replaced.select(F.col("replaces").alias("owner")), "owner", "left_anti")
    first = Window.partitionBy("content_hash").orderBy("path")
    rows = uploads.join(owners, "content_hash", "left").withColumn("_lead", F.first("path").over(first))
    owner = F.coalesce("owner", "_lead")
    return rows.select("path", "last_modified", "size", "content_hash", F.when(owner == F.col("path"), "synced").otherwise("duplicate").alias("state"), F.when(owner != F.col("path"), owner).alias("message"))


def freed_duplicates(tracked: DataFrame, removed: DataFrame) -> DataFrame:
    """Tracking rows left when files are removed: they go, and so do duplicates that named one of them, which then upload anew."""
    gone = removed.select("path").distinct()
    left = tracked.join(gone, "path", "left_anti")
    return left.join(gone.select(F.col("path").alias("message"), F.lit("duplicate").alias("state")), ["state", "message"], "left_anti").select(*tracked.columns)


def net_changes(changes: DataFrame, model: str, *, seq: str = "seq") -> DataFrame:
    """(document_id, chunk_id, seq, live): what a log of removals and puts comes to. A put of another model kills the chunk.

    Puts before a document's last removal are void; of the puts of a chunk the last counts. One shuffle by document.
    """
    removal = F.max(F.when(F.col("kind") == "remove", F.col(seq))).over(Window.partitionBy("document_id"))
    after = changes.withColumn("_r", removal).filter((F.col("kind") == "put") & (F.col("_r").isNull() | (F.col(seq) > F.col("_r"))))
    last = after.groupBy("document_id", "chunk_id").agg(F.max(F.struct(seq, "embedding_model", "value")).alias("x"))
    return last.select("document_id", "chunk_id", F.col(f"x.{seq}").alias("seq"), F.col("x.value").alias("value"), (F.col("x.embedding_model") == model).alias("live"))


def applied(index: DataFrame, changes: DataFrame, model: str) -> DataFrame:
    """Index rows (document_id, chunk_id, value) after a change log: removed documents and every put chunk lose old rows, live puts enter."""
    net = net_changes(changes, model)
    removed = changes.filter("kind = 'remove'").select("document_id").distinct()
    old = index.join(removed, "document_id", "left_anti").join(changes.filter("kind = 'put'").select("chunk_id").distinct(), "chunk_id", "left_anti")
    return old.select("document_id", "chunk_id", "value").unionByName(net.filter("live").select("document_id", "chunk_id", "value"))


def needs_compaction(dead: int, total: int, share: float = 0.25) -> bool:
    return total > 0 and dead / total > share


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with rows of equal keys replaced: an anti join and a union, to be written to a new version."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").select(*rows.columns).unionByName(rows)


def inserted_or_ignored(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    fresh = rows.dropDuplicates(keys).join(table.select(*keys), keys, "left_anti")
    return table.unionByName(fresh.select(*table.columns))
