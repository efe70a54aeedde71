"""The driver's tables as tables of the engine: deterministic expressions, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """A scanned table that lies in fewer splits than there are cores, dealt over them; a table of many splits stays where it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.toString() or plan.execute().getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue rows of documents left-joined with labels; carries doc_id, text and language for the operators."""
    d, labels = spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels")
    path = F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.join(labels, "doc_id", "left").select(
        "doc_id", T.document_id(path).alias("id"), F.concat_ws("-", "source", "lang", F.col("doc_id").cast("string")).alias("title"), path.alias("source_path"),
        F.lit("TEXT").alias("source_type"), F.when(F.col("doc_id") % 10 == 0, "MANUAL").otherwise("FILE").alias("origin"),
        (F.coalesce("quality", F.lit(1)) == 1).alias("active"), (F.coalesce("toxic", F.lit(0)) == 1).alias("local_only"), "lang", "source", "text", "n_chars", "quality", "toxic",
    )


def document_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    language = d.select("doc_id", F.col("lang").alias("tag"))
    toxic = labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("tag"))
    low = labels.filter("quality = 0").select("doc_id", F.lit("low-quality").alias("tag"))
    return language.unionByName(toxic).unionByName(low)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents as single text chunks, with the flags of their documents."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("document_id"), F.lit("TEXT").alias("chunk_type"), F.lit(0).alias("page_index"), F.lit(0).alias("chunk_index"), F.col("text").alias("content"), "active", "local_only", "title", "source_path", "source_type")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedded chunks; a label is their document."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("document_id"), "embedding", F.lit("stand-in/64").alias("embedding_model"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns: a conversation is a document or session, a turn a chunk, message or page."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "turn", "role", F.col("text").alias("content"))


def tracked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folder rows for two thirds and more of the documents, some ignored, malformed or duplicate."""
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 7 != 0)
    k = F.col("doc_id")
    state = F.when(k % 13 == 0, "ignored").when(k % 17 == 0, "malformed").when(k % 19 == 0, "duplicate").otherwise("synced")
    return d.select(F.concat(F.lit("f/"), k.cast("string"), F.lit(".txt")).alias("path"), (k * 1000).alias("last_modified"), F.col("n_chars").alias("size"), state.alias("state"), F.when(state == "synced", k).alias("document_id"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the folder holds now."""
    d = table(spark, sf_dir, "documents").filter(F.col("doc_id") % 5 != 0)
    k = F.col("doc_id")
    return d.select(F.concat(F.lit("f/"), k.cast("string"), F.lit(".txt")).alias("path"), (k * 1000 + F.when(k % 11 == 0, 1).otherwise(0)).alias("last_modified"), F.col("n_chars").alias("size"))


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as index changes: an error removes a document, anything else puts one of its chunks."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "remove").otherwise("put")
    key = F.when(F.col("event_type") == "signup", "other/64").otherwise("stand-in/64")
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("document_id"), (F.col("user_id") * 10 + F.col("event_id") % 5).alias("chunk_id"), kind.alias("kind"), key.alias("embedding_model"), "value")


def log_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").when(F.col("event_type") == "purchase", "info").otherwise("debug")
    return e.select(F.col("event_id").alias("id"), "ts", level.alias("level"), F.col("event_type").alias("subsystem"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value")
