"""Row keys, exact copies and shared storage for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under the folder that driver and executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext._jsc.sc().getCheckpointDir().getOrElse(None) if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="stratalode-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(spark: SparkSession, frame: DataFrame, at: str | None = None) -> DataFrame:
    """``frame`` written to the shared folder and read again: lineage ends here and no executor holds the only copy."""
    at = at or shared_dir(spark)
    frame.write.parquet(at)
    return spark.read.schema(frame.schema).parquet(at)


def discard(spark: SparkSession, at: str) -> None:
    """Remove a stored intermediate that no result reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(frame: DataFrame) -> DataFrame:
    """A scanned table that lies in fewer splits than there are cores, dealt over them; a table of many splits stays where it is."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    plan = frame._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in plan.toString() or plan.execute().getNumPartitions() >= cores:
        return frame
    return frame.repartition(cores)


def free_name(frame: DataFrame, name: str = "_j") -> str:
    """A column name that ``frame`` does not have, whatever the case."""
    taken = {c.lower() for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def with_key(spark: SparkSession, documents: DataFrame, id_col: str, text_col: str, key: str = "j", at: str | None = None) -> DataFrame:
    """``documents`` with a unique long ``key`` in the order of (id, text), nulls last.

    Where ids are unique and not null, the key is the id. Otherwise rows are numbered in order and stored, so
    equal rows are told apart and a repeated row counts as a later one. Ranges are cut by id and the first characters
    of the text, which is all that the driver sees a sample of.
    """
    number = F.col(id_col).cast("long")
    odd = documents.select(number.alias("id")).groupBy("id").count().filter("count > 1 or id is null")
    if odd.isEmpty():
        return documents.withColumn(key, number)
    order = [F.asc_nulls_last(id_col), F.asc_nulls_last(text_col)]
    lead = F.asc_nulls_last(F.substring(F.col(text_col).cast("string"), 1, 32))
    return stored(spark, documents.repartitionByRange(order[0], lead).sortWithinPartitions(*order).withColumn(key, F.monotonically_increasing_id()), at)


def keyed(spark: SparkSession, documents: DataFrame, id_col: str, text_col: str, at: str | None = None) -> DataFrame:
    """(j, id, text): the key of :func:`with_key`, and text with null as empty."""
    rows = documents.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return with_key(spark, rows, "id", "text", at=at).select("j", "id", "text")


def copies(rows: DataFrame) -> DataFrame:
    """(j, lead, copies) of the rows whose text another row has too; lead is the smallest j. Light rows only."""
    light = rows.select("j", F.xxhash64("text").alias("d"), F.xxhash64(F.lit(7), "text").alias("e"))
    groups = light.groupBy("d", "e").agg(F.min("j").alias("lead"), F.count("*").alias("copies")).filter("copies > 1")
    return light.join(groups, ["d", "e"]).select("j", "lead", "copies")


def without_copies(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch of (j, text, ...) with only the smallest j of each text, so that a hot text is met once a batch."""
    code = batch.column(1).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    order = np.lexsort((batch.column(0).to_numpy(), code))
    first = np.ones(len(code), bool)
    first[1:] = code[order[1:]] != code[order[:-1]]
    return batch if first.all() else batch.take(pa.array(np.sort(order[first])))
