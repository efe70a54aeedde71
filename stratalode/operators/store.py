"""Tables that change: copy-on-write versions under a folder, and the mutations of documents, tags and settings.

A mutation is a new DataFrame; ``commit`` writes it as the next version and then moves the pointer, so readers see a
whole version and a failed write leaves the old one. There is one writer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import sync


class Table:
    """A versioned table: ``path/v<n>`` holds version n, ``path/current`` one row with the number that counts."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def version(self) -> int:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/current")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return -1
        return self.spark.read.schema("version int").parquet(f"{self.path}/current").agg(F.max("version")).first()[0]

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.createDataFrame([], self.schema) if version < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/v{version}")

    def commit(self, rows: DataFrame, *, files: int | None = None) -> int:
        """Write ``rows`` as the next version; ``files`` compacts them into so many."""
        version = self.version() + 1
        (rows.repartition(files) if files else rows).select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/v{version}")
        self.spark.createDataFrame([(version,)], "version int").write.mode("append").parquet(f"{self.path}/current")
        return version


def stored(documents: DataFrame, chunks: DataFrame, new_document: DataFrame, new_chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) with documents put and all their chunks replaced; a document that was local-only stays so."""
    old = documents.select("id", F.col("local_only").alias("_was"), F.col("created_at").alias("_made"))
    put = new_document.join(old, "id", "left").withColumns({"local_only": F.col("local_only") | F.coalesce("_was", F.lit(False)), "created_at": F.coalesce("_made", "created_at")}).drop("_was", "_made")
    gone = chunks.join(new_document.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return sync.upserted(documents, put.select(*documents.columns), ["id"]), gone.select(*chunks.columns).unionByName(new_chunks.select(*chunks.columns))


def embeds(source_type: Column, local_only: Column, remote: bool) -> Column:
    """Whether a document's chunks get vectors: no CSV, and nothing local-only by a remote provider."""
    return (source_type != "CSV") & (F.lit(not remote) | ~local_only)


def removed(ids: DataFrame, documents: DataFrame, chunks: DataFrame, tags: DataFrame, files: DataFrame, *, forget: bool = False) -> dict[str, DataFrame]:
    """All tables without documents (id) and what hangs on them; their folder rows become ignored, or go."""
    key = ids.select(F.col("id").alias("document_id")).distinct()
    owned = files.join(key, "document_id", "left_semi")
    kept = files.join(key, "document_id", "left_anti").select(*files.columns)
    ignored = owned.withColumns({"state": F.lit("ignored"), "document_id": F.lit(None).cast(files.schema["document_id"].dataType), "managed_path": F.lit(None).cast("string")}).select(*files.columns)
    return {
        "documents": documents.join(ids.select("id").distinct(), "id", "left_anti"),
        "chunks": chunks.join(key, "document_id", "left_anti").select(*chunks.columns),
        "tags": tags.join(key, "document_id", "left_anti").select(*tags.columns),
        "files": kept if forget else kept.unionByName(ignored),
    }


def changed(table: DataFrame, values: dict[str, Column], ids: list | None = None, *, key: str = "id") -> DataFrame:
    """``table`` with columns set on the rows of the ids, or on all rows if none are given."""
    hit = F.lit(True) if ids is None else F.col(key).isin(ids)
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()}).select(*table.columns)


def assigned(tags: DataFrame, documents: list, names: list[str]) -> DataFrame:
    spark = tags.sparkSession
    pairs = spark.createDataFrame([(d, n) for d in documents for n in names], tags.select("document_id", "tag").schema)
    return sync.inserted_or_ignored(tags.select("document_id", "tag"), pairs, ["document_id", "tag"])


def unassigned(tags: DataFrame, documents: list, names: list[str]) -> DataFrame:
    return tags.filter(~(F.col("document_id").isin(documents) & F.col("tag").isin(names)))


def by_name(table: DataFrame, *, name: str = "name") -> DataFrame:
    return table.orderBy(F.lower(name), name)


def found(table: DataFrame, value, *, key: str = "id") -> DataFrame:
    return table.filter(F.col(key) == F.lit(value)).limit(1)


def put(table: DataFrame, row: dict, *, key: str = "id") -> DataFrame:
    """A settings row inserted, or its given columns updated."""
    spark = table.sparkSession
    fresh = spark.createDataFrame([tuple(row.get(f.name) for f in table.schema)], StructType([type(f)(f.name, f.dataType, True) for f in table.schema]))
    old = table.filter(F.col(key) == F.lit(row[key]))
    merged = fresh.alias("n").join(old.alias("o"), F.col(f"n.{key}") == F.col(f"o.{key}"), "left").select(*[(F.col(f"n.{c}") if c in row else F.col(f"o.{c}")).alias(c) for c in table.columns])
    return sync.upserted(table, merged, [key])


def deleted(table: DataFrame, values: list, *, key: str = "id") -> DataFrame:
    return table.filter(~F.col(key).isin(values))


def reordered(table: DataFrame, ids: list, *, key: str = "id", order: str = "sort_order") -> DataFrame:
    """Rows numbered in the order of ``ids``, which must be exactly the ids of the table."""
    spark = table.sparkSession
    places = spark.createDataFrame(list(enumerate(ids)), f"_place int, {key} {table.schema[key].dataType.simpleString()}")
    checked = table.join(places, key, "full_outer")
    bad = F.col("_place").isNull() | F.col(order).isNull()
    return checked.withColumn(order, F.when(bad, F.raise_error(F.lit("ids must be exactly those of the table")).cast("int")).otherwise(F.col("_place"))).select(*table.columns)


def tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls with the result of the same call id, if there is one."""
    return calls.join(results.select("tool_call_id", F.col("content").alias("result")), "tool_call_id", "left")
