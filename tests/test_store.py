import pytest
from pyspark.sql import functions as F

from stratalode.operators import store
from stratalode.plans.schema import schema

DOC = "id string, source_type string, local_only boolean, created_at string"


def test_versions(spark, tmp_path):
    t = store.Table(spark, str(tmp_path / "t"), schema("tags"))
    assert t.read().count() == 0
    t.commit(spark.createDataFrame([("a", "x")], "name string, created_at string"))
    t.commit(t.read().unionByName(spark.createDataFrame([("b", "y")], "name string, created_at string")), files=1)
    assert t.version() == 1 and t.read().count() == 2 and t.read(0).count() == 1


def test_store_and_remove(spark):
    docs = spark.createDataFrame([("d1", "TEXT", True, "t0"), ("d2", "TEXT", False, "t0")], DOC)
    chunks = spark.createDataFrame([("d1", "c1"), ("d2", "c2")], "document_id string, id string")
    new = spark.createDataFrame([("d1", "TEXT", False, "t1"), ("d3", "CSV", False, "t1")], DOC)
    d, c = store.stored(docs, chunks, new, spark.createDataFrame([("d1", "c9"), ("d3", "c8")], "document_id string, id string"))
    assert sorted(map(tuple, d.collect())) == [("d1", "TEXT", True, "t0"), ("d2", "TEXT", False, "t0"), ("d3", "CSV", False, "t1")]
    assert sorted(r["id"] for r in c.collect()) == ["c2", "c8", "c9"]
    assert [r[0] for r in d.orderBy("id").select(store.embeds(F.col("source_type"), F.col("local_only"), True)).collect()] == [False, True, False]
    tags = spark.createDataFrame([("d1", "t"), ("d2", "t")], "document_id string, tag string")
    files = spark.createDataFrame([("p1", "d1", "synced", "m"), ("p2", "d2", "synced", "m")], "path string, document_id string, state string, managed_path string")
    left = store.removed(spark.createDataFrame([("d1",)], "id string"), docs, chunks, tags, files)
    assert [left[k].count() for k in ("documents", "chunks", "tags", "files")] == [1, 1, 1, 2]
    assert left["files"].filter("state = 'ignored'").first()["document_id"] is None
    assert store.removed(spark.createDataFrame([("d1",)], "id string"), docs, chunks, tags, files, forget=True)["files"].count() == 1


def test_settings(spark):
    t = spark.createDataFrame([("a", "A", 0), ("b", "B", 1)], "id string, name string, sort_order int")
    assert sorted(map(tuple, store.put(t, {"id": "a", "name": "Z"}).collect())) == [("a", "Z", 0), ("b", "B", 1)]
    assert store.put(t, {"id": "c", "name": "C"}).count() == 3 and store.deleted(t, ["a"]).count() == 1
    assert {r["id"]: r["sort_order"] for r in store.reordered(t, ["b", "a"]).collect()} == {"b": 0, "a": 1}
    with pytest.raises(Exception, match="exactly"):
        store.reordered(t, ["a"]).collect()
    assert {r["id"]: r["name"] for r in store.changed(t, {"name": F.lit("x")}, ["b"]).collect()} == {"a": "A", "b": "x"}
    tags = spark.createDataFrame([("d", "x")], "document_id string, tag string")
    more = store.assigned(tags, ["d", "e"], ["x", "y"])
    assert more.count() == 4 and store.unassigned(more, ["d"], ["x", "y"]).count() == 2
