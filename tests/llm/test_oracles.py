import pytest

from stratalode.llm.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    with duckdb.connect() as db:
        for t in ("documents", "pages", "benchmark"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        want = db.execute(ORACLES[name])
        names = [d[0] for d in want.description]
        expected = sorted(map(repr, want.fetchall()))
    got = QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert sorted(repr(tuple(r)) for r in got.select(*names).collect()) == expected
