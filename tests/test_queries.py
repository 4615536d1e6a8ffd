"""Every registered query with SQL, held against DuckDB on the small tables."""

import duckdb
import pandas as pd
import pytest

from palimpsest.plans.queries import QUERIES, SQL, flagship

SF = "/root/testdata/sf0.001"


def plain(frame):
    def value(v):
        if pd.isna(v):
            return None
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return float(v) if isinstance(v, (int, float)) or hasattr(v, "dtype") else v

    return sorted((tuple(value(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got, expected = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected) and len(got)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_flagship(spark):
    assert flagship(spark, SF).count() > 0


def test_stream_batches_are_committed_once(spark, tmp_path):
    from palimpsest.streaming.ingest import commit_batch, ingest_once

    path = str(tmp_path / "a")
    source, out = tmp_path / "in", path
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(str(source))
    stream = lambda: spark.readStream.schema("k int, v string").parquet(str(source))
    assert ingest_once(stream(), out, ["k"]).checkout().count() == 2
    spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string").write.mode("append").parquet(str(source))
    a = ingest_once(stream(), out, ["k"])
    assert sorted(map(tuple, a.checkout().collect())) == [(1, "a"), (2, "c"), (3, "d")] and len(a.snapshots()) == 2
    (name,) = a.store.manifest.batches  # the stream's own name: under another one the batch would be another stream's
    commit_batch(path, ["k"], stream=name)(spark.createDataFrame([(9, "x")], "k int, v string"), 1)
    assert len(type(a).load(spark, path).snapshots()) == 2
