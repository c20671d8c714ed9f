"""The registered queries against DuckDB on the smallest tables."""

import importlib
import os

import pytest

FOLDER = os.environ.get("SEQ_TABLES", "/root/testdata/sf0.001")


def names():
    from seqspark.catalogue import QUERIES

    return list(QUERIES)


def test_every_oracle_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries
    from check import TABLES, canonical

    got = queries()[name](spark, FOLDER).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()
    assert canonical(got).equals(canonical(want))


def test_the_runs_of_a_restarted_store_share_their_arrivals(spark, tmp_path, monkeypatch):
    made, streams = [], importlib.import_module("seqspark.catalogue.streams")
    rows = spark.range(1, 61).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id % 2 AS user_id", "'view' AS event_type", "id AS arrival_seq")
    monkeypatch.setattr(streams, "arrivals", lambda *_: made.append(1) or rows)
    monkeypatch.setattr(streams, "ROWS_PER_FILE", 2)
    monkeypatch.setattr(streams, "scratch", lambda _: str(tmp_path))
    taken = []

    class Job:
        def awaitTermination(self):
            pass

    def job(stream, *_, **kw):
        files = {r["f"] for r in spark.read.parquet(f"{tmp_path}/in").selectExpr("input_file_name() AS f").collect()}
        taken.append((spark.read.parquet(f"{tmp_path}/in").count(), len(files)))
        return Job()

    monkeypatch.setattr(streams, "stream_match_batch", job)
    streams.restarted_store(spark, None, None, False)
    assert len(made) == 1 and [n for n, _ in taken] == [33, 60]
    assert taken[0][1] > 3 * streams.FILES  # portions of 11 rows in files of two
