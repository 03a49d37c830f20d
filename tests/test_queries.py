"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from fluxgrid.plans import catalogue, kernel_queries  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(df, cols):
    out = [tuple(None if x != x else x for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False)]
    return sorted(out, key=str)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    got = catalogue.QUERIES[name](spark, SF).toPandas()
    cols = sorted(got.columns)
    if name not in catalogue.ORACLE:
        assert len(got) > 0
        return
    want = db.execute(catalogue.ORACLE[name]).df()
    assert sorted(want.columns) == cols
    assert rows(got, cols) == rows(want, cols)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_i2c_enrich_has_all_events(spark, sf):
    at = SF.replace("sf0.001", sf)
    got = catalogue.QUERIES["i2c_enrich"](spark, at).toPandas()
    cols = ["event_id", "abs_frame_idx", "trial", "phase"]
    files = "(SELECT max(vec_id) // 100 + 1 FROM e)"
    e, v = (f"read_parquet('{at}/{t}.parquet')" for t in ("embeddings", "events"))
    want = duckdb.sql(f"WITH e AS (SELECT vec_id FROM {e}) SELECT event_id, event_id // 100 % {files} * 100 + event_id % 100 AS abs_frame_idx, event_id // 10 AS trial, event_id % 10 AS phase FROM {v}").df()
    assert len(got) == len(want) > 500
    assert rows(got, cols) == rows(want, cols)


def test_transient_tail_over_zeros(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    values = "CASE WHEN event_type = 'b' THEN 0.5 ELSE 0 END + CASE WHEN k < 4 THEN 0 WHEN k < 20 THEN 1 + k / 1000 ELSE k END"
    duckdb.sql(f"COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * k AS ts, event_type, CAST({values} AS DOUBLE) AS value FROM range(30) a(k), (VALUES ('a'), ('b')) b(event_type)) TO '{path}'")
    got = catalogue.QUERIES["transient_tail"](spark, str(tmp_path)).toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(catalogue.ORACLE["transient_tail"]).df()
    assert rows(got, ["roi", "tail"]) == rows(want, ["roi", "tail"])
    assert dict(rows(got, ["roi", "tail"]))["a"] == float("inf")


def test_entry(spark):
    assert entry.entry(spark).count() == 1000
    assert set(entry.oracle_sql()) <= set(entry.queries())
