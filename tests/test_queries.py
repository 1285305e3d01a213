"""Every registered query that SQL can say, against its SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from canopy.plans import coverage, queries

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def _plain(v):
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else None if isinstance(v, float) and v != v else v


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sql, name):
    found = queries.QUERIES[name](spark, DATA)
    want = sql.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(found.columns)
    rows = [[_plain(r[c]) for c in columns] for r in found.collect()]
    assert sorted(map(repr, rows)) == sorted(repr([_plain(v) for v in r]) for r in want.fetchall())


@pytest.fixture(scope="module")
def small_vectors(tmp_path_factory):
    """Components that round to zero from either side, and halves of the last digit."""
    at = str(tmp_path_factory.mktemp("vectors"))
    cell = "CASE WHEN v % 3 = 0 THEN 1 ELSE -1 END * CASE WHEN i % 2 = 0 THEN 1e-7 * (1 + v % 7) ELSE i / 64.0 + 0.0000005 END"
    duckdb.execute(f"COPY (SELECT v AS vec_id, (v % 3)::INTEGER AS label, list_transform(generate_series(1, 64), lambda i: ({cell})::FLOAT) AS embedding FROM range(60) t(v)) TO '{at}/embeddings.parquet'")
    return at


@pytest.mark.parametrize("name", ["blended_units", "container_vectors", "vector_blends", "file_contents", "rolled_up"])
def test_signs_of_zeros_equal_sql(spark, small_vectors, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{small_vectors}/embeddings.parquet')")
    want = c.execute(queries.SQL[name])
    columns = [d[0] for d in want.description]
    want, found = [repr(list(r)) for r in want.fetchall()], queries.QUERIES[name](spark, small_vectors).collect()
    assert "-0.0," in "".join(want)
    assert sorted(repr([r[c] for c in columns]) for r in found) == sorted(want)


@pytest.mark.parametrize("name", ["advice", "bloated_files", "dendrogram_merges", "unit_positions", "pattern_containers", "placement_paths"])
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0


def test_coverage_is_registered():
    assert {"vector_blends", "unit_scan", "snapshot_history"} <= set(coverage.query.__globals__["QUERIES"]) & set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
