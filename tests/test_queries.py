"""Every query of the catalog against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from optlattice.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(frame):
    rows = []
    for row in frame[sorted(frame.columns)].itertuples(index=False, name=None):
        rows.append(tuple("null" if v is None or v != v else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in row))
    return sorted(rows)


#: Second names of a query, with the same function and SQL, need no second run.
NAMES = {(catalog.QUERIES[n], catalog.ORACLE_SQL[n]): n for n in sorted(catalog.ORACLE_SQL, reverse=True)}


def test_second_names_are_the_same_queries():
    second = set(catalog.ORACLE_SQL) - set(NAMES.values())
    assert len(second) == 12 and all(n.endswith("_whole") and catalog.QUERIES[n] is catalog.QUERIES[n.removesuffix("_whole")] for n in second)


@pytest.mark.parametrize("name", sorted(NAMES.values()))
def test_query(spark, sf_dir, duck, name):
    got, want = catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = plain(got), plain(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        for x, y in zip(a, b, strict=True):
            assert x == y or math.isclose(float(x), float(y), rel_tol=1e-7, abs_tol=1e-6)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
