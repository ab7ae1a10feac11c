"""Every registered query against its DuckDB oracle on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from horarium import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
            return "null"
        if isinstance(x, float):
            return f"{x:.9g}"
        return str(x)[:10] if hasattr(x, "year") else str(int(x)) if isinstance(x, bool) else str(x)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, con, name):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    if name in registry.ORACLE_SQL:
        want = con.execute(registry.ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert plain(got) == plain(want)
