"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import duckdb
import pytest

from codeterra.plans import oracles, queries, service, structure  # noqa: F401  (the last two add their queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages conversations"


@pytest.fixture(scope="module")
def duck():
    made = duckdb.connect()
    for name in TABLES.split():
        made.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return made


def plain(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(f"{x:.6g}" if isinstance(x, float) else str(x) for x in row) for row in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(oracles.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(oracles.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
