import duckdb
import pytest

from roundwise.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    res = con.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in res.description)
    want = sorted(tuple(r[[d[0] for d in res.description].index(n)] for n in names) for r in res.fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == names and sorted(map(tuple, df.select(*names).collect())) == want
