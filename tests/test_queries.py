import os

import pandas as pd
import pytest

from rillflow.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def duck(sql):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{DATA}/{name}'")
    return con.execute(sql).df()


def _plain(df):
    import decimal

    out = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple("" if v is None else repr(round(float(v), 6)) if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool) else str(v) for v in r) for r in out.itertuples(index=False))


@pytest.mark.parametrize("name", list(QUERIES))
def test_rows_equal_the_oracle(spark, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name not in ORACLES:
        assert len(got)
        return
    want = duck(ORACLES[name])
    assert isinstance(want, pd.DataFrame) and sorted(got.columns) == sorted(want.columns)
    assert _plain(got) == _plain(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
