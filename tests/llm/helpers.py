import os

DATA = "/root/testdata"
SMALL = f"{DATA}/sf0.001"


def duck(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    return con.execute(sql).df()


def same(ours, theirs, keys):
    import pandas as pd

    cols = sorted(theirs.columns)
    assert sorted(ours.columns) == cols
    a = ours[cols].sort_values(keys).reset_index(drop=True)
    b = theirs[cols].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b, check_dtype=False)
