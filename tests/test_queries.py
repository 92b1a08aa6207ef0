"""Every registered query against its SQL on the smallest tables; the others must run."""

import glob
import math
import os

import duckdb
import pytest

from murmura import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def rows(frame):
    def plain(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) == "<NA>":
            return None
        x = x.item() if hasattr(x, "item") else x
        return 0.0 if isinstance(x, float) and x == 0 else x

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    got = QUERIES[name](spark, data).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    con = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert rows(got) == rows(con.execute(SQL[name]).fetchdf())
