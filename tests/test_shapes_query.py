"""The shapes query takes whole names."""

import duckdb

from quillon import queries

SF = "/root/testdata/sf0.001"


def test_whole_names(spark):
    found = {(r["v"], r["shape"]) for r in queries.QUERIES["shapes"](spark, SF).collect()}
    told = duckdb.execute(f"SELECT c_mktsegment FROM '{SF}/customer.parquet' UNION SELECT c_name FROM '{SF}/customer.parquet'").fetchall()

    def plain(v):
        return "".join("A" if c.isalpha() else "9" if c.isdecimal() else c if c in "-./:+()@,#_ " else "?" for c in v)

    assert found == {(v, plain(v)) for (v,) in told}
    assert max(len(v) for v, _ in found) == 18
