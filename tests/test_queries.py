"""Registered wave-buoy queries against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from wavejobs.plans import registry

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)

    return [tuple(map(plain, r)) for r in df.itertuples(index=False)]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(registry.ORACLES[name]).fetchdf()
    got = registry.QUERIES[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: tuple(map(str, r))
    assert sorted(rows(got), key=key) == sorted(rows(want), key=key)


def test_velocity_is_consistent(spark):
    df = registry.QUERIES["drift_velocity"](spark, SF).toPandas()
    d = df.dropna(subset=["drifter_speed_m_s"])
    assert len(d) and ((d.drifter_u_m_s**2 + d.drifter_v_m_s**2) ** 0.5 - d.drifter_speed_m_s).abs().max() < 1e-5
    assert (d.drifter_speed_m_s <= 3).all() and set(df.drifter_velocity_qc_flag) <= {1, 4, 9}
