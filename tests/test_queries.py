"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import cmath
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from chronoweave import catalogue
from chronoweave.operators import signal

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    v = float(v)
    return None if math.isnan(v) else round(v, 5) + 0.0


def close(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and abs(a - b) <= 2e-5 + 1e-9 * abs(a))


def same(rows, other):
    rows, other = sorted(rows, key=str), sorted(other, key=str)
    return len(rows) == len(other) and all(all(map(close, x, y)) for x, y in zip(rows, other))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, con, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    cur = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    assert same(got, want)


@pytest.mark.parametrize("name", ["adf_test", "kalman_track", "monte_carlo", "page_records", "granger_test"])
def test_gives_rows(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


def test_full_spectrum(spark, tmp_path):
    rng = np.random.default_rng(3)
    series = {"a": rng.standard_normal(150), "b": rng.standard_normal(37)}
    rows = [(k, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i), float(y)) for k, v in series.items() for i, y in enumerate(v)]
    pd.DataFrame(rows, columns=["event_type", "ts", "value"]).astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet")
    got = {(r["series_id"], r["k"]): r for r in catalogue.QUERIES["full_spectrum"](spark, str(tmp_path)).collect()}
    want = {(s, k): sum(y * cmath.exp(-2j * math.pi * k * i / len(v)) for i, y in enumerate(v)) for s, v in series.items() for k in range(len(v) // 2 + 1)}
    assert got.keys() == want.keys()
    for key, f in want.items():
        r = got[key]
        own = signal.spectrum(np.array(series[key[0]])).iloc[key[1]]
        assert abs(complex(own["re"], own["im"]) - f) < 1e-9 and abs(own["magnitude"] - abs(f)) < 1e-9
        assert abs(complex(r["re"], r["im"]) - f) < 1e-5 and abs(r["magnitude"] - abs(f)) < 1e-5  # the query rounds to five places
        assert r["frequency"] == pytest.approx(key[1] / len(series[key[0]]), abs=1e-6)
