"""Quantiles by selection against DuckDB and numpy; slopes along the wind against numpy."""

import math
import struct

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import quantiles as Q
from quillmap.operators import stats


def test_codes_follow_the_order_of_doubles(spark):
    rng = np.random.default_rng(1)
    some = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, math.nextafter(2.0**-1022, 0), 1.0, math.nextafter(1, 0), math.nextafter(1, 2), 2.0**1023, 1.7976931348623157e308, math.inf, -math.inf, 0.1, -0.1, 3.0, 1e-310]
    some += [s * math.ldexp(1.0, int(e)) for e in rng.integers(-1074, 1023, 60) for s in (1, -1)] + [math.nextafter(math.ldexp(1.0, int(e)), d) for e in rng.integers(-1000, 1000, 60) for d in (0, math.inf)]
    some += struct.unpack("<400d", rng.integers(0, 2**63, 400, dtype=np.uint64).astype("<u8").tobytes())
    some = [x for x in some if x == x]
    got = {r["x"]: r["c"] for r in spark.createDataFrame([(float(x),) for x in some], "x double").select("x", Q.ordered_code(F.col("x")).alias("c")).collect()}
    for x, c in got.items():
        bits = struct.unpack("<q", struct.pack("<d", abs(x)))[0]
        assert c == (-bits if x < 0 else bits), x
    assert spark.createDataFrame([(math.nan,), (None,)], "x double").select(Q.ordered_code(F.col("x")).alias("c")).collect()[1]["c"] is None


@pytest.mark.parametrize("most", [65_536, 40])
def test_quantiles_equal_numpy_in_any_number_of_passes(spark, monkeypatch, most):
    monkeypatch.setattr(Q, "SORTED", most)
    rng = np.random.default_rng(2)
    rows = [("a", float(x)) for x in rng.lognormal(0, 20, 700)] + [("b", float(x)) for x in rng.integers(0, 3, 900)] + [(None, float(x)) for x in -rng.random(50)] + [("c", 7.0), ("d", None), ("a", None), ("e", 1.0), ("e", 1.0 + 2**-52)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["group"]: (r["lo"], r["mid"], r["p98"]) for r in Q.quantiles(df, F.col("v"), {"lo": 0.0, "mid": 0.5, "p98": 0.98}, F.col("g")).collect()}
    assert set(got) == {"a", "b", "c", "d", "e", None} and got["d"] == (None, None, None)
    for g in ("a", "b", "c", "e", None):
        v = [x for k, x in rows if k == g and x is not None]
        assert np.allclose(got[g], np.quantile(v, [0, 0.5, 0.98]), rtol=1e-12, atol=0)
    assert Q.quantiles(df.limit(0), F.col("v"), {"mid": 0.5}).collect()[0]["mid"] is None
    assert Q.quantiles(df.limit(0), F.col("v"), {"mid": 0.5}, F.col("g")).count() == 0


def test_quantiles_of_a_continuous_column_equal_duckdb(spark, monkeypatch):
    monkeypatch.setattr(Q, "SORTED", 500)
    path = "/root/testdata/sf0.01/lineitem.parquet"
    want = duckdb.sql(f"SELECT l_returnflag, quantile_cont(ln(l_extendedprice) * l_tax, 0.95), quantile_cont(ln(l_extendedprice) * l_tax, 0.5) FROM read_parquet('{path}') GROUP BY 1").fetchall()
    rows = spark.read.parquet(path)
    got = Q.quantiles(rows, F.ln("l_extendedprice") * F.col("l_tax"), {"p95": 0.95, "mid": 0.5}, F.col("l_returnflag")).collect()
    assert sorted((r["group"], round(r["p95"], 9), round(r["mid"], 9)) for r in got) == sorted((g, round(a, 9), round(b, 9)) for g, a, b in want)


def test_deviations_and_slopes_equal_numpy(spark):
    rng = np.random.default_rng(3)
    d = np.abs(rng.normal(0, 2, 500))
    df = spark.createDataFrame([(float(x),) for x in d] + [(None,)] * 100, "d double")
    r = stats.deviation_stats(df, F.col("d")).first()
    assert np.allclose([r["coverage"], r["rms"], r["p95"], r["p99"], r["most"], r["mean"]], [500 / 600, math.sqrt((d * d).mean()), *np.quantile(d, [0.95, 0.99]), d.max(), d.mean()])
    assert stats.deviation_stats(df.limit(0), F.col("d")).first()["p95"] is None
    h = rng.normal(0, 3, (12, 17))
    raster = spark.createDataFrame([(i, j, float(h[i, j])) for i in range(12) for j in range(17)], "i int, j int, h double")
    slopes = stats.wind_slopes(raster, 2.5, (0.8, -0.6))
    dz, dx = np.gradient(h, 2.5)
    want = dx * 0.8 - dz * 0.6
    for r in slopes.collect():
        assert abs(r["slope"] - want[r["i"], r["j"]]) < 1e-12
    a = stats.slope_asymmetry(slopes, F.col("slope"), 0.4).first()
    up, down = want[want > 0], -want[want < 0]
    assert np.allclose([a["up"], a["down"], a["steep_up"], a["steep_down"]], [*(math.degrees(math.atan(np.percentile(x, 95))) for x in (up, down)), (up > 0.4).mean(), (down > 0.4).mean()])
