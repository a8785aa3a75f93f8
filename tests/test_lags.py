"""Lag, seasonal and stationarity operators against numpy, for whole and chunked series."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import lagstats, ordered, seasonal, spectra, stationarity
from tidewatt.spec import SeriesSpec

SPEC = SeriesSpec("ts", ("k",), ("x",), ())
SIZES = [None, 90]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    n = 400
    t = np.arange(n)
    x = 50 + 0.03 * t + 4 * np.sin(2 * np.pi * t / 20) + rng.normal(size=n)
    y = np.roll(x, 3) + rng.normal(size=n)
    walk = np.cumsum(rng.normal(size=n))
    pdf = pd.DataFrame({"k": "a", "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(t, unit="h"), "x": x, "y": y, "walk": walk})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(4).cache()
    return pdf, df


def biased_acf(x, lags):
    c = x - x.mean()
    return np.array([c[k:] @ c[: len(c) - k] for k in range(lags + 1)]) / (c @ c)


@pytest.mark.parametrize("size", SIZES)
def test_acf(series, size):
    pdf, df = series
    got = lagstats.acf(df, SPEC, 30, rows_per_chunk=size).orderBy("lag").toPandas()
    assert np.allclose(got["value"], biased_acf(pdf["x"].to_numpy(), 30), atol=1e-12)


def test_pacf_solves_yule_walker(series):
    pdf, df = series
    got = lagstats.pacf(lagstats.acf(df, SPEC, 12), ["k", "signal"]).orderBy("lag").toPandas()["value"].to_numpy()
    r = biased_acf(pdf["x"].to_numpy(), 12)
    want = [1.0]
    for k in range(1, 13):
        toeplitz = np.array([[r[abs(i - j)] for j in range(k)] for i in range(k)])
        want.append(np.linalg.solve(toeplitz, r[1 : k + 1])[-1])
    assert np.allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("center", [True, False])
def test_ccf_and_best_lag(series, size, center):
    pdf, df = series
    rows = lagstats.ccf(df, SPEC.with_signals("x", "y"), 10, center, size)
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    a, b = (x - x.mean(), y - y.mean()) if center else (x, y)
    full = np.correlate(a, b, "full") / (x.std() * y.std() * len(x))
    mid = len(full) // 2
    assert np.allclose(rows.orderBy("lag").toPandas()["value"], full[mid - 10 : mid + 11], atol=1e-10)
    best = lagstats.best_lag(rows, ["k"]).first()
    seg = full[mid - 10 : mid + 11]
    assert best["best_lag"] == int(np.argmax(np.abs(seg))) - 10


@pytest.mark.parametrize("size", SIZES)
@pytest.mark.parametrize("period", [20, 7])
def test_decompose(series, size, period):
    pdf, df = series
    x, half = pdf["x"].to_numpy(), period // 2
    weights = np.ones(period) if period % 2 else np.r_[0.5, np.ones(period - 1), 0.5]
    trend = np.full(len(x), np.nan)
    trend[half : len(x) - half] = np.convolve(x, weights / period, "valid")
    first, last = half, len(x) - 1 - half
    for lo, hi, target in ((first, min(first + period, last), range(first)), (max(first, last - period), last, range(last + 1, len(x)))):
        k, b = np.polyfit(np.arange(lo, hi), trend[lo:hi], 1)
        for i in target:
            trend[i] = k * i + b
    phase = np.arange(len(x)) % period
    means = np.array([(x - trend)[phase == p].mean() for p in range(period)])
    season = (means - means.mean())[phase]
    got = seasonal.seasonal_decompose(df, SPEC, period, rows_per_chunk=size).orderBy("idx").toPandas()
    assert np.allclose(got["trend"], trend, atol=1e-8) and np.allclose(got["seasonal"], season, atol=1e-8)
    assert np.allclose(got["residual"], x - trend - season, atol=1e-8)


def test_spectrum_equals_fft(series):
    pdf, df = series
    t = np.arange(len(pdf))
    y = pdf["x"].to_numpy() - np.polyval(np.polyfit(t, pdf["x"], 1), t)
    got = spectra.spectrum(df, SPEC).orderBy("bin").toPandas()
    assert np.allclose(got["power"], np.abs(np.fft.rfft(y))[1:] ** 2, rtol=1e-6, atol=1e-6)
    top = spectra.dominant_periods(df, SPEC, 3600).orderBy("rank").first()
    assert (top["period_steps"], top["period_seconds"]) == (20, 72000)


@pytest.mark.parametrize("size", SIZES)
def test_adf_equals_least_squares(series, size):
    pdf, df = series
    got = stationarity.adf_by_difference(df, SPEC.with_signals("x", "walk"), 2, 3, rows_per_chunk=size).toPandas()
    for name in ("x", "walk"):
        for d in range(3):
            level = pdf[name].to_numpy()
            level = level if d == 0 else level[d:] - level[:-d]
            change = np.diff(level)
            at = np.arange(4, len(level))
            design = np.column_stack([np.ones(len(at)), level[at - 1], *[change[at - 1 - j] for j in (1, 2, 3)]])
            coef, *_ = np.linalg.lstsq(design, change[at - 1], rcond=None)
            rest = change[at - 1] - design @ coef
            cov = rest @ rest / (len(at) - 5) * np.linalg.inv(design.T @ design)
            row = got[(got["signal"] == name) & (got["d"] == d)].iloc[0]
            assert row["n_obs"] == len(at) and abs(row["adf_stat"] - coef[1] / np.sqrt(cov[1, 1])) < 1e-6
    hint = {r["signal"]: r["suggested_d"] for r in stationarity.suggest_difference(df, SPEC.with_signals("walk")).collect()}
    assert hint["walk"] >= 1


@pytest.mark.parametrize("size", SIZES)
def test_rolling_against_pandas(series, size):
    pdf, df = series
    full = ordered.rolling_full(df, SPEC, (4, 48), size).orderBy("ts").toPandas()
    for w in (4, 48):
        assert np.allclose(full[f"xroll_mean{w}"].astype(float), pdf["x"].rolling(w).mean(), equal_nan=True)
        assert np.allclose(full[f"xroll_std{w}"].astype(float), pdf["x"].rolling(w).std(), equal_nan=True)
    corr = ordered.rolling_corr(df, SPEC.with_signals("x", "y"), 60, rows_per_chunk=size).orderBy("ts").toPandas()
    assert np.allclose(corr["rolling_corr"].astype(float), pdf["x"].rolling(60, min_periods=30).corr(pdf["y"]), atol=1e-9, equal_nan=True)


def test_adf_orders_and_p_values(spark):
    rng = np.random.default_rng(8)
    n, noise = 1500, rng.normal(size=1500)
    ar = np.zeros(n)
    for i in range(3, n):
        ar[i] = 0.5 * ar[i - 1] - 0.4 * ar[i - 2] + 0.3 * ar[i - 3] + noise[i]
    pdf = pd.DataFrame({"i": np.arange(n), "ar": ar, "walk": np.cumsum(noise)})
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("i").cast("timestamp_ntz"))
    spec = SeriesSpec("ts", (), ("ar", "walk"))
    for size in (None, 300):
        got = {r["signal"]: r for r in stationarity.adf_test(df, spec, "auto", size).collect()}
        most = stationarity.longest_order(n)
        for name in ("ar", "walk"):
            v, c = pdf[name].to_numpy(), np.diff(pdf[name].to_numpy())
            at, best = np.arange(most + 1, n), []
            for p in range(most + 1):
                x = np.column_stack([np.ones(len(at)), v[at - 1], *[c[at - 1 - j] for j in range(1, p + 1)]])
                y = c[at - 1]
                coef = np.linalg.lstsq(x, y, rcond=None)[0]
                rss = ((y - x @ coef) ** 2).sum()
                spread = np.sqrt(rss / (len(at) - p - 2) * np.linalg.inv(x.T @ x)[1, 1])
                best.append((len(at) * np.log(rss / len(at)) + 2 * (p + 2), p, coef[1] / spread))
            _, order, stat = min(best)
            assert got[name]["used_lag"] == order and abs(got[name]["adf_stat"] - stat) < 1e-6
        assert got["ar"]["p_value"] < 0.01 < 0.05 < got["walk"]["p_value"] and got["ar"]["used_lag"] >= 2
    # The surface passes through its own 1, 5 and 10 % limits for long series, and is smooth at the border.
    for limit, p in ((-3.43035, 0.01), (-2.86154, 0.05), (-2.56677, 0.10)):
        assert abs(stationarity.adf_p_value(limit) - p) < 0.002
    assert abs(stationarity.adf_p_value(-1.61) - stationarity.adf_p_value(-1.6099)) < 0.001
    assert (stationarity.adf_p_value(-30.0), stationarity.adf_p_value(3.0)) == (0.0, 1.0)


def test_adf_moments_need_no_whole_regression():
    level, order, skip = np.cumsum(np.random.default_rng(4).normal(size=60_000)), 150, 200
    tracemalloc.start()
    got = stationarity.moments(level, skip, order)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 24e6 < 8 * len(level) * (order + 3)
    change, at = np.diff(level), np.arange(skip, len(level))
    design = np.column_stack([np.ones(len(at)), level[at - 1], *[change[at - 1 - j] for j in range(1, order + 1)], change[at - 1]])
    assert np.allclose(got, (design.T @ design)[np.triu_indices(order + 3)], rtol=1e-9, atol=1e-6)


def test_adf_of_degenerate_series(spark):
    df = spark.range(40).select(F.timestamp_seconds("id").cast("timestamp_ntz").alias("ts"), F.lit(2.0).alias("flat"), F.col("id").cast("double").alias("line"), F.lit(None).cast("double").alias("none"))
    got = {r["signal"]: (r["adf_stat"], r["stationary"]) for r in stationarity.adf_test(df, SeriesSpec("ts", (), ("flat", "line", "none")), "auto").collect()}
    assert got["flat"] == (None, False) and "none" not in got and got["line"][1] is False
