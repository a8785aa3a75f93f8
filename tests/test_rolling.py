"""Rolling moments equal brute force on rows with sentinels, spikes, offsets and gaps, whole and in chunks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import ordered
from tidewatt.operators.seasonal import seasonal_decompose
from tidewatt.spec import SeriesSpec

N = 9000
WINDOWS = (3, 16, 17, 96, 4320)


def faults():
    rng = np.random.default_rng(11)
    clean, other = rng.normal(size=N), rng.normal(size=N)
    sentinels = clean.copy()
    sentinels[[0, 1, 700, 701, 5000]] = -999999.0
    spike = clean.copy()
    spike[5] = 1e8
    gaps = clean.copy()
    gaps[rng.random(N) < 0.1] = np.nan
    gaps[300:420] = np.nan
    return {"sentinels": sentinels, "spike": spike, "offset": clean + 1e9, "gaps": gaps, "constant": np.full(N, 0.1)}, other


CASES, OTHER = faults()


@pytest.fixture(scope="module")
def frames(spark):
    out = {}
    for name, v in CASES.items():
        pdf = pd.DataFrame({"id": np.arange(N), "v": v, "o": OTHER})
        df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("id").cast("timestamp_ntz")).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
        out[name] = df.repartition(4).cache()
    return out


def windows_of(v, w):
    """Rows by window, the first rows of the series padded with missing values."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(w - 1, np.nan), v]), w)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("size", [None, 1500])
def test_rolling_full(frames, case, size):
    windows = WINDOWS if size is None else WINDOWS[:-1]
    got = ordered.rolling_full(frames[case], SeriesSpec("ts", (), ("v",)), windows, size).orderBy("id").toPandas()
    for w in windows:
        rows = windows_of(CASES[case], w)
        centre = np.where(np.isnan(rows), np.nan, rows).mean(axis=1)
        std = np.sqrt(((rows - centre[:, None]) ** 2).sum(axis=1) / (w - 1))
        assert np.allclose(got[f"vroll_mean{w}"].astype(float), centre, rtol=1e-9, atol=1e-9, equal_nan=True)
        assert np.allclose(got[f"vroll_std{w}"].astype(float), std, rtol=1e-9, atol=1e-6 if case == "offset" else 1e-9, equal_nan=True)


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("size,window", [(None, 4320), (1500, 96)])
def test_rolling_corr(frames, case, size, window):
    got = ordered.rolling_corr(frames[case], SeriesSpec("ts", (), ("v", "o")), window, 2, size).orderBy("ts").toPandas()["rolling_corr"].astype(float)
    x, y = windows_of(CASES[case], window), windows_of(OTHER, window)
    want = np.full(N, np.nan)
    for i in range(N):
        both = ~(np.isnan(x[i]) | np.isnan(y[i]))
        a, b = x[i][both], y[i][both]
        if len(a) >= 2 and a.max() > a.min():
            a, b = a - a.mean(), b - b.mean()
            want[i] = a @ b / np.sqrt((a @ a) * (b @ b))
    assert np.allclose(got, want, atol=1e-6 if case == "offset" else 1e-9, equal_nan=True)


@pytest.mark.parametrize("period", [1, 2, 7, 96])
def test_trend_beside_a_sentinel(frames, period):
    df = frames["sentinels"].where("id < 1200")
    got = seasonal_decompose(df, SeriesSpec("ts", (), ("v",)), period, extrapolate=False, rows_per_chunk=300).orderBy("idx").toPandas()["trend"].astype(float)
    half, weights = period // 2, np.ones(period + 1 - period % 2)
    if period % 2 == 0:
        weights[[0, -1]] = 0.5
    want = np.full(1200, np.nan)
    want[half : 1200 - half] = np.convolve(CASES["sentinels"][:1200], weights / period, "valid")
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_same_bits_whole_and_in_chunks(frames):
    spec = SeriesSpec("ts", (), ("v",))
    one, two = (ordered.rolling_full(frames["sentinels"], spec, (96,), n).select("id", "vroll_std96").orderBy("id").collect() for n in (None, 400))
    assert one == two
