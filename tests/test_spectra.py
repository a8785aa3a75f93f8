"""The distributed transform against numpy's, for odd lengths, small tasks and a million rows; peaks range by range."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.operators import spectra
from tidewatt.spec import SeriesSpec

SPEC = SeriesSpec("ts", ("k",), ("x",), ())


def powers(y):
    t = np.arange(len(y))
    return np.abs(np.fft.rfft(y - np.polyval(np.polyfit(t, y, 1), t))[1:]) ** 2


@pytest.mark.parametrize("n", [10, 11, 97, 128, 1000, 4099])
@pytest.mark.parametrize("cells", [1, 64, 1 << 18])
def test_steps_give_the_transform(n, cells):
    y = np.random.default_rng(n).normal(size=n)
    rows, columns, wide, high = spectra.grid(n, cells)
    assert rows * columns >= n + n // 2 + 1
    idx = np.arange(n)
    bands = [np.flatnonzero(idx % columns // wide == b) for b in range(columns // wide)]
    down = np.concatenate([spectra.down_columns(idx[m], y[m], n, b, cells) for b, m in enumerate(bands)], axis=2)
    across = np.concatenate([spectra.along_rows(down[:, b * high : (b + 1) * high], n, b, cells) for b in range(rows // high)])
    got = np.full(n // 2 + 1, np.nan)
    for b in range(columns // wide):
        bins, power = spectra.up_columns(across[:, b * wide : (b + 1) * wide], n, b, cells)
        got[bins] = power
    assert np.allclose(got[1:], np.abs(np.fft.rfft(y))[1:] ** 2, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("cells", [None, 16, 100])
def test_many_series_of_odd_lengths(spark, cells):
    rng, parts = np.random.default_rng(3), []
    for k, n in (("a", 400), ("b", 97), ("c", 10), (None, 131), ("short", 9)):
        parts.append(pd.DataFrame({"k": k, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), unit="h"), "x": 1e6 + rng.normal(size=n)}))
    df = spark.createDataFrame(pd.concat(parts), "k string, ts timestamp_ntz, x double").repartition(5)
    got = spectra.spectrum(df, SPEC, cells).toPandas()
    assert sorted(got["k"].dropna().unique()) == ["a", "b", "c"]
    for p in parts[:-1]:
        k = p["k"].iloc[0]
        own = got[got["k"].isna() if k is None else got["k"] == k].sort_values("bin")
        assert own["bin"].tolist() == list(range(1, len(p) // 2 + 1)) and (own["steps"] == len(p)).all()
        assert np.allclose(own["power"], powers(p["x"].to_numpy()), rtol=1e-5, atol=1e-5)


def test_a_million_rows(spark):
    n = 1_000_003
    t = np.arange(n)
    want = powers(np.sin(2 * np.pi * t / 1440) + np.sin(2 * np.pi * t / 300_000) + t / n + t * 7919 % 1000 / 1000)
    i = F.col("id")
    x = F.sin(2 * np.pi * i / 1440) + F.sin(2 * np.pi * i / 300_000) + i / n + i * 7919 % 1000 / 1000
    df = spark.range(n).select(F.timestamp_seconds(i * 60).alias("ts"), F.lit("a").alias("k"), x.alias("x"))
    got = spectra.spectrum(df, SPEC).select("bin", "power").toArrow().to_pandas().sort_values("bin")
    assert got["bin"].tolist() == list(range(1, n // 2 + 1)) and np.allclose(got["power"], want, rtol=1e-6, atol=1e-4)


@pytest.mark.parametrize("range_bins", [1, 2, 3, 7, 1000])
def test_peaks_do_not_depend_on_ranges(spark, range_bins):
    rng = np.random.default_rng(4)
    rows = pd.concat([
        pd.DataFrame({"k": "noise", "bin": np.arange(1, 61), "power": rng.integers(0, 9, 60).astype(float)}),
        pd.DataFrame({"k": "falling", "bin": np.arange(1, 21), "power": np.arange(20.0, 0, -1)}),
        pd.DataFrame({"k": "one", "bin": [1], "power": [3.0]}),
    ])
    got = spectra.peaks(spark.createDataFrame(rows), ["k"], 4, range_bins).orderBy("k", "rank").toPandas()
    for k, p in rows.groupby("k"):
        v = p["power"].to_numpy()
        at = [i for i in range(1, len(v) - 1) if v[i] > v[i - 1] and v[i] > v[i + 1]] or list(range(len(v)))
        want = sorted(at, key=lambda i: (-v[i], i))[:4]
        assert got[got["k"] == k]["bin"].tolist() == p["bin"].to_numpy()[want].tolist()


def test_no_series_at_all(spark):
    df = spark.createDataFrame([], "k string, ts timestamp_ntz, x double")
    assert spectra.dominant_periods(df, SPEC, 60).count() == 0
