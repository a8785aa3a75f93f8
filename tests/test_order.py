"""Ordered plans give the same rows whatever the chunk size, and match pandas."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatt.plans.order import chunked, count_cells, known_neighbours, with_position
from tidewatt.plans.quantiles import quantile_long, ranked_quantiles
from tidewatt.spec import SeriesSpec

SPEC = SeriesSpec("ts", ("k",), ("v",), ("tie",))


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(3)
    n = 3000
    key = np.where(rng.random(n) < 0.7, "hot", rng.choice(["a", "b", "c"], n))
    seconds = np.where(rng.random(n) < 0.3, 500, rng.integers(0, 100_000, n))
    value = np.where(rng.random(n) < 0.2, np.nan, rng.normal(size=n).round(3))
    pdf = pd.DataFrame({"k": key, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(seconds, unit="s"), "tie": np.arange(n), "v": value})
    df = spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df = df.withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    return pdf.sort_values(["k", "ts", "tie"]).reset_index(drop=True), df


def ordered(df):
    return df.orderBy("k", "ts", "tie").toPandas()


@pytest.mark.parametrize("size", [None, 40, 300])
def test_position(skewed, size):
    pdf, df = skewed
    got = ordered(with_position(df, SPEC, rows_per_chunk=size))
    assert (got["idx"].to_numpy() == pdf.groupby("k").cumcount().to_numpy()).all()


@pytest.mark.parametrize("size,lag", [(40, 1), (40, 100), (300, 7), (None, 7)])
def test_lag_and_lead_across_chunks(skewed, size, lag):
    pdf, df = skewed
    parts = chunked(df, SPEC, before=lag, after=lag, rows_per_chunk=size)
    out = parts.trim(
        parts.frame.withColumn("b", F.lag("tie", lag).over(parts.window)).withColumn("a", F.lead("tie", lag).over(parts.window))
    )
    got = ordered(out)
    assert len(got) == len(pdf)
    for col, step in (("b", lag), ("a", -lag)):
        want = pdf.groupby("k")["tie"].shift(step)
        assert np.array_equal(got[col].to_numpy(dtype=float), want.to_numpy(dtype=float), equal_nan=True)


def test_crowded_instant_is_split_by_tie(skewed):
    _, df = skewed
    cells = count_cells(df, ["k"], ["ts", "tie"], 50)
    assert cells.leaves.agg(F.max("_n")).first()[0] <= 50


@pytest.mark.parametrize("size", [None, 40])
def test_neighbours_carry_over_chunks(skewed, size):
    pdf, df = skewed
    parts = chunked(df, SPEC, rows_per_chunk=size)
    parts = parts.having(parts.frame.withColumn("idx", parts.position))
    out = known_neighbours(parts, ["v"], "idx").withColumn("p", F.col("_prev_v.v")).withColumn("n", F.col("_next_v.v"))
    got = ordered(parts.trim(out).select("k", "ts", "tie", "p", "n"))
    v = pdf.groupby("k")["v"]
    assert np.array_equal(got["p"].to_numpy(dtype=float), v.ffill().to_numpy(), equal_nan=True)
    assert np.array_equal(got["n"].to_numpy(dtype=float), v.bfill().to_numpy(), equal_nan=True)


@pytest.mark.parametrize("keys", [["k"], []])
def test_ranked_quantiles_equal_builtin(skewed, keys):
    pdf, df = skewed
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = ranked_quantiles(df, keys, "v", probs, None, rows_per_chunk=60)
    want = quantile_long(df, keys, "v", probs)
    sort = lambda d: sorted((tuple(r[k] for k in keys), [round(x, 9) for x in r["quantiles"]]) for r in d.collect())
    assert sort(got) == sort(want)
    ties = df.withColumn("v", F.when(F.col("tie") % 3 > 0, F.lit(1.5)).otherwise(F.col("v")))
    assert sort(ranked_quantiles(ties, keys, "v", probs, None, 60)) == sort(quantile_long(ties, keys, "v", probs))


TIES = {
    "long_text": "concat(repeat('x', 199), char(33 + id % 90), repeat('y', 20), format_string('%05d', id))",
    "last_byte": "concat(repeat('x', 199), char(33 + id % 90))",
    "binary": "concat(unhex(repeat('ff', 60)), unhex(lpad(hex(id), 8, '0')))",
    "decimal": "cast(id as decimal(38,0)) + cast('12345678901234567890123456789012345' as decimal(38,0))",
    "above_2_53": "id + 1152921504606846976",
    "negative": "-cast(id as double) / 7",
    "struct": "named_struct('a', id % 5, 'b', id)",
    "nulls": "if(id % 3 > 0, id, null)",
}


@pytest.mark.parametrize("kind", TIES)
def test_any_tie_counts_in_full(spark, kind):
    n = 90 if kind == "last_byte" else 900
    df = spark.range(n).select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.expr(TIES[kind]).alias("tie")).repartition(5)
    spec = SeriesSpec("ts", (), ("id",), ("tie",))
    size = 20 if kind == "last_byte" else 60
    whole, cut = (
        chunked(df, spec, before=2, rows_per_chunk=limit) for limit in (None, size)
    )
    assert not whole.split and cut.split
    got = []
    for parts in (whole, cut):
        rows = parts.trim(parts.frame.withColumn("at", parts.position).withColumn("two", F.lag("id", 2).over(parts.window)))
        got.append({r["id"]: (r["at"], r["two"]) for r in rows.collect()})
    # Rows without a tie-break come last, in no order of their own.
    assert len(got[1]) == n and all(got[0][i] == got[1][i] for i in range(n) if kind != "nulls" or i % 3)
    assert sorted(a for a, _ in got[1].values()) == list(range(n))


@pytest.mark.parametrize("fan_out", [2, 5, 1024])
def test_many_equal_rows_and_small_fan_out(spark, monkeypatch, fan_out):
    from tidewatt.plans import order

    monkeypatch.setattr(order, "FAN_OUT", fan_out)
    df = spark.range(1200).select(F.lit("k").alias("k"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, least(id, 600) % 40)").alias("ts"))
    cells = count_cells(df, ["k"], ["ts"], 50)
    leaves = cells.leaves.collect()
    assert sum(r["_n"] for r in leaves) == 1200
    assert all(r["_n"] <= 50 or r["_lo0"] == r["_hi0"] for r in leaves)
    by = sorted(leaves, key=lambda r: r["_cell"])
    assert all(a["_hi0"] <= b["_lo0"] for a, b in zip(by, by[1:]))
