"""Unit-root test, differencing, power transform and model hints."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.functions.values import quoted
from tidewatt.operators.ordered import long_form
from tidewatt.plans.order import chunked, per_chunk
from tidewatt.plans.quantiles import known
from tidewatt.plans.sizing import attach, measured, same_keys
from tidewatt.spec import SeriesSpec

# MacKinnon's (2010) response surface for the 5 % critical value with a constant.
ADF_5PCT = (-2.86154, -2.8903, -4.234, -40.04)
# MacKinnon's (1994) response surface for p-values with a constant: the normal quantile is a
# polynomial of the statistic, one up to the border and one beyond it; outside the ends the p-value is 0 or 1.
ADF_P_LOW, ADF_P_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
ADF_P_ENDS, ADF_P_BORDER = (-18.83, 2.74), -1.61
AUTO = "auto"
# Values (rows times columns) of the regression that a task holds at once: 8 MB, whatever the order.
BLOCK_VALUES = 1_000_000


def adf_p_value(stat: float) -> float:
    """Probability of a statistic this low or lower under a unit root."""
    if stat <= ADF_P_ENDS[0] or stat >= ADF_P_ENDS[1]:
        return 0.0 if stat <= ADF_P_ENDS[0] else 1.0
    powers = ADF_P_LOW if stat <= ADF_P_BORDER else ADF_P_HIGH
    quantile = sum(c * stat**i for i, c in enumerate(powers))
    return 0.5 * math.erfc(-quantile / math.sqrt(2))


def _unpacked(flat) -> np.ndarray:
    """The symmetric matrix whose upper triangle is given row by row."""
    flat = np.asarray(flat, dtype=float)
    size = int((np.sqrt(8 * len(flat) + 1) - 1) / 2)
    full = np.zeros((size, size))
    full[np.triu_indices(size)] = flat
    return full + np.triu(full, 1).T


def nested_orders(full: np.ndarray) -> list[tuple[int, float, float]]:
    """(order, t statistic of the level, information criterion) of every order the moments allow.

    Rows and columns of the moments: constant, level, lagged changes 1 to p, change. The Cholesky factor of the
    regressors holds that of every smaller order as its leading block, and each further lag takes one square off the
    residual sum.
    """
    xx, xy, yy, n = full[:-1, :-1], full[:-1, -1], full[-1, -1], full[0, 0]
    scale = np.sqrt(np.clip(np.diag(xx), 0, None))
    if not np.isfinite(full).all() or n < 3 or (scale[:2] == 0).any():
        return []
    scale = np.where(scale > 0, scale, 1.0)
    factor = np.zeros_like(xx)
    scaled = xx / np.outer(scale, scale)
    out, left, part = [], yy, np.zeros(len(xx))
    for k in range(len(xx)):
        row = np.linalg.solve(factor[:k, :k], scaled[:k, k]) if k else np.zeros(0)
        pivot = scaled[k, k] - row @ row
        if pivot <= 1e-12:
            break
        factor[k, :k], factor[k, k] = row, np.sqrt(pivot)
        part[k] = (xy[k] / scale[k] - row @ part[:k]) / factor[k, k]
        left -= part[k] ** 2
        free = n - (k + 1)
        if k < 1 or free <= 0:
            continue
        lower = factor[: k + 1, : k + 1]
        unit = np.linalg.solve(lower, np.eye(k + 1)[:, 1])
        coef, variance = unit @ part[: k + 1], unit @ unit
        error = max(left, 0.0) / free
        if error > 0:
            out.append((k - 1, float(coef / np.sqrt(error * variance)), float(n * np.log(max(left, 1e-300) / n) + 2 * (k + 1))))
    return out


def _adf_solved(sums: pd.Series, fixed: pd.Series) -> pd.DataFrame:
    """Statistic, order and p-value of each series; ``fixed`` is the wanted order, or null for the best criterion."""
    out = []
    for flat, order in zip(sums, fixed):
        found = nested_orders(_unpacked(flat))
        if pd.notna(order):
            found = [f for f in found if f[0] == int(order)]
        best = min(found, key=lambda f: (f[2], f[0]), default=None)
        out.append((None, None, None) if best is None else (best[1], best[0], adf_p_value(best[1])))
    return pd.DataFrame(out, columns=["adf_stat", "used_lag", "p_value"]).astype({"adf_stat": float, "used_lag": "Int64", "p_value": float})


def moments(level: np.ndarray, skip: int, order: int) -> np.ndarray:
    """Sums of products of constant, lagged level, ``order`` lagged changes and change, for the rows from ``skip`` on.

    The upper triangle, row by row. The regression is built and multiplied in blocks of rows, so that memory does not
    grow with the order.
    """
    change, size = np.diff(level), order + 3
    total = np.zeros((size, size))
    step = max(1, BLOCK_VALUES // size)
    for start in range(skip, len(level), step):
        at = np.arange(start, min(start + step, len(level)))
        design = np.empty((len(at), size))
        design[:, 0], design[:, 1], design[:, -1] = 1.0, level[at - 1], change[at - 1]
        for j in range(1, order + 1):
            design[:, j + 1] = change[at - 1 - j]
        total += design.T @ design
    return total[np.triu_indices(size)]


def longest_order(rows: int) -> int:
    """Schwert's rule for the largest order worth trying."""
    return max(0, min(int(math.ceil(12 * (rows / 100) ** 0.25)), rows // 2 - 3))


def adf_by_difference(
    df: DataFrame, spec: SeriesSpec, max_d: int = 3, lags: int | str = 4, mode: str = "lag", rows_per_chunk: int | None = None
) -> DataFrame:
    """Augmented Dickey-Fuller statistic of each signal for differences 0 to ``max_d``.

    The regression (constant, lagged level, lagged changes) needs only sums of products. Every chunk adds up its own, once,
    for the largest order; the summed systems are solved in batches. With ``lags='auto'`` each series gets
    the order up to Schwert's bound for the longest series that has the smallest Akaike criterion, all orders being
    compared on the same rows. ``used_lag`` is the order, ``p_value`` comes from a response surface, and
    ``stationary`` compares with the 5 % value.
    """
    rows, long = long_form(df, spec)
    rows = rows.filter("value IS NOT NULL")
    keys = list(long.keys)
    stats, profile = measured(rows, keys, _m=F.avg("value"), _s=F.stddev_pop("value"))
    stats = stats.withColumnRenamed("n_obs", "_rows")
    scaled = attach(rows, stats.select(*keys, "_m", "_s"), keys, profile)
    auto = lags == AUTO
    order = longest_order(profile.largest) if auto else int(lags)
    reach = order + 1 + max_d
    parts = chunked(scaled, long, before=reach, rows_per_chunk=rows_per_chunk, profile=profile)
    size = order + 3

    def products(first: int, columns) -> dict:
        z, out = columns["z"], {}
        for d in range(max_d + 1):
            if mode == "lag" or d == 0:
                level = z[d:] - z[: len(z) - d] if d else z
            else:
                level = sum((-1) ** k * math.comb(d, k) * z[d - k : len(z) - k] for k in range(d + 1))
            skip = max(first - d, order + 1)
            if not np.isfinite(z).all() or len(level) <= skip:
                out[f"_d{d}"] = [0.0] * (size * (size + 1) // 2)
                continue
            out[f"_d{d}"] = moments(level, skip, order).tolist()
        return out

    z = (F.col("value") - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s"))
    outputs = ", ".join(f"_d{d} array<double>" for d in range(max_d + 1))
    chunk_sums = per_chunk(parts, {"z": z.cast("double")}, products, outputs)
    cells = F.explode(F.array(*[F.struct(F.lit(d).cast("bigint").alias("d"), F.col(f"_d{d}").alias("s")) for d in range(max_d + 1)]))
    flat = chunk_sums.select(*keys, cells.alias("_c")).select(*keys, "_c.d", F.posexplode("_c.s").alias("_i", "_v"))
    summed = flat.groupBy(*keys, "d", "_i").agg(F.sum("_v").alias("_v")).groupBy(*keys, "d").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda x: x["_v"]).alias("_s")
    )
    solve = F.pandas_udf(_adf_solved, "adf_stat double, used_lag bigint, p_value double")
    tests = same_keys(summed, stats.select(*keys, "_rows"), keys, "inner").filter(F.col("_rows") - F.col("d") >= 10)
    wanted = F.lit(None if auto else order).cast("bigint")
    tests = tests.select(*keys, "d", F.col("_s")[0].cast("bigint").alias("n_obs"), solve("_s", wanted).alias("_t")).select(*keys, "d", "n_obs", "_t.*")
    n = F.when(F.col("n_obs") > 0, F.col("n_obs").cast("double"))
    c0, c1, c2, c3 = ADF_5PCT
    limit = c0 + c1 / n + c2 / (n * n) + c3 / (n * n * n)
    return tests.select("*", limit.alias("critical_5pct"), F.coalesce(F.col("adf_stat") < limit, F.lit(False)).alias("stationary"))


def adf_test(df: DataFrame, spec: SeriesSpec, lags: int | str = 4, rows_per_chunk: int | None = None) -> DataFrame:
    return adf_by_difference(df, spec, 0, lags, rows_per_chunk=rows_per_chunk).drop("d")


def suggest_difference(df: DataFrame, spec: SeriesSpec, max_d: int = 3, lags: int | str = 4, mode: str = "lag", rows_per_chunk: int | None = None) -> DataFrame:
    """The smallest difference that passes the test, or null."""
    tests = adf_by_difference(df, spec, max_d, lags, mode, rows_per_chunk)
    return tests.groupBy(*spec.keys, "signal").agg(F.min(F.when(F.col("stationary"), F.col("d"))).alias("suggested_d"))


def boxcox_hint(df: DataFrame, spec: SeriesSpec, low: float = -2.0, high: float = 2.0, steps: int = 40) -> DataFrame:
    """'boxcox' with the maximum-likelihood exponent, or 'shift_then_boxcox_or_log' when a value is <= 0.

    The likelihood is evaluated on a grid of exponents and once more on a finer grid around
    the best one; rows are paired with the grid inside the scan stage and only sums per
    exponent are shuffled.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), known(quoted(s)).alias("value")) for s in spec.signals]))
    keys = [*spec.keys, "signal"]
    rows = df.select(*spec.keys, cells.alias("_c")).select(*spec.keys, "_c.*").filter("value IS NOT NULL")
    log_x = F.ln(F.when(F.col("value") > 0, F.col("value")))
    width = (high - low) / steps
    fine_width = 2 * width / steps
    lam = F.col("_lam")

    def best(frame: DataFrame, exponents: Column) -> DataFrame:
        paired = frame.withColumn("_lx", log_x).withColumn("_lam", F.explode(exponents))
        flat = F.abs(lam) < 1e-12
        y = F.when(flat, F.col("_lx")).otherwise((F.exp(lam * F.col("_lx")) - 1) / F.when(flat, F.lit(1.0)).otherwise(lam))
        sums = paired.groupBy(*keys, "_lam").agg(
            F.min("value").alias("_low"), F.sum("_lx").alias("_s"), F.count("_lx").alias("_n"), F.var_pop(y).alias("_v")
        )
        fit = (lam - 1) * F.col("_s") - F.col("_n") / 2 * F.ln(F.when(F.col("_v") > 0, F.col("_v")))
        return sums.groupBy(*keys).agg(F.min("_low").alias("_low"), F.max_by("_lam", fit).alias("_best"))

    coarse = best(rows, F.array(*[F.lit(round(low + i * width, 12)) for i in range(steps + 1)]))
    offsets = F.array(*[F.lit(i * fine_width - width) for i in range(steps + 1)])
    grids = coarse.select(*keys, F.transform(offsets, lambda o: F.round(F.col("_best") + o, 12)).alias("_grid"))
    fine = best(attach(rows, grids, keys), F.col("_grid"))
    bad = F.col("_low") <= 0
    return fine.select(
        *keys, F.when(bad, "shift_then_boxcox_or_log").otherwise("boxcox").alias("suggestion"), F.when(~bad, F.col("_best")).alias("lambda")
    )


def recommend_models(df: DataFrame, stationary: str = "stationary", seasonal: str = "seasonal") -> DataFrame:
    """Add two model names chosen by stationarity and seasonality."""
    s, p = F.col(stationary), F.col(seasonal)
    # The recommendation table.
    models = (
        F.when(~s & p, F.array(F.lit("SARIMA"), F.lit("Prophet")))
        .when(~s & ~p, F.array(F.lit("ARIMA"), F.lit("ETS")))
        .when(s & p, F.array(F.lit("SARIMA"), F.lit("TBATS")))
        .when(s & ~p, F.array(F.lit("ARIMA"), F.lit("SimpleExpSmoothing")))
    )
    return df.withColumn("recommended_models", models)
