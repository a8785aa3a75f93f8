"""Autocorrelation, cross-correlation and correlation tables."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.functions.values import quoted
from tidewatt.operators.ordered import long_form
from tidewatt.plans.order import chunked, per_chunk
from tidewatt.plans.quantiles import known
from tidewatt.plans.sizing import attach, measured, same_keys
from tidewatt.spec import SeriesSpec

MIN_ROWS = 10


def align_pair(df: DataFrame, spec: SeriesSpec, series_column: str, a: str, b: str) -> DataFrame:
    """Two series of a long table side by side, for the times both have.

    Readings of one series at one time are averaged first, so the alignment is one
    aggregation per time instead of a join whose output could multiply.
    """
    (value,) = spec.signals
    keys = [k for k in spec.keys if k != series_column]
    v = known(quoted(value))
    both = df.filter(F.col(series_column).isin(a, b) & v.isNotNull()).groupBy(*keys, spec.ts)
    return both.agg(
        F.avg(F.when(F.col(series_column) == a, v)).alias(a), F.avg(F.when(F.col(series_column) == b, v)).alias(b)
    ).na.drop(subset=[a, b])


def safe_corr(a: Column, b: Column) -> Column:
    """Pearson correlation, null when either side is constant or missing."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    scale = F.sqrt(F.var_pop(x)) * F.sqrt(F.var_pop(y))
    return F.try_divide(F.covar_pop(x, y), F.when(scale > 0, scale))


def correlation_matrix(df: DataFrame, columns, keys=(), digits: int | None = None) -> DataFrame:
    """Pairwise-complete Pearson correlation of every two columns as long rows."""
    columns, keys = list(columns), list(keys)
    value = {c: known(quoted(c)) for c in columns}
    pairs = list(combinations(columns, 2))
    aggs = [safe_corr(value[a], value[b]).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    aggs += [F.when(F.var_pop(value[c]) > 0, F.lit(1.0)).alias(f"d{i}") for i, c in enumerate(columns)]
    wide = df.groupBy(*keys).agg(*aggs)
    cells = [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(f"d{i}").alias("r")) for i, c in enumerate(columns)]
    for i, (a, b) in enumerate(pairs):
        cells += [F.struct(F.lit(p).alias("a"), F.lit(q).alias("b"), F.col(f"r{i}").alias("r")) for p, q in ((a, b), (b, a))]
    out = wide.select(*keys, F.explode(F.array(*cells)).alias("_c")).select(*keys, "_c.*")
    return out if digits is None else out.withColumn("r", F.round("r", digits))


def top_correlations(matrix: DataFrame, k: int = 3, keys=()) -> DataFrame:
    """For each column the ``k`` others of largest absolute correlation."""
    w = Window.partitionBy(*keys, "a").orderBy(F.abs("r").desc_nulls_last(), "b")
    ranked = matrix.filter("a <> b").withColumn("rank", F.row_number().over(w).cast("bigint"))
    return ranked.filter(F.col("rank") <= k)


def allowed_lags(n: Column, max_lag: int, strict: bool = True) -> Column:
    """How many lags a series of ``n`` rows supports."""
    if strict:
        return F.when(n < 2 * max_lag, F.least(F.lit(max_lag).cast("bigint"), F.floor(n / 2))).otherwise(F.lit(max_lag))
    return F.least(F.lit(max_lag).cast("bigint"), F.floor(n / 2) - 1)


def acf(df: DataFrame, spec: SeriesSpec, max_lag: int = 100, half_less_one: bool = False, rows_per_chunk: int | None = None) -> DataFrame:
    """Biased autocorrelation of the known values at lags 0 to ``max_lag``.

    Short series use fewer lags and series under ten rows give none. Each chunk adds up its
    lagged products in one vectorised pass; a chunk sees the ``max_lag`` rows before it.
    """
    rows, long = long_form(df, spec)
    rows = rows.filter("value IS NOT NULL")
    keys = list(long.keys)
    stats, profile = measured(rows, keys, _mean=F.avg("value"), _ss=F.var_pop("value") * F.count("*"))
    stats = stats.filter(F.col("n_obs") >= MIN_ROWS)
    centred = attach(rows, stats.select(*keys, "_mean"), keys, profile).filter("_mean IS NOT NULL")
    parts = chunked(centred, long, before=max_lag, rows_per_chunk=rows_per_chunk, profile=profile)

    def products(first: int, columns) -> dict:
        c = columns["c"]
        sums = [float(c[max(first, k) :] @ c[max(first, k) - k : len(c) - k]) if len(c) > max(first, k) else 0.0 for k in range(max_lag + 1)]
        return {"_sums": sums}

    sums = per_chunk(parts, {"c": F.col("value") - F.col("_mean")}, products, "_sums array<double>")
    lags = sums.select(*keys, F.posexplode("_sums").alias("lag", "_p")).groupBy(*keys, "lag").agg(F.sum("_p").alias("_p"))
    out = same_keys(lags, stats, keys, "inner")
    allowed = allowed_lags(F.col("n_obs"), max_lag, not half_less_one)
    value = F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(F.col("_p") / F.when(F.col("_ss") > 0, F.col("_ss")))
    return out.filter(F.col("lag") <= allowed).select(
        *keys, F.col("lag").cast("bigint").alias("lag"), F.when(F.col("_ss") > 0, value).alias("value"), "n_obs"
    )


def pacf(acf_rows: DataFrame, keys=("signal",), adjusted: bool = False) -> DataFrame:
    """Partial autocorrelation by the Durbin-Levinson recursion on each series' ACF.

    ``adjusted`` first removes the bias of the autocovariances (factor n / (n - lag)). The
    recursion is a fold over at most a few hundred lags per series.
    """
    keys = list(keys)
    r = F.col("value") * (F.col("n_obs") / (F.col("n_obs") - F.col("lag")) if adjusted else F.lit(1.0))
    folded = acf_rows.groupBy(*keys).agg(
        F.first("n_obs").alias("n_obs"), F.array_sort(F.collect_list(F.struct("lag", r.alias("r")))).alias("_a")
    ).withColumn("_r", F.transform("_a", lambda x: x["r"])).filter(F.size("_r") > 1)

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(state: Column, k: Column) -> Column:
        phi = state["phi"]
        known_r = F.slice(F.col("_r"), 2, k - 1)
        top = F.element_at(F.col("_r"), k + 1) - dot(phi, F.reverse(known_r))
        below = F.lit(1.0) - dot(phi, known_r)
        last = F.try_divide(top, below)
        updated = F.zip_with(phi, F.reverse(phi), lambda p, q: p - last * q)
        return F.struct(
            F.concat(updated, F.array(last)).alias("phi"), F.concat(state["out"], F.array(last)).alias("out")
        )

    empty = F.array().cast("array<double>")
    start = F.struct(empty.alias("phi"), F.array(F.lit(1.0)).alias("out"))
    partial = F.aggregate(F.sequence(F.lit(1), F.size("_r") - 1), start, step, lambda s: s["out"])
    return folded.select(*keys, "n_obs", F.posexplode(partial).alias("lag", "value")).select(
        *keys, F.col("lag").cast("bigint").alias("lag"), "value", "n_obs"
    )


def significant_lags(lag_rows: DataFrame, keys=("signal",), limit: int = 20) -> DataFrame:
    """Lags above 0 whose value exceeds 2 / sqrt(n); the first ``limit`` by lag."""
    bound = 2.0 / F.sqrt("n_obs")
    hits = lag_rows.filter((F.col("lag") > 0) & (F.abs("value") > bound)).withColumn("threshold", bound)
    w = Window.partitionBy(*keys).orderBy("lag")
    return hits.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")


def ccf(df: DataFrame, spec: SeriesSpec, max_lag: int = 100, center: bool = True, rows_per_chunk: int | None = None) -> DataFrame:
    """Cross-correlation of two signals at lags -L to L over their complete pairs.

    At lag k the first signal is taken k rows later than the second. Scaled by the
    population deviations and the pair count; ``center=False`` leaves the means in.
    """
    a, b = spec.signals
    keys = list(spec.keys)
    x, y = known(quoted(a)), known(quoted(b))
    pairs = df.select(*keys, *spec.order, x.alias("_x"), y.alias("_y")).na.drop(subset=["_x", "_y"])
    scale = F.stddev_pop("_x") * F.stddev_pop("_y") * F.count("*")
    stats, profile = measured(pairs, keys, _mx=F.avg("_x"), _my=F.avg("_y"), _scale=scale)
    stats = stats.filter(F.col("n_obs") >= MIN_ROWS)
    rows = attach(pairs, stats.select(*keys, "_mx", "_my"), keys, profile).filter("_mx IS NOT NULL")
    parts = chunked(rows, spec, before=max_lag, rows_per_chunk=rows_per_chunk, profile=profile)
    mean_x, mean_y = (F.col("_mx"), F.col("_my")) if center else (F.lit(0.0), F.lit(0.0))

    def products(first: int, columns) -> dict:
        x, y = columns["x"], columns["y"]

        def lagged(now, past, k):
            at = max(first, k)
            return float(now[at:] @ past[at - k : len(past) - k]) if len(now) > at else 0.0

        behind = [lagged(y, x, k) for k in range(max_lag, 0, -1)]
        return {"_sums": behind + [lagged(x, y, k) for k in range(max_lag + 1)]}

    values = {"x": F.col("_x") - mean_x, "y": F.col("_y") - mean_y}
    sums = per_chunk(parts, values, products, "_sums array<double>")
    lags = sums.select(*keys, F.posexplode("_sums").alias("_i", "_p")).groupBy(*keys, "_i").agg(F.sum("_p").alias("_p"))
    out = same_keys(lags, stats, keys, "inner").withColumn("lag", (F.col("_i") - max_lag).cast("bigint"))
    scale = F.when(F.col("_scale") > 0, F.col("_scale"))
    return out.filter(F.abs("lag") <= allowed_lags(F.col("n_obs"), max_lag)).select(
        *keys, "lag", (F.col("_p") / scale).alias("value"), "n_obs"
    )


def best_lag(ccf_rows: DataFrame, keys=()) -> DataFrame:
    """The lag of largest absolute correlation; the lowest lag on a tie."""
    best = F.max_by(F.struct("lag", "value"), F.struct(F.abs("value"), -F.col("lag")))
    rows = ccf_rows.filter("value IS NOT NULL").groupBy(*keys).agg(best.alias("_b"))
    return rows.select(*keys, F.col("_b.lag").alias("best_lag"), F.col("_b.value").alias("best_corr"))


def correlate_pairs(df: DataFrame, spec: SeriesSpec, pairs, operator, **options) -> DataFrame:
    """Run a pair operator for several signal pairs and stack the results."""
    out = None
    for a, b in pairs:
        if a in df.columns and b in df.columns:
            rows = operator(df, spec.with_signals(a, b), **options).select(F.lit(f"{a}_vs_{b}").alias("pair"), "*")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no pair has both columns in the table")
    return out
