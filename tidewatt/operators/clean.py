"""Anomaly flags and cleaning strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.functions.timestamps import micros
from tidewatt.functions.values import SENTINEL, is_sentinel, quoted, replace_columns
from tidewatt.operators.ordered import drop_neighbours, interpolated
from tidewatt.operators.quality import long_rows
from tidewatt.plans.order import chunked, known_neighbours
from tidewatt.plans.quantiles import known, quantile_wide
from tidewatt.plans.sizing import KeyProfile, attach, measured, same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec

Z_LIMIT = 4.0
IQR_FACTOR = 3.0
KEEP = "keep"
REMOVE = "remove"
EXTREMES = "remove_extremes_then_interpolate"
SENTINELS = "remove_sentinels_then_interpolate_then_clean"
INTERPOLATE = "interpolate"
STRATEGIES = (KEEP, REMOVE, EXTREMES, SENTINELS, INTERPOLATE)

# Cleaning strategy per column of the older telemetry schema.
DEFAULT_STRATEGIES = {
    "battery_active_power": SENTINELS,
    "battery_active_power_set_response": SENTINELS,
    "pvpcs_active_power": EXTREMES,
    "ge_body_active_power": EXTREMES,
    "ge_active_power": EXTREMES,
    "ge_body_active_power_set_response": SENTINELS,
    "fc_active_power_fc_end_set": EXTREMES,
    "fc_active_power": EXTREMES,
    "fc_active_power_fc_end_set_response": EXTREMES,
    "island_mode_mccb_active_power": EXTREMES,
    "mg-lv-msb_ac_voltage": EXTREMES,
    "receiving_point_ac_voltage": EXTREMES,
    "island_mode_mccb_ac_voltage": EXTREMES,
    "island_mode_mccb_frequency": EXTREMES,
    "mg-lv-msb_frequency": EXTREMES,
    "inlet_temperature_of_chilled_water": EXTREMES,
    "outlet_temperature": EXTREMES,
}


def reading(signal: str, sentinels) -> Column:
    """The value unless it is missing or a sentinel."""
    v = known(quoted(signal))
    return F.when(~is_sentinel(v, sentinels), v)


def sentinel_flags(df: DataFrame, signals, sentinels=(SENTINEL,)) -> DataFrame:
    return df.select("*", *[is_sentinel(quoted(s), sentinels).alias(f"{s}_sentinel") for s in signals])


def bounds(df: DataFrame, spec: SeriesSpec, sentinels, zscore: bool, iqr: bool) -> tuple[DataFrame, KeyProfile]:
    """One row per key: mean and population deviation, and quartiles, of each signal."""
    keys = list(spec.keys)
    clean = df.select(*keys, *[reading(s, sentinels).alias(s) for s in spec.signals])
    moments = {}
    if zscore:
        for s in spec.signals:
            moments |= {f"{s}#mean": F.avg(quoted(s)), f"{s}#std": F.stddev_pop(quoted(s))}
    table, profile = measured(clean, keys, **moments)
    table = table.drop("n_obs")
    if iqr:
        q = quantile_wide(clean, keys, spec.signals, [0.25, 0.75], profile)
        q = freeze(q.select(*keys, *[quoted(s)[i].alias(f"{s}#q{i}") for s in spec.signals for i in (0, 1)]))
        table = same_keys(table, q, keys)
    return table, profile


def flagged_rows(
    df: DataFrame, spec: SeriesSpec, method: str = "combined", z_limit=Z_LIMIT, iqr_factor=IQR_FACTOR, sentinels=(SENTINEL,)
) -> tuple[DataFrame, KeyProfile]:
    """The rows with their flags, and the group sizes found on the way."""
    zscore, iqr = method in ("zscore", "combined"), method in ("iqr", "combined")
    limits, profile = bounds(df, spec, sentinels, zscore, iqr)
    rows = attach(df, limits, spec.keys, profile)
    columns = []
    for s in spec.signals:
        v, sentinel = reading(s, sentinels), is_sentinel(quoted(s), sentinels)
        hit = F.lit(True)
        if zscore:
            std = quoted(f"{s}#std")
            hit = hit & (F.abs(v - quoted(f"{s}#mean")) > z_limit * std) & (std > 0)
        if iqr:
            q1, q3 = quoted(f"{s}#q0"), quoted(f"{s}#q1")
            hit = hit & ((v < q1 - iqr_factor * (q3 - q1)) | (v > q3 + iqr_factor * (q3 - q1)))
        hit = F.coalesce(hit, F.lit(False))
        columns += [sentinel.alias(f"{s}_sentinel"), hit.alias(f"{s}_statistical"), (sentinel | hit).alias(f"{s}_flag")]
    return rows.select(*[quoted(c) for c in df.columns], *columns), profile


def with_flags(df: DataFrame, spec: SeriesSpec, method: str = "combined", **options) -> DataFrame:
    """Add ``<signal>_sentinel``, ``<signal>_statistical`` and ``<signal>_flag``.

    ``method`` is 'zscore', 'iqr' or 'combined' (both must agree). The limits come from the
    readings that are neither missing nor sentinels; those rows are never statistical flags.
    """
    return flagged_rows(df, spec, method, **options)[0]


def zscore_flags(df: DataFrame, spec: SeriesSpec, limit: float = Z_LIMIT, sentinels=(SENTINEL,)) -> DataFrame:
    return with_flags(df, spec, "zscore", z_limit=limit, sentinels=sentinels)


def iqr_flags(df: DataFrame, spec: SeriesSpec, factor: float = IQR_FACTOR, sentinels=(SENTINEL,)) -> DataFrame:
    return with_flags(df, spec, "iqr", iqr_factor=factor, sentinels=sentinels)


def combined_flags(df: DataFrame, spec: SeriesSpec, **options) -> DataFrame:
    return with_flags(df, spec, "combined", **options)


def flag_counts(flagged: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Total, sentinel and statistical anomalies per key and signal."""
    aggs = []
    for s in spec.signals:
        for field, name in (("total_anomalies", "flag"), ("sentinel_values", "sentinel"), ("statistical_anomalies", "statistical")):
            aggs.append(F.count_if(quoted(f"{s}_{name}")).alias(f"{s}#{field}"))
    fields = ["total_anomalies", "sentinel_values", "statistical_anomalies"]
    return long_rows(flagged.groupBy(*spec.keys).agg(*aggs), spec.keys, spec.signals, fields, "signal")


def cleaned_columns(
    df: DataFrame, spec: SeriesSpec, strategies: dict[str, str], axis: str = "row", rows_per_chunk: int | None = None, **options
) -> DataFrame:
    """Flags plus ``<signal>_clean`` for every signal, in at most two window passes over one shuffle."""
    unknown = set(strategies.values()) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown cleaning strategies: {sorted(unknown)}")
    sentinels = options.get("sentinels", (SENTINEL,))
    rows, profile = flagged_rows(df, spec, **options)
    first = {}
    for s in spec.signals:
        strategy = strategies.get(s, INTERPOLATE)
        v, flag = known(quoted(s)), quoted(f"{s}_flag")
        if strategy == KEEP:
            first[s] = quoted(s)
        elif strategy == SENTINELS:
            first[s] = reading(s, sentinels)
        else:
            first[s] = F.when(~flag, v)
    rows = rows.select("*", *[e.alias(f"{s}_clean") for s, e in first.items()])
    once = [f"{s}_clean" for s in spec.signals if strategies.get(s, INTERPOLATE) in (EXTREMES, INTERPOLATE, SENTINELS)]
    twice = [s for s in spec.signals if strategies.get(s) == SENTINELS]
    if not once:
        return rows
    # Rows without a timestamp have no neighbours; they keep their value unless it is flagged.
    timeless = rows.filter(F.col(spec.ts).isNull())
    gone_at_once = {f"{s}_clean": F.when(~quoted(f"{s}_flag"), quoted(f"{s}_clean")) for s in twice}
    timeless = replace_columns(timeless, gone_at_once | {c: quoted(c).cast("double") for c in once if c not in gone_at_once})
    parts = chunked(rows, spec, rows_per_chunk=rows_per_chunk, profile=profile)
    parts = parts.having(parts.frame.withColumn("_x", parts.position if axis == "row" else micros(spec.ts)))

    def fill(parts, columns):
        frame = known_neighbours(parts, columns, "_x")
        frame = drop_neighbours(replace_columns(frame, {c: interpolated(c, "_x") for c in columns}), columns)
        return parts.having(frame)

    parts = fill(parts, once)
    if twice:
        gone = {f"{s}_clean": F.when(~quoted(f"{s}_flag"), quoted(f"{s}_clean")) for s in twice}
        parts = fill(parts.having(replace_columns(parts.frame, gone)), list(gone))
    return parts.trim(parts.frame).drop("_x").unionByName(timeless)


def clean(df: DataFrame, spec: SeriesSpec, strategy: str = INTERPOLATE, **options) -> DataFrame:
    """Replace every signal by its cleaned version, all with one strategy."""
    return clean_table(df, spec, {s: strategy for s in spec.signals}, **options)


def clean_table(df: DataFrame, spec: SeriesSpec, strategies: dict[str, str] | None = None, **options) -> DataFrame:
    """Clean the columns named in the strategy map that exist; other columns pass through."""
    strategies = DEFAULT_STRATEGIES if strategies is None else strategies
    present = [c for c in strategies if c in df.columns]
    spec = spec.with_signals(*present)
    rows = cleaned_columns(df, spec, strategies, **options)
    return rows.select(*[quoted(f"{c}_clean").alias(c) if c in present else quoted(c) for c in df.columns])


def cleaning_report(df: DataFrame, spec: SeriesSpec, strategies: dict[str, str], **options) -> DataFrame:
    """Statistics before and after, anomaly counts and strategy per key and signal."""
    rows = cleaned_columns(df, spec, strategies, **options)
    aggs, fields = [], []
    for s in spec.signals:
        for when, column in (("original", s), ("cleaned", f"{s}_clean")):
            v = known(quoted(column))
            for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
                aggs.append(f(v).alias(f"{s}#{when}_{name}"))
        for field, name in (("total_anomalies", "flag"), ("sentinel_values", "sentinel"), ("statistical_anomalies", "statistical")):
            aggs.append(F.count_if(quoted(f"{s}_{name}")).alias(f"{s}#{field}"))
        aggs.append(F.lit(strategies.get(s, INTERPOLATE)).alias(f"{s}#cleaning_strategy"))
    fields = [f"{w}_{n}" for w in ("original", "cleaned") for n in ("mean", "std", "min", "max")]
    fields += ["total_anomalies", "sentinel_values", "statistical_anomalies", "cleaning_strategy"]
    return long_rows(rows.groupBy(*spec.keys).agg(*aggs), spec.keys, spec.signals, fields, "signal")


def zscore_outlier_counts(df: DataFrame, columns, limit: float = 3.0, keys=()) -> DataFrame:
    """Per column the rows with |z| over the limit, and the rows where any column has one."""
    spec = SeriesSpec(keys=tuple(keys), signals=tuple(columns))
    flagged = with_flags(df, spec, "zscore", z_limit=limit, sentinels=(float("-inf"),))
    any_hit = F.greatest(*[quoted(f"{c}_statistical") for c in columns]) if len(columns) > 1 else quoted(f"{columns[0]}_statistical")
    aggs = [F.count_if(quoted(f"{c}_statistical")).alias(f"{c}#n_outliers") for c in columns]
    aggs += [F.count_if(any_hit).alias(f"{c}#rows_with_outliers") for c in columns]
    return long_rows(flagged.groupBy(*keys).agg(*aggs), list(keys), columns, ["n_outliers", "rows_with_outliers"])
