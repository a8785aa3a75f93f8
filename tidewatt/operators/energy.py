"""Energy accounting: net power, dispatch balance, state of charge, capacity sweeps."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidewatt.functions.timestamps import width_of
from tidewatt.functions.values import quoted
from tidewatt.operators.buckets import bucket_mean
from tidewatt.plans.order import CHUNK, chunked
from tidewatt.plans.quantiles import known
from tidewatt.plans.sizing import broadcast_if_small, same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec

CHARGE, DISCHARGE, SOC = "battery_charging_rate", "battery_discharging_rate", "battery_state_of_charge"
# Calibration grid (kWh, charge and discharge efficiency).
CAPACITIES = (20.0, 25.0, 50.0, 75.0, 100.0)
EFFICIENCIES = (0.9, 0.93, 0.95, 0.98)
# Dispatch settings.
ETA_CHARGE, ETA_DISCHARGE, MAX_POWER_KW = 0.90, 0.93, 50.0
SOC_FLOOR, SOC_CEILING = 0.10, 0.90
NOMINAL_KWH = 100.0
CAPACITY_MULTIPLES = (0.0, 0.25, 0.5, 1.0, 2.0)


def zero(name: str) -> Column:
    """The reading, 0 where it is missing (null or NaN)."""
    return F.coalesce(known(quoted(name)), F.lit(0.0))


def net_power(df: DataFrame, charge: str = CHARGE, discharge: str = DISCHARGE, name: str = "battery_net_power") -> DataFrame:
    """Discharge minus charge, missing readings taken as zero."""
    return df.withColumn(name, zero(discharge) - zero(charge))


def infer_capacity(
    df: DataFrame, spec: SeriesSpec, soc: str, nominal: float = NOMINAL_KWH, kwh_above: float = 5.0, percent_above: float = 1.0
) -> DataFrame:
    """Battery capacity and initial energy per key, from the scale of the readings.

    A maximum above ``kwh_above`` means kWh, above ``percent_above`` percent of the nominal
    capacity, else a fraction of it; no reading at all gives (nominal, 0).
    """
    v = known(quoted(soc))
    top = df.groupBy(*spec.keys).agg(F.max(v).alias("_max"), F.min_by(v, F.struct(*spec.order)).alias("_first"))
    capacity = F.when(F.col("_max") > kwh_above, F.col("_max")).otherwise(F.lit(nominal))
    start = (
        F.when(F.col("_max").isNull(), F.lit(0.0))
        .when(F.col("_max") > kwh_above, F.col("_first"))
        .when(F.col("_max") > percent_above, F.col("_first") / 100 * nominal)
        .otherwise(F.col("_first") * nominal)
    )
    return top.select(*spec.keys, capacity.alias("capacity_kwh"), start.alias("initial_kwh"))


def grid_balance(df: DataFrame, load: str, renewables) -> DataFrame:
    """Renewables serve the load first; the deficit is imported, the surplus exported."""
    supply = zero(renewables[0])
    for name in renewables[1:]:
        supply = supply + zero(name)
    net = zero(load) - supply
    return df.select(
        "*", F.greatest(net, F.lit(0.0)).alias("grid_import_kw"), F.greatest(-net, F.lit(0.0)).alias("grid_export_kw"),
        F.least(zero(load), supply).alias("renewable_used_kw"), supply.alias("renewable_kw"),
    )


def daily_energy_summary(
    df: DataFrame, spec: SeriesSpec, load: str, renewables, charge: str, discharge: str, soc: str, hours: float
) -> DataFrame:
    """Energy sums, shares and state-of-charge range per key and date; null on zero denominators."""
    rows = grid_balance(df, load, renewables)

    def kwh(name):
        return F.sum(known(quoted(name))) * hours

    day = rows.groupBy(*spec.keys, F.to_date(spec.ts).alias("date")).agg(
        F.coalesce(kwh(load), F.lit(0.0)).alias("total_load_kwh"),
        kwh("renewable_kw").alias("total_renewable_prod_kwh"),
        kwh("renewable_used_kw").alias("total_renewable_used_kwh"),
        kwh("grid_import_kw").alias("grid_import_kwh"),
        kwh("grid_export_kw").alias("grid_export_kwh"),
        F.coalesce(kwh(charge), F.lit(0.0)).alias("battery_charged_kwh"),
        F.coalesce(kwh(discharge), F.lit(0.0)).alias("battery_discharged_kwh"),
        F.min(known(quoted(soc))).alias("soc_min"),
        F.max(known(quoted(soc))).alias("soc_max"),
        F.avg(known(quoted(soc))).alias("soc_avg"),
    )

    def share(a, b):
        return F.col(a) / F.when(F.col(b) > 0, F.col(b))

    return day.select(
        "*", (F.col("grid_import_kwh") - F.col("grid_export_kwh")).alias("grid_net_kwh"),
        share("total_renewable_used_kwh", "total_load_kwh").alias("renewable_fraction_of_load"),
        share("battery_discharged_kwh", "battery_charged_kwh").alias("battery_efficiency"),
    )


def daily_ml_rows(days: DataFrame, keys=()) -> DataFrame:
    """The day table the import model is fitted on."""
    return days.select(
        *keys, "date", "total_load_kwh", "total_renewable_prod_kwh", F.col("soc_max").alias("battery_capacity_kwh"), "grid_import_kwh"
    )


def soc_delta(
    hours: float, capacity: float, eta_charge: float, eta_discharge: float, charge: str = CHARGE, discharge: str = DISCHARGE,
    discharge_rule: str = "multiply",
) -> Column:
    """Change of the state of charge per step, in percent."""
    up = F.greatest(F.lit(0.0), zero(charge)) * eta_charge
    down = F.greatest(F.lit(0.0), zero(discharge))
    down = down * eta_discharge if discharge_rule == "multiply" else down / eta_discharge
    return (up - down) * hours / capacity * 100.0


def _prefixes(deltas: np.ndarray, lo: float, hi: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first i + 1 steps as one map x -> min(top, max(bottom, x + shift)), for every i.

    Such maps compose to such maps, so prefixes are formed by doubling: log2(n) vector passes.
    """
    shift = np.array(deltas, dtype=float)
    bottom, top = np.full(len(shift), lo), np.full(len(shift), hi)
    reach = 1
    while reach < len(shift):
        s, b, t = shift[reach:], bottom[reach:], top[reach:]
        new = (
            shift[:-reach] + s, np.minimum(t, np.maximum(b, bottom[:-reach] + s)), np.minimum(t, np.maximum(b, top[:-reach] + s))
        )
        shift, bottom, top = (np.concatenate([old[:reach], part]) for old, part in zip((shift, bottom, top), new))
        reach *= 2
    return shift, bottom, top


def _compose(deltas: np.ndarray, lo: float, hi: float) -> tuple[float, float, float]:
    """All steps of a chunk as one map."""
    return tuple(float(p[-1]) for p in _prefixes(deltas, lo, hi)) if len(deltas) else (0.0, -np.inf, np.inf)


def _walk(deltas: np.ndarray, start: float, lo: float, hi: float) -> np.ndarray:
    shift, bottom, top = _prefixes(deltas, lo, hi)
    return np.minimum(top, np.maximum(bottom, start + shift))


def clamped_running_balance(
    df: DataFrame, spec: SeriesSpec, delta: str, lo: float = 0.0, hi: float = 100.0, start: float | str = 50.0,
    name: str = "balance", rows_per_chunk: int | None = None,
) -> DataFrame:
    """s[i] = min(hi, max(lo, s[i-1] + delta[i])) per series; the first row holds the start value.

    ``start`` is a number or a column whose first value per series is used (50 where it has
    none). Steps of this form compose, so each chunk of a long series is first reduced to
    one map, the maps give every chunk its entry state, and chunks are then walked alone.
    """
    keys = list(spec.keys)
    parts = chunked(df, spec, rows_per_chunk=rows_per_chunk)
    parts = parts.having(parts.frame.withColumn("_i", parts.position))
    initial = F.lit(float(start)) if isinstance(start, (int, float)) else F.coalesce(quoted(start), F.lit(50.0))
    frame = parts.frame.withColumn("_d", zero(delta)).withColumn("_s0", F.when(F.col("_i") == 0, initial))
    groups = [c for c in parts.groups if isinstance(c, str)]
    kinds = dict(frame.dtypes)
    if parts.split:

        def reduce_chunk(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_i")
            first = pdf["_s0"].iloc[0]
            deltas = pdf["_d"].to_numpy(copy=True)
            if not np.isnan(first):
                deltas[0] = 0.0
            shift, bottom, top = _compose(deltas, lo, hi)
            row = {c: [pdf[c].iloc[0]] for c in groups}
            if not np.isnan(first):
                rest = _walk(deltas[1:], first, lo, hi)
                first = rest[-1] if len(rest) else first
            return pd.DataFrame({**row, "_first": [first], "_shift": [shift], "_bottom": [bottom], "_top": [top]})

        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in groups], "_first double, _shift double, _bottom double, _top double"])
        maps = frame.filter("_split").select(*groups, "_i", "_d", "_s0").groupBy(*groups).applyInPandas(reduce_chunk, schema)

        def enter(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(CHUNK).reset_index(drop=True)
            state, entry = np.nan, []
            for first, shift, bottom, top in pdf[["_first", "_shift", "_bottom", "_top"]].itertuples(index=False):
                entry.append(state)
                state = min(top, max(bottom, state + shift)) if np.isnan(first) else first
            return pdf[groups].assign(_entry=entry)

        schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in groups], "_entry double"])
        entries = maps.groupBy(*keys).applyInPandas(enter, schema)
        frame = same_keys(frame, broadcast_if_small(freeze(entries)), groups)
    else:
        frame = frame.withColumn("_entry", F.lit(None).cast("double"))

    helpers = ["_i", "_d", "_s0", "_entry"]
    kept = frame.drop(*helpers).schema

    def walk(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_i")
        first, deltas = rows.column("_s0")[0].as_py(), rows.column("_d").to_numpy()
        if first is None:
            values = _walk(deltas, rows.column("_entry")[0].as_py(), lo, hi)
        else:
            values = np.concatenate([[first], _walk(deltas[1:], first, lo, hi)])
        return rows.drop_columns(helpers).append_column(name, pa.array(values))

    schema = T.StructType([*kept.fields, T.StructField(name, T.DoubleType())])
    walked = frame.select(*kept.names, *helpers).groupBy(*groups).applyInArrow(walk, schema)
    return parts.trim(walked)


def parameter_grid(capacities=CAPACITIES, charge=EFFICIENCIES, discharge=EFFICIENCIES) -> list[tuple[float, float, float]]:
    """Every combination, in the order used to break ties."""
    return list(product(capacities, charge, discharge))


def fit_parameters(
    df: DataFrame, spec: SeriesSpec, hours: float, soc: str = SOC, charge: str = CHARGE, discharge: str = DISCHARGE,
    grid=None, discharge_rule: str = "multiply", min_rows: int = 10, rows_per_chunk: int | None = None,
) -> DataFrame:
    """Capacity and efficiencies that explain the step-to-step change of the state of charge best.

    Least squares of the change in percent on charge and discharge over all steps whose two states
    are known and not at a limit. The squared error of every combination is a form of six sums of
    products, so one aggregate per key decides among all of them. One row per key (``run_per_month``
    adds the month); a key with fewer than ``min_rows`` steps has null parameters.
    """
    keys = list(spec.keys)
    slim = df.filter(F.col(spec.ts).isNotNull()).select(
        *keys, *spec.order, known(quoted(soc)).alias("_soc"),
        (F.greatest(F.lit(0.0), zero(charge)) * hours * 100.0).alias("_u"), (F.greatest(F.lit(0.0), zero(discharge)) * hours * 100.0).alias("_d"),
    )
    parts = chunked(slim, spec, before=1, rows_per_chunk=rows_per_chunk)
    steps = parts.trim(parts.frame.withColumn("_y", F.col("_soc") - F.lag("_soc").over(parts.window)))
    free = F.col("_y").isNotNull() & (F.col("_soc") > 0) & (F.col("_soc") < 100)
    y, u, d = (F.when(free, F.col(c)) for c in ("_y", "_u", "_d"))
    pairs = {"yy": y * y, "uy": u * y, "dy": d * y, "uu": u * u, "dd": d * d, "ud": u * d}
    sums = steps.groupBy(*keys).agg(
        F.count_if(free).alias("n_obs"), *[F.coalesce(F.sum(e), F.lit(0.0)).alias(f"_{n}") for n, e in pairs.items()]
    )
    combos = F.array(*[
        F.struct(
            F.lit(i).alias("i"), F.lit(float(cap)).alias("capacity_kwh"), F.lit(float(up)).alias("eta_ch"), F.lit(float(down)).alias("eta_dis"),
            F.lit(up / cap).alias("a"), F.lit((down if discharge_rule == "multiply" else 1.0 / down) / cap).alias("b"),
        )
        for i, (cap, up, down) in enumerate(parameter_grid() if grid is None else grid)
    ])

    def error(c: Column) -> Column:
        a, b = c["a"], c["b"]
        linear = F.col("_yy") - a * F.col("_uy") * 2 + b * F.col("_dy") * 2
        return F.greatest(F.lit(0.0), linear + a * a * F.col("_uu") + b * b * F.col("_dd") - a * b * F.col("_ud") * 2)

    scored = F.transform(combos, lambda c: F.struct(F.round(error(c), 6).alias("sse"), c["i"].alias("i"), c.alias("c")))
    best = F.when(F.col("n_obs") >= min_rows, F.array_min(scored))
    return sums.withColumn("_best", best).select(
        *keys, *[F.col(f"_best.c.{n}").alias(n) for n in ("capacity_kwh", "eta_ch", "eta_dis")],
        F.sqrt(F.col("_best.sse") / F.col("n_obs")).alias("rmse"), "n_obs",
    )


def capacity_sweep(
    df: DataFrame, spec: SeriesSpec, load: str, renewables, soc: str, every: str = "15 minutes", multiples=CAPACITY_MULTIPLES,
    eta_charge: float = ETA_CHARGE, eta_discharge: float = ETA_DISCHARGE, max_power: float = MAX_POWER_KW, nominal: float = NOMINAL_KWH,
) -> DataFrame:
    """Energy balance of each day for several battery sizes, in closed form.

    Readings are averaged per interval; a day's surplus and deficit count up to the power limit. A
    battery takes in as much surplus as fits between 10 and 90 percent of its capacity and gives it
    back to the deficit, once a day at most. This is an energy budget, not a dispatch schedule: the
    order of surplus and deficit within the day is not looked at.
    """
    hours = width_of(every) / width_of("1 hour")
    signals = dict.fromkeys([load, *renewables, soc])
    df = bucket_mean(df, spec.with_signals(*signals), every)
    spec = SeriesSpec(spec.ts, spec.keys)
    keys = [*spec.keys, "date"]
    rows = grid_balance(df.filter(F.col(spec.ts).isNotNull()).withColumn("date", F.to_date(spec.ts)), load, renewables)

    def kwh(name: str, limit: float | None = None) -> Column:
        power = F.col(name) if limit is None else F.least(F.col(name), F.lit(limit))
        return F.sum(power) * hours

    top = F.max(known(quoted(soc)))
    days = rows.groupBy(*keys).agg(
        (F.sum(zero(load)) * hours).alias("total_load_kwh"), kwh("renewable_kw").alias("total_renewable_prod_kwh"),
        kwh("grid_import_kw").alias("_deficit"), kwh("grid_export_kw").alias("_surplus"),
        kwh("grid_import_kw", max_power).alias("_wanted"), kwh("grid_export_kw", max_power).alias("_offered"),
        F.when(top > 5.0, top).otherwise(F.lit(nominal)).alias("capacity_kwh"),
    )
    sizes = F.array(*[F.struct(F.lit(i).cast("bigint").alias("candidate_order"), F.lit(float(m)).alias("multiple")) for i, m in enumerate(multiples)])
    sized = days.withColumn("_m", F.explode(sizes)).select("*", "_m.*").withColumn("added_kwh", F.col("multiple") * F.col("capacity_kwh"))
    cap = F.col("capacity_kwh") + F.col("added_kwh")
    sized = sized.withColumn("_low", cap * SOC_FLOOR).withColumn("_stored", F.least(F.col("_offered") * eta_charge, cap * SOC_CEILING - cap * SOC_FLOOR))
    sized = sized.withColumn("battery_discharged_kwh", F.least(F.col("_wanted"), F.col("_stored") * eta_discharge))
    sized = sized.withColumn("battery_charged_kwh", F.col("battery_discharged_kwh") / (eta_charge * eta_discharge))
    sized = sized.withColumn("_high", F.col("_low") + F.col("battery_discharged_kwh") / eta_discharge)
    imported, exported = F.col("_deficit") - F.col("battery_discharged_kwh"), F.col("_surplus") - F.col("battery_charged_kwh")
    return sized.select(
        *keys, "candidate_order", "capacity_kwh", "added_kwh", "total_load_kwh", "total_renewable_prod_kwh",
        imported.alias("grid_import_kwh"), exported.alias("grid_export_kwh"), (imported - exported).alias("grid_net_kwh"),
        "battery_charged_kwh", "battery_discharged_kwh", F.col("_low").alias("soc_min_kwh"), F.col("_high").alias("soc_max_kwh"),
    )


def recommend_capacity(sweep: DataFrame, keys=("date",)) -> DataFrame:
    """The size with least net grid energy per day (the first on a tie) and what it saves."""
    keys = list(keys)
    pick = F.struct("added_kwh", "capacity_kwh", "grid_import_kwh", "grid_export_kwh")
    chosen = sweep.groupBy(*keys).agg(
        F.min_by(pick, F.struct("grid_net_kwh", "candidate_order")).alias("_b"),
        F.min_by("grid_import_kwh", "candidate_order").alias("_base"),
    )
    saved = F.col("_base") - F.col("_b.grid_import_kwh")
    share = saved / F.when(F.col("_base") > 0, F.col("_base"))
    percent = F.coalesce(F.concat(F.lit(" ("), F.format_string("%.2f%%", share * 100), F.lit(")")), F.lit(""))
    note = F.concat(
        F.format_string("%.2f kWh more storage on top of %.1f kWh lowers the day's grid import by %.2f kWh", F.col("_b.added_kwh"), F.col("_b.capacity_kwh"), saved),
        F.when(share.isNotNull(), percent).otherwise(F.lit("")), F.lit("."),
    )
    return chosen.select(
        *keys, F.col("_b.added_kwh").alias("recommended_kwh"), F.col("_b.grid_import_kwh").alias("expected_import_kwh"),
        F.col("_b.grid_export_kwh").alias("expected_export_kwh"), saved.alias("reduction_kwh"), (share * 100).alias("reduction_pct"),
        note.alias("notes"),
    )
