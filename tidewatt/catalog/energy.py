"""Energy accounting queries."""

from pyspark.sql import functions as F

from tidewatt.catalog.common import HOURLY, HOURLY_SQL, hourly, query
from tidewatt.operators import energy
from tidewatt.spec import SeriesSpec

SITE = SeriesSpec("ts")
RENEWABLES = ["solar_kw", "wind_kw"]
SUPPLY = "(coalesce(solar_kw, 0.0) + coalesce(wind_kw, 0.0))"
LOAD = "coalesce(load_kw, 0.0)"


@query("net_power", f"SELECT ts, coalesce(discharge_kw, 0.0) - coalesce(charge_kw, 0.0) AS battery_net_power FROM ({HOURLY_SQL})", "battery_net_power")
def _(spark, sf):
    return energy.net_power(hourly(spark, sf), "charge_kw", "discharge_kw").select("ts", "battery_net_power")


# Days cycle through the three scales a battery column can have: fraction, percent-like, kWh.
SCALED = "CASE WHEN day(ts) % 3 = 0 THEN soc / 100 WHEN day(ts) % 3 = 1 THEN soc / 25 ELSE soc END"
CAPACITY = (
    f"SELECT date, CASE WHEN top > 5 THEN top ELSE 100.0 END AS capacity_kwh, CASE WHEN top IS NULL THEN 0.0 WHEN top > 5 THEN first WHEN top > 1 THEN first / 100 * 100.0 ELSE first * 100.0 END AS initial_kwh "
    f"FROM (SELECT CAST(ts AS DATE) AS date, max(s) AS top, arg_min(s, ts) AS first FROM (SELECT ts, {SCALED} AS s FROM ({HOURLY_SQL})) GROUP BY 1)"
)


def scaled(spark, sf):
    return hourly(spark, sf).withColumn("date", F.to_date("ts")).withColumn("soc", F.expr(SCALED))


@query("infer_capacity", CAPACITY, "capacity_kwh initial_kwh")
def _(spark, sf):
    return energy.infer_capacity(scaled(spark, sf), SeriesSpec("ts", ("date",)), "soc")


BALANCE = (
    f"SELECT *, greatest({LOAD} - {SUPPLY}, 0.0) AS imp, greatest({SUPPLY} - {LOAD}, 0.0) AS exp, least({LOAD}, {SUPPLY}) AS used, {SUPPLY} AS ren FROM ({HOURLY_SQL})"
)


@query("grid_balance", f"SELECT ts, imp AS grid_import_kw, exp AS grid_export_kw, used AS renewable_used_kw, ren AS renewable_kw FROM ({BALANCE})", "grid_import_kw grid_export_kw renewable_used_kw renewable_kw")
def _(spark, sf):
    out = energy.grid_balance(hourly(spark, sf), "load_kw", RENEWABLES)
    return out.select("ts", "grid_import_kw", "grid_export_kw", "renewable_used_kw", "renewable_kw")


def day_table(spark, sf):
    return energy.daily_energy_summary(hourly(spark, sf), SITE, "load_kw", RENEWABLES, "charge_kw", "discharge_kw", "soc", 1.0)


DAYS = (
    "SELECT *, grid_import_kwh - grid_export_kwh AS grid_net_kwh, CASE WHEN total_load_kwh > 0 THEN total_renewable_used_kwh / total_load_kwh END AS renewable_fraction_of_load, "
    "CASE WHEN battery_charged_kwh > 0 THEN battery_discharged_kwh / battery_charged_kwh END AS battery_efficiency FROM ("
    "SELECT CAST(ts AS DATE) AS date, coalesce(sum(load_kw), 0.0) AS total_load_kwh, sum(ren) AS total_renewable_prod_kwh, sum(used) AS total_renewable_used_kwh, sum(imp) AS grid_import_kwh, "
    "sum(exp) AS grid_export_kwh, coalesce(sum(charge_kw), 0.0) AS battery_charged_kwh, coalesce(sum(discharge_kw), 0.0) AS battery_discharged_kwh, min(soc) AS soc_min, max(soc) AS soc_max, avg(soc) AS soc_avg "
    f"FROM ({BALANCE}) GROUP BY 1)"
)
DAY_ROUNDS = (
    "total_load_kwh total_renewable_prod_kwh total_renewable_used_kwh grid_import_kwh grid_export_kwh battery_charged_kwh battery_discharged_kwh soc_min soc_max soc_avg "
    "grid_net_kwh renewable_fraction_of_load battery_efficiency"
)


@query("daily_energy_summary", DAYS, DAY_ROUNDS)
def _(spark, sf):
    return day_table(spark, sf)


ML_ROUNDS = "total_load_kwh total_renewable_prod_kwh battery_capacity_kwh grid_import_kwh"


@query("daily_ml_rows", f"SELECT date, total_load_kwh, total_renewable_prod_kwh, soc_max AS battery_capacity_kwh, grid_import_kwh FROM ({DAYS})", ML_ROUNDS)
def _(spark, sf):
    return energy.daily_ml_rows(day_table(spark, sf))


NUMBERED = f"SELECT *, row_number() OVER (ORDER BY ts) - 1 AS i FROM ({HOURLY_SQL})"


@query(
    "clamped_running_balance",
    f"WITH RECURSIVE h AS MATERIALIZED ({NUMBERED}), w AS (SELECT ts, i, soc AS balance FROM h WHERE i = 0 UNION ALL "
    "SELECT h.ts, h.i, least(100.0, greatest(0.0, w.balance + (greatest(0.0, coalesce(h.charge_kw, 0.0)) * 0.95 - greatest(0.0, coalesce(h.discharge_kw, 0.0)) * 0.95) * 1.0 / 50.0 * 100.0)) "
    "FROM w JOIN h ON h.i = w.i + 1) SELECT ts, balance FROM w",
    "balance",
)
def _(spark, sf):
    delta = energy.soc_delta(1.0, 50.0, 0.95, 0.95, "charge_kw", "discharge_kw")
    rows = hourly(spark, sf).select("ts", "soc", delta.alias("delta"))
    return energy.clamped_running_balance(rows, SITE, "delta", start="soc").select("ts", "balance")


CAPS = ", ".join(f"({i}, {c})" for i, c in enumerate(energy.CAPACITIES))
ETAS = ", ".join(f"({i}, {e})" for i, e in enumerate(energy.EFFICIENCIES))
FIT = (
    f"WITH h AS ({NUMBERED}), s AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS month, soc - lag(soc) OVER (PARTITION BY date_trunc('month', ts) ORDER BY i) AS y, soc, "
    "greatest(0.0, coalesce(charge_kw, 0.0)) * 1.0 * 100.0 AS u, greatest(0.0, coalesce(discharge_kw, 0.0)) * 1.0 * 100.0 AS d FROM h), "
    "m AS (SELECT month, count(*) AS n, sum(y * y) AS yy, sum(u * y) AS uy, sum(d * y) AS dy, sum(u * u) AS uu, sum(d * d) AS dd, sum(u * d) AS ud FROM s WHERE y IS NOT NULL AND soc > 0 AND soc < 100 GROUP BY 1), "
    f"g AS (SELECT (c.i * 4 + a.i) * 4 + b.i AS k, c.v::DOUBLE AS cap, a.v::DOUBLE AS up, b.v::DOUBLE AS down FROM (VALUES {CAPS}) c(i, v) CROSS JOIN (VALUES {ETAS}) a(i, v) CROSS JOIN (VALUES {ETAS}) b(i, v)), "
    "e AS (SELECT month, n, k, cap, up, down, round(greatest(0.0, yy - 2 * (up / cap) * uy + 2 * (down / cap) * dy + (up / cap) * (up / cap) * uu + (down / cap) * (down / cap) * dd - 2 * (up / cap) * (down / cap) * ud), 6) AS sse FROM m CROSS JOIN g) "
    "SELECT month, cap AS capacity_kwh, up AS eta_ch, down AS eta_dis, sqrt(sse / n) AS rmse, n AS n_obs FROM (SELECT *, row_number() OVER (PARTITION BY month ORDER BY sse, k) AS place FROM e) WHERE place = 1"
)


@query("fit_parameters", FIT, "rmse")
def _(spark, sf):
    from tidewatt.operators.buckets import run_per_month

    return run_per_month(hourly(spark, sf), SITE, energy.fit_parameters, hours=1.0, soc="soc", charge="charge_kw", discharge="discharge_kw")


MULTIPLES = ", ".join(f"({i}, {m}::DOUBLE)" for i, m in enumerate(energy.CAPACITY_MULTIPLES))
SWEEP = (
    f"WITH d AS (SELECT CAST(ts AS DATE) AS date, sum({LOAD}) AS total_load_kwh, sum(ren) AS total_renewable_prod_kwh, sum(imp) AS deficit, sum(exp) AS surplus, sum(least(imp, 50.0)) AS wanted, sum(least(exp, 50.0)) AS offered, "
    f"CASE WHEN max(soc) > 5 THEN max(soc) ELSE 100.0 END AS cap FROM ({BALANCE}) GROUP BY 1), "
    f"s AS (SELECT d.*, m.i AS o, m.v * cap AS added, least(offered * 0.9::DOUBLE, (cap + m.v * cap) * 0.9::DOUBLE - (cap + m.v * cap) * 0.1::DOUBLE) AS stored FROM d CROSS JOIN (VALUES {MULTIPLES}) m(i, v)), "
    "t AS (SELECT *, least(wanted, stored * 0.93::DOUBLE) AS di FROM s) "
    "SELECT date, o AS candidate_order, cap AS capacity_kwh, added AS added_kwh, total_load_kwh, total_renewable_prod_kwh, deficit - di AS grid_import_kwh, surplus - di / (0.9::DOUBLE * 0.93::DOUBLE) AS grid_export_kwh, "
    "deficit - di - (surplus - di / (0.9::DOUBLE * 0.93::DOUBLE)) AS grid_net_kwh, di / (0.9::DOUBLE * 0.93::DOUBLE) AS battery_charged_kwh, di AS battery_discharged_kwh, "
    "(cap + added) * 0.1::DOUBLE AS soc_min_kwh, (cap + added) * 0.1::DOUBLE + di / 0.93::DOUBLE AS soc_max_kwh FROM t"
)
SWEEP_ROUNDS = (
    "capacity_kwh added_kwh total_load_kwh total_renewable_prod_kwh grid_import_kwh grid_export_kwh grid_net_kwh battery_charged_kwh battery_discharged_kwh soc_min_kwh soc_max_kwh"
)


def sweep(spark, sf):
    return energy.capacity_sweep(hourly(spark, sf), SITE, "load_kw", RENEWABLES, "soc", "1 hour")


@query("capacity_sweep", SWEEP, SWEEP_ROUNDS)
def _(spark, sf):
    return sweep(spark, sf)


@query(
    "recommend_capacity",
    "SELECT date, added_kwh AS recommended_kwh, grid_import_kwh AS expected_import_kwh, grid_export_kwh AS expected_export_kwh, base - grid_import_kwh AS reduction_kwh, "
    "CASE WHEN base > 0 THEN (base - grid_import_kwh) / base * 100 END AS reduction_pct, "
    "printf('%.2f kWh more storage on top of %.1f kWh lowers the day''s grid import by %.2f kWh', added_kwh, capacity_kwh, base - grid_import_kwh) || "
    "CASE WHEN base > 0 THEN printf(' (%.2f%%)', (base - grid_import_kwh) / base * 100) ELSE '' END || '.' AS notes FROM ("
    "SELECT *, row_number() OVER (PARTITION BY date ORDER BY grid_net_kwh, candidate_order) AS k, first_value(grid_import_kwh) OVER (PARTITION BY date ORDER BY candidate_order) AS base "
    f"FROM ({SWEEP})) WHERE k = 1",
    "recommended_kwh expected_import_kwh expected_export_kwh reduction_kwh reduction_pct",
)
def _(spark, sf):
    return energy.recommend_capacity(sweep(spark, sf))
