"""Correlation, lag, seasonal and stationarity queries."""

from itertools import combinations

from pyspark.sql import functions as F

from tidewatt.catalog.common import EVENTS, GAPPY_SQL, HOURLY, HOURLY_SQL, MEASURES, events, gappy, hourly, order_by, query, table
from tidewatt.operators import lagstats, learn, seasonal, spectra, stationarity
from tidewatt.spec import SeriesSpec
from tidewatt import workflows


@query(
    "align_pair",
    "SELECT a.ts, a.v AS view, b.v AS click FROM (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1) a "
    "JOIN (SELECT date_trunc('hour', ts) AS ts, avg(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1) b ON a.ts = b.ts",
    "view click",
)
def _(spark, sf):
    rows = events(spark, sf).withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return lagstats.align_pair(rows, EVENTS, "event_type", "view", "click")


MATRIX = " UNION ALL ".join(
    [f"SELECT '{c}' AS a, '{c}' AS b, 1.0::DOUBLE AS r" for c in MEASURES]
    + [f"SELECT '{p}' AS a, '{q}' AS b, corr({p}, {q}) AS r FROM lineitem" for x, y in combinations(MEASURES, 2) for p, q in ((x, y), (y, x))]
)


@query("correlation_matrix", MATRIX, "r")
def _(spark, sf):
    return lagstats.correlation_matrix(table(spark, sf, "lineitem", *MEASURES), MEASURES)


@query("top_correlations", f"SELECT a, b, r, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY abs(r) DESC, b) AS rank FROM ({MATRIX}) WHERE a <> b) WHERE rank <= 2", "r")
def _(spark, sf):
    return lagstats.top_correlations(lagstats.correlation_matrix(table(spark, sf, "lineitem", *MEASURES), MEASURES), 2)


L = 48
# A cycle on top of the readings, so that some lags stand out.
CYCLE = "coalesce(value, 0.0) + 30 * sin(2 * pi() * (event_id % 120) / 120)"


def acf_sql(rows: str) -> str:
    centred = f"SELECT event_type, ts, event_id, value - avg(value) OVER (PARTITION BY event_type) AS c, count(*) OVER (PARTITION BY event_type) AS n FROM ({rows}) WHERE value IS NOT NULL"
    return (
    "SELECT event_type, 'value' AS signal, lag, value, n_obs FROM (SELECT event_type, n AS n_obs, unnest(range(0, " + str(L + 1) + ")) AS lag, unnest(["
    + ", ".join(["1.0"] + [f"sum(c * l{k}) / sum(c * c)" for k in range(1, L + 1)])
    + "]) AS value FROM (SELECT *, "
    + ", ".join(f"lag(c, {k}) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS l{k}" for k in range(1, L + 1))
    + f" FROM ({centred})) GROUP BY event_type, n)"
    )


ACF = acf_sql(GAPPY_SQL)
CYCLIC_ACF = acf_sql(f"SELECT event_type, ts, event_id, {CYCLE} AS value FROM ({GAPPY_SQL})")


def acf_rows(spark, sf):
    return lagstats.acf(gappy(spark, sf), EVENTS, L)


@query("acf", ACF, "value")
def _(spark, sf):
    return acf_rows(spark, sf)


@query("acf_chunked", ACF, "value")
def _(spark, sf):
    return lagstats.acf(gappy(spark, sf), EVENTS, L, rows_per_chunk=150)


PACF = (
    f"WITH RECURSIVE a AS (SELECT event_type, signal, n_obs, list(value ORDER BY lag) AS r FROM ({ACF}) GROUP BY event_type, signal, n_obs), "
    "w AS (SELECT event_type, signal, n_obs, r, 1 AS k, [r[2]] AS phi, r[2] AS p FROM a UNION ALL "
    "SELECT event_type, signal, n_obs, r, k + 1, list_append(list_transform(list_zip(phi, list_reverse(phi)), lambda z: z[1] - q * z[2]), q), q FROM ("
    f"SELECT *, (r[k + 2] - list_dot_product(phi, list_reverse(r[2:k + 1]))) / (1 - list_dot_product(phi, r[2:k + 1])) AS q FROM w WHERE k < {L})) "
    "SELECT event_type, signal, n_obs, k AS lag, p AS value FROM w UNION ALL SELECT event_type, signal, n_obs, 0 AS lag, 1.0 AS value FROM a"
)


@query("pacf", PACF, "value")
def _(spark, sf):
    return lagstats.pacf(acf_rows(spark, sf), ["event_type", "signal"])


@query(
    "significant_lags",
    f"SELECT event_type, signal, lag, value, n_obs, 2.0 / sqrt(n_obs) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY lag) AS k "
    f"FROM ({CYCLIC_ACF}) WHERE lag > 0 AND abs(value) > 2.0 / sqrt(n_obs)) WHERE k <= 20",
    "value threshold",
)
def _(spark, sf):
    rows = gappy(spark, sf).withColumn("value", F.expr(CYCLE))
    return lagstats.significant_lags(lagstats.acf(rows, EVENTS, L), ["event_type", "signal"])


def ccf_sql(max_lag: int, center: bool) -> str:
    shift = "{0} - avg({0}) OVER ()" if center else "{0}"
    rows = (
        f"SELECT ts, {shift.format('load_kw')} AS x, {shift.format('solar_kw')} AS y, count(*) OVER () AS n, stddev_pop(load_kw) OVER () * stddev_pop(solar_kw) OVER () AS s "
        f"FROM ({HOURLY_SQL}) WHERE load_kw IS NOT NULL AND solar_kw IS NOT NULL"
    )
    cells = []
    for k in range(-max_lag, max_lag + 1):
        cells.append("x * y" if k == 0 else f"x * lag(y, {k}) OVER (ORDER BY ts)" if k > 0 else f"y * lag(x, {-k}) OVER (ORDER BY ts)")
    products = ", ".join(f"{c} AS p{i}" for i, c in enumerate(cells))
    sums = ", ".join(f"sum(p{i}) / (s * n)" for i in range(len(cells)))
    out = f"SELECT unnest(range({-max_lag}, {max_lag + 1})) AS lag, unnest([{sums}]) AS value, n AS n_obs FROM (SELECT *, {products} FROM ({rows})) GROUP BY n, s"
    return f"SELECT * FROM ({out}) WHERE abs(lag) <= CASE WHEN n_obs < {2 * max_lag} THEN n_obs // 2 ELSE {max_lag} END"


PAIR = HOURLY.with_signals("load_kw", "solar_kw")


@query("ccf", ccf_sql(24, True), "value")
def _(spark, sf):
    return lagstats.ccf(hourly(spark, sf), PAIR, 24)


@query("ccf_uncentred", ccf_sql(24, False), "value")
def _(spark, sf):
    return lagstats.ccf(hourly(spark, sf), PAIR, 24, center=False)


@query("best_lag", f"SELECT lag AS best_lag, value AS best_corr FROM ({ccf_sql(24, True)}) ORDER BY abs(value) DESC, lag LIMIT 1", "best_corr")
def _(spark, sf):
    return lagstats.best_lag(lagstats.ccf(hourly(spark, sf), PAIR, 24))


def trend_sql(period: int) -> str:
    half = period // 2
    over = "OVER (PARTITION BY event_type ORDER BY ts, event_id"
    span = f"{over} ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING)"
    ends = f" - (lag(value, {half}) {over}) + lead(value, {half}) {over})) / 2" if period % 2 == 0 else ""
    return (
        f"SELECT event_type, ts, event_id, value, row_number() {over}) - 1 AS idx, count(*) OVER (PARTITION BY event_type) AS n, "
        f"CASE WHEN count(value) {span} = {2 * half + 1} THEN (sum(value) {span}{ends}) / {period} END AS t FROM ({GAPPY_SQL}) WHERE value IS NOT NULL"
    )


P = 24
FRONT = f"idx >= {P // 2} AND idx < least({P // 2} + {P}, n - 1 - {P // 2})"
BACK = f"idx >= greatest({P // 2}, n - 1 - {P // 2} - {P}) AND idx < n - 1 - {P // 2}"
DECOMPOSE = (
    f"WITH b AS ({trend_sql(P)}), l AS (SELECT event_type, "
    + ", ".join(
        f"regr_{f}(CASE WHEN {cond} THEN t END, CASE WHEN {cond} THEN idx END) AS {side}{f[0]}"
        for side, cond in (("f", FRONT), ("b", BACK)) for f in ("slope", "intercept")
    )
    + " FROM b GROUP BY 1), "
    f"e AS (SELECT event_type, ts, event_id, idx, value, CASE WHEN idx < {P // 2} THEN fs * idx + fi WHEN idx > n - 1 - {P // 2} THEN bs * idx + bi ELSE t END AS trend FROM b JOIN l USING (event_type)), "
    f"m AS (SELECT event_type, idx % {P} AS ph, avg(value - trend) AS v FROM e GROUP BY 1, 2), s AS (SELECT event_type, ph, v - avg(v) OVER (PARTITION BY event_type) AS seasonal FROM m) "
    f"SELECT e.event_type, 'value' AS signal, ts, event_id, idx, value, trend, seasonal, value - trend - seasonal AS residual FROM e JOIN s ON s.event_type = e.event_type AND s.ph = e.idx % {P}"
)


@query("seasonal_decompose", DECOMPOSE, "trend seasonal residual")
def _(spark, sf):
    return seasonal.seasonal_decompose(gappy(spark, sf), EVENTS, P)


@query(
    "seasonal_amplitude",
    " UNION ALL ".join(
        f"SELECT event_type, 'value' AS signal, {p} AS period, max(v) - min(v) AS seasonal_amplitude FROM (SELECT event_type, idx % {p} AS ph, avg(value - t) AS v FROM ({trend_sql(p)}) WHERE n >= {2 * p} GROUP BY 1, 2) GROUP BY 1"
        for p in (7, 24, 96)
    ),
    "seasonal_amplitude",
)
def _(spark, sf):
    return seasonal.seasonal_amplitude(gappy(spark, sf), EVENTS, [7, 24, 96])


DFT = (
    f"WITH h AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, load_kw AS v FROM ({HOURLY_SQL}) WHERE load_kw IS NOT NULL), "
    "f AS (SELECT count(*) AS n, regr_slope(v, i) AS k, regr_intercept(v, i) AS b FROM h), d AS (SELECT i, v - k * i - b AS y FROM h CROSS JOIN f), "
    "g AS (SELECT unnest(range(1, (SELECT n // 2 + 1 FROM f))) AS bin), "
    "p AS (SELECT bin, pow(sum(y * cos(2 * pi() * ((bin * i) % n) / n)), 2) + pow(sum(y * sin(2 * pi() * ((bin * i) % n) / n)), 2) AS power, n FROM d CROSS JOIN g CROSS JOIN f GROUP BY bin, n), "
    "k AS (SELECT *, power > lag(power) OVER (ORDER BY bin) AND power > lead(power) OVER (ORDER BY bin) AS peak FROM p), "
    "r AS (SELECT *, row_number() OVER (ORDER BY power DESC, bin) AS rank, CAST(round_even(n * 3600.0 / bin, 0) AS BIGINT) AS s FROM k WHERE peak) "
    "SELECT 'load_kw' AS signal, rank, s AS period_seconds, s / 3600 AS period_hours, CAST(round_even(s / 3600, 0) AS BIGINT) AS period_steps, power FROM r WHERE rank <= 5"
)


@query("dominant_periods", DFT, "period_hours power", 4)
def _(spark, sf):
    return spectra.dominant_periods(hourly(spark, sf), HOURLY.with_signals("load_kw"), 3600)


def adf_sql(max_d: int, lags: int) -> str:
    """Statistic of each lag difference: the regressors are made orthogonal one by one, so the last step is a plain slope."""
    keys = "event_type, d"
    parts = [
        f"SELECT event_type, CAST({d} AS BIGINT) AS d, i, v - lag(v, {d}) OVER w AS x FROM (SELECT event_type, ts, event_id, value AS v, row_number() OVER ({order_by()}) AS i "
        f"FROM ({GAPPY_SQL}) WHERE value IS NOT NULL) WINDOW w AS (PARTITION BY event_type ORDER BY i)" if d else
        f"SELECT event_type, CAST(0 AS BIGINT) AS d, row_number() OVER ({order_by()}) AS i, value AS x FROM ({GAPPY_SQL}) WHERE value IS NOT NULL"
        for d in range(max_d + 1)
    ]
    names = [f"z{j}" for j in range(1, lags + 1)] + ["x", "y"]
    changes = ", ".join(f"lag(c, {j}) OVER w AS z{j}" for j in range(1, lags + 1))
    steps = [
        f"a AS ({' UNION ALL '.join(parts)})",
        f"b AS (SELECT {keys}, i, x, x - lag(x) OVER (PARTITION BY {keys} ORDER BY i) AS c FROM a WHERE x IS NOT NULL)",
        f"r AS (SELECT {keys}, lag(x) OVER w AS x, c AS y, {changes} FROM b WINDOW w AS (PARTITION BY {keys} ORDER BY i))",
        f"q AS (SELECT {keys}, {', '.join(f'{v} - avg({v}) OVER (PARTITION BY {keys}) AS {v}' for v in names)} FROM r WHERE z{lags} IS NOT NULL)",
    ]
    last = "q"
    for k in range(lags):
        u, rest = names[k], names[k + 1 :]
        slopes = ", ".join(f"sum({v} * {u}) OVER (PARTITION BY {keys}) / sum({u} * {u}) OVER (PARTITION BY {keys}) AS s_{v}" for v in rest)
        steps.append(f"q{k} AS (SELECT {keys}, {', '.join(f'{v} - s_{v} * {u} AS {v}' for v in rest)} FROM (SELECT *, {slopes} FROM {last}))")
        last = f"q{k}"
    c0, c1, c2, c3 = stationarity.ADF_5PCT
    stat = f"(sum(x * y) / sum(x * x)) / sqrt((sum(y * y) - sum(x * y) * sum(x * y) / sum(x * x)) / (count(*) - {lags + 2}) / sum(x * x))"
    limit = f"{c0}::DOUBLE + {c1}::DOUBLE / n_obs + {c2}::DOUBLE / (n_obs * n_obs) + {c3}::DOUBLE / (n_obs * n_obs * n_obs)"
    return (
        f"WITH {', '.join(steps)} SELECT event_type, 'value' AS signal, d, n_obs, adf_stat, CAST({lags} AS BIGINT) AS used_lag, {limit} AS critical_5pct, adf_stat < {limit} AS stationary "
        f"FROM (SELECT {keys}, count(*) AS n_obs, {stat} AS adf_stat FROM {last} GROUP BY {keys})"
    )


@query("adf_test", f"SELECT * EXCLUDE (d) FROM ({adf_sql(0, 4)})", "adf_stat critical_5pct")
def _(spark, sf):
    return stationarity.adf_test(gappy(spark, sf), EVENTS).drop("p_value")


@query("adf_test_auto", None, "adf_stat critical_5pct p_value")
def _(spark, sf):
    return stationarity.adf_test(gappy(spark, sf), EVENTS, stationarity.AUTO)


@query("suggest_difference", f"SELECT event_type, signal, min(CASE WHEN stationary THEN d END) AS suggested_d FROM ({adf_sql(3, 4)}) GROUP BY 1, 2")
def _(spark, sf):
    return stationarity.suggest_difference(gappy(spark, sf), EVENTS)


def boxcox_sql(steps: int = 40) -> str:
    pos = f"SELECT event_type, value AS v, ln(value) AS lv FROM (SELECT event_type, value + 1 AS value FROM ({GAPPY_SQL})) WHERE value IS NOT NULL"
    llf = "(lam - 1) * sum(lv) - count(lv) / 2.0 * ln(var_pop(CASE WHEN abs(lam) < 1e-12 THEN lv ELSE (exp(lam * lv) - 1) / lam END))"
    return (
        f"WITH x AS ({pos}), c AS (SELECT event_type, lam, {llf} AS f FROM x CROSS JOIN (SELECT round(-2 + i * 0.1, 12) AS lam FROM range(41) r(i)) GROUP BY 1, 2), "
        "b AS (SELECT event_type, arg_max(lam, f) AS l0 FROM c GROUP BY 1), "
        f"d AS (SELECT event_type, lam, {llf} AS f FROM (SELECT x.*, round(l0 + i * 0.005 - 0.1, 12) AS lam FROM x JOIN b USING (event_type) CROSS JOIN range(41) r(i)) GROUP BY 1, 2) "
        "SELECT event_type, 'value' AS signal, 'boxcox' AS suggestion, arg_max(lam, f) AS lambda FROM d GROUP BY 1"
    )


@query("boxcox_hint", boxcox_sql(), "lambda")
def _(spark, sf):
    shifted = gappy(spark, sf).withColumn("value", F.col("value") + 1)
    return stationarity.boxcox_hint(shifted, EVENTS)


FLAGGED = "SELECT o_orderpriority, o_orderstatus, count(*) % 2 = 0 AS stationary, sum(o_custkey) % 3 = 0 AS seasonal FROM orders GROUP BY 1, 2"


@query(
    "recommend_models",
    "SELECT *, CASE WHEN NOT stationary AND seasonal THEN 'SARIMA,Prophet' WHEN NOT stationary THEN 'ARIMA,ETS' WHEN seasonal THEN 'SARIMA,TBATS' "
    f"ELSE 'ARIMA,SimpleExpSmoothing' END AS recommended_models FROM ({FLAGGED})",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
        (F.count("*") % 2 == 0).alias("stationary"), (F.sum("o_custkey") % 3 == 0).alias("seasonal")
    )
    return stationarity.recommend_models(rows).withColumn("recommended_models", F.concat_ws(",", "recommended_models"))


@query("forecast_metadata")
def _(spark, sf):
    out = workflows.forecast_metadata(hourly(spark, sf), HOURLY.with_signals("load_kw", "solar_kw", "wind_kw"))
    return out.select("signal", F.to_json(F.struct(*[c for c in out.columns if c != "signal"])).alias("metadata"))


@query("vif", None, "vif", 4)
def _(spark, sf):
    return learn.vif(table(spark, sf, "lineitem", *MEASURES), MEASURES)


@query("pca_variance", None, "explained_variance_ratio")
def _(spark, sf):
    return learn.pca_variance(table(spark, sf, "lineitem", *MEASURES), MEASURES)


@query("discriminant_variance", None, "explained_variance_ratio")
def _(spark, sf):
    return learn.discriminant_variance(table(spark, sf, "lineitem", "l_returnflag", *MEASURES), MEASURES, "l_returnflag")
