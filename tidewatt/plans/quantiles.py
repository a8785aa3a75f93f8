"""Exact linear-interpolation quantiles for groups of any size.

The built-in ``percentile`` keeps every distinct value of a group in one task. It is used
while the largest group is known to be small; larger groups are cut into counted value
cells, and only the cells that hold a wanted rank are sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatt.plans.order import CELL, count_cells
from tidewatt.plans.sizing import PERCENTILE_VALUES, KeyProfile, broadcast_if_small, profile_keys, same_keys
from tidewatt.session import freeze


def known(value: Column) -> Column:
    """The value as a double, with NaN taken as missing."""
    value = value.cast("double")
    return F.when(~F.isnan(value), value)


def quantile_wide(df: DataFrame, keys, values, probs, profile: KeyProfile | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """One row per key with an array of quantiles for each value column."""
    keys, values, probs = list(keys), list(values), [float(p) for p in probs]
    profile = profile or profile_keys(df, keys)
    if profile.largest * len(values) <= (rows_per_chunk or PERCENTILE_VALUES):
        return df.groupBy(*keys).agg(
            *[F.percentile(known(F.col(v)), F.array(*map(F.lit, probs))).alias(v) for v in values]
        )
    long = df.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(v).alias("_signal"), known(F.col(v)).alias("_value")) for v in values
    ])).alias("_s")).select(*keys, "_s.*")
    per_signal = ranked_quantiles(long, [*keys, "_signal"], "_value", probs, profile.largest, rows_per_chunk)
    return per_signal.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_signal") == v, F.col("quantiles"))).alias(v) for v in values]
    )


def quantile_long(df: DataFrame, keys, value: str, probs, profile: KeyProfile | None = None) -> DataFrame:
    """One row per key with the array ``quantiles``."""
    keys, probs = list(keys), [float(p) for p in probs]
    profile = profile or profile_keys(df, keys)
    if profile.largest <= PERCENTILE_VALUES:
        return df.groupBy(*keys).agg(
            F.percentile(known(F.col(value)), F.array(*map(F.lit, probs))).alias("quantiles")
        )
    return ranked_quantiles(df, keys, value, probs, profile.largest)


def ranked_quantiles(df, keys, value, probs, largest, rows_per_chunk: int | None = None) -> DataFrame:
    """Quantiles by rank selection: count value cells, sort only the cells that matter.

    Every key has a row; its array is null where no value is known.
    """
    keys = list(keys)
    found = _ranked(df, keys, value, probs, rows_per_chunk)
    return same_keys(df.select(*keys).distinct(), found, keys) if keys else found


def _ranked(df, keys, value, probs, rows_per_chunk) -> DataFrame:
    data = df.select(*keys, known(F.col(value)).alias("_value")).filter("_value IS NOT NULL")
    limit = rows_per_chunk or PERCENTILE_VALUES
    cells = count_cells(data, keys, ["_value"], limit)
    builtin = F.percentile("_value", F.array(*map(F.lit, probs))).alias("quantiles")
    if cells is None:
        return data.groupBy(*keys).agg(builtin)

    located = cells.locate(data)
    fitting = located.filter(F.size(CELL) == 0).groupBy(*keys).agg(builtin)

    leaves = cells.leaves
    totals = leaves.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(probs)])
    ranks = totals.select(*keys, "_total", F.explode(wanted).alias("w")).select(
        *keys, F.col("w.i").alias("_i"), (F.col("w.p") * (F.col("_total") - 1)).alias("_pos")
    )
    ranks = ranks.withColumn("_rank", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))))
    inside = same_keys(ranks, leaves, keys, "inner").filter(
        (F.col("_rank") >= F.col("_start")) & (F.col("_rank") < F.col("_start") + F.col("_n"))
    )
    needed = inside.select(*keys, CELL, "_start", "_lo0", "_hi0").distinct()
    mixed = freeze(needed.filter("_lo0 < _hi0").select(*keys, CELL, "_start"))
    rows = same_keys(located.filter(F.size(CELL) > 0), broadcast_if_small(mixed), [*keys, CELL], "inner")
    order = Window.partitionBy(*keys, CELL).orderBy("_value")
    picked = rows.withColumn("_rank", F.row_number().over(order) - 1 + F.col("_start")).select(*keys, "_rank", "_value")
    flat = inside.filter("_lo0 = _hi0").select(*keys, "_rank", F.col("_lo0").alias("_value")).distinct()
    at = picked.unionByName(flat)
    ends = same_keys(ranks.distinct(), at, [*keys, "_rank"], "inner")
    per_prob = ends.groupBy(*keys, "_i", "_pos").agg(F.min_by("_value", "_rank").alias("_a"), F.max_by("_value", "_rank").alias("_b"))
    q = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_pos") - F.floor("_pos"))
    large = per_prob.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda s: s["q"]).alias("quantiles")
    )
    if keys:
        return fitting.unionByName(large)
    return fitting.unionByName(large).agg(F.first(F.when(F.size("quantiles") > 0, F.col("quantiles")), True).alias("quantiles"))
