"""Power spectra of long series: a distributed chirp transform in four steps, and the peaks of the result.

The transform of n values at the frequencies k / n is a convolution with a chirp, and that is a
product of two transforms of a power of two, M <= 3 n. Each of those is laid out as a grid of R rows
and C columns: transforms along the columns, turns, transforms along the rows; the way back takes the
same steps in turn, so rows are done forth and back in one task. Values move three times
(to column bands, to row bands as packed blocks, and back), and the work is n log n.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from tidewatt.operators.ordered import long_form
from tidewatt.plans.order import chunked
from tidewatt.plans.sizing import attach, broadcast_if_small, same_keys
from tidewatt.session import freeze
from tidewatt.spec import SeriesSpec

# Complex values of the grid that one task holds; results do not depend on it.
CELLS = 1 << 18
# Bins of one range of the peak search; results do not depend on it.
RANGE_BINS = 1 << 16
# Positions are squared in unsigned 64-bit numbers.
LONGEST = 1 << 32


def grid(n: int, cells: int) -> tuple[int, int, int, int]:
    """Rows and columns of the grid, columns of a column band, rows of a row band."""
    bits = (n + n // 2).bit_length()
    rows, columns = 1 << bits // 2, 1 << (bits - bits // 2)
    return rows, columns, max(1, min(columns, cells // rows)), max(1, min(rows, cells // columns))


def turn(steps: np.ndarray, period: int, back: bool = False) -> np.ndarray:
    """exp(-2 pi i steps / period), or its conjugate; whole steps are taken modulo the period, so phases stay exact."""
    return np.exp((2j if back else -2j) * np.pi * ((steps % period) / period))


def half_squares(at: np.ndarray, n: int) -> np.ndarray:
    """at x at modulo 2 n."""
    square = at.astype(np.uint64)
    return (square * square % np.uint64(2 * n)).astype(np.int64)


def down_columns(idx: np.ndarray, y: np.ndarray, n: int, band: int, cells: int) -> np.ndarray:
    """Column transforms of one band, turned, of the chirped values and of the chirp: an array (2, R, columns)."""
    if n > LONGEST:
        raise ValueError(f"a series may have {LONGEST} rows, this one has {n}")
    rows, columns, wide, _ = grid(n, cells)
    at = band * wide + np.arange(wide)
    both = np.zeros((2, rows, wide), complex)
    both[0, idx // columns, idx % columns - band * wide] = y * turn(half_squares(idx, n), 2 * n)
    place = np.arange(rows)[:, None] * columns + at
    distance = np.where(place <= n // 2, place, rows * columns - place)
    used = distance < n
    both[1][used] = turn(half_squares(distance[used], n), 2 * n, back=True)
    return np.fft.fft(both, axis=1) * turn(np.arange(rows)[:, None] * at, rows * columns)


def along_rows(both: np.ndarray, n: int, band: int, cells: int) -> np.ndarray:
    """Row transforms of one band (2, rows, C), multiplied, and the same step back, turned: an array (rows, C)."""
    rows, columns, _, high = grid(n, cells)
    forth = np.fft.fft(both, axis=2)
    at = band * high + np.arange(high)
    return np.fft.ifft(forth[0] * forth[1], axis=1) * turn(at[:, None] * np.arange(columns), rows * columns, back=True)


def up_columns(turned: np.ndarray, n: int, band: int, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins and powers that one column band (R, columns) of the way back holds."""
    _, columns, wide, _ = grid(n, cells)
    sums = np.fft.ifft(turned, axis=0)
    bins = np.arange(len(turned))[:, None] * columns + band * wide + np.arange(wide)
    own = (bins >= 1) & (bins <= n // 2)
    return bins[own], np.abs(sums[own]) ** 2


def spectrum(df: DataFrame, spec: SeriesSpec, cells: int | None = None, rows_per_chunk: int | None = None) -> DataFrame:
    """Power of the linearly detrended series per frequency: the full periodogram, whatever its length.

    Series of fewer than 10 known values give no rows. A task holds ``cells`` values of the grid (rounded
    down to a power of two), one column or row of it at least (about the root of twice its size).
    """
    cells = 1 << (cells or CELLS).bit_length() - 1
    rows, long = long_form(df, spec)
    rows = rows.filter("value IS NOT NULL")
    keys = list(long.keys)
    parts = chunked(rows, long, rows_per_chunk=rows_per_chunk)
    placed = parts.trim(parts.frame.withColumn("idx", parts.position)).select(*keys, "idx", "value")
    x = F.col("idx").cast("double")
    fit = placed.groupBy(*keys).agg(
        F.count("*").alias("steps"), F.regr_slope("value", x).alias("_k"), F.regr_intercept("value", x).alias("_b")
    ).filter(F.col("steps") >= 10)
    # The same grid as grid(), in SQL: its columns and the columns of a band.
    bits = F.length(F.bin(F.col("steps") + F.floor(F.col("steps") / 2)))
    fit = fit.withColumn("_bits", bits)
    fit = fit.withColumn("_rows", F.pow(F.lit(2), F.floor(F.col("_bits") / 2)).cast("bigint"))
    fit = fit.withColumn("_columns", F.pow(F.lit(2), F.col("_bits") - F.floor(F.col("_bits") / 2)).cast("bigint"))
    wide = F.greatest(F.lit(1), F.least("_columns", F.floor(F.lit(cells) / F.col("_rows"))))
    fit = fit.select(*keys, "steps", "_k", "_b", "_columns", wide.cast("bigint").alias("_wide"))
    flat = attach(placed, fit, keys).filter("steps IS NOT NULL").select(
        *keys, "idx", "steps", F.floor(F.col("idx") % F.col("_columns") / F.col("_wide")).alias("_band"),
        (F.col("value") - F.col("_k") * F.col("idx") - F.col("_b")).alias("y"),
    )
    kinds = dict(flat.dtypes)
    named = [f"`{k}` {kinds[k]}" for k in keys]
    blocks = ", ".join([*named, "steps bigint", "_band bigint", "_part bigint", "_data binary"])

    def framed(pdf: pd.DataFrame, **columns) -> pd.DataFrame:
        out = pd.DataFrame({"steps": int(pdf["steps"].iloc[0]), **columns})
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    def cut(pdf: pd.DataFrame, grid_part: np.ndarray, axis: int, width: int) -> pd.DataFrame:
        """Blocks for the bands along ``axis``; each remembers the band it comes from."""
        pieces = np.split(grid_part, grid_part.shape[axis] // width, axis=axis)
        data = [np.ascontiguousarray(p).tobytes() for p in pieces]
        return framed(pdf, _band=np.arange(len(pieces)), _part=int(pdf["_band"].iloc[0]), _data=data)

    def joined(pdf: pd.DataFrame, shape: tuple, axis: int) -> np.ndarray:
        pdf = pdf.sort_values("_part")
        return np.concatenate([np.frombuffer(d, complex).reshape(shape) for d in pdf["_data"]], axis=axis)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        n, band = int(pdf["steps"].iloc[0]), int(pdf["_band"].iloc[0])
        return cut(pdf, down_columns(pdf["idx"].to_numpy(np.int64), pdf["y"].to_numpy(float), n, band, cells), 1, grid(n, cells)[3])

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        n, band = int(pdf["steps"].iloc[0]), int(pdf["_band"].iloc[0])
        _, _, wide, high = grid(n, cells)
        return cut(pdf, along_rows(joined(pdf, (2, high, wide), 2), n, band, cells), 1, wide)

    def third(pdf: pd.DataFrame) -> pd.DataFrame:
        n, band = int(pdf["steps"].iloc[0]), int(pdf["_band"].iloc[0])
        _, _, wide, high = grid(n, cells)
        bins, power = up_columns(joined(pdf, (high, wide), 0), n, band, cells)
        return framed(pdf, bin=bins, power=power)

    bands = flat.groupBy(*keys, "_band").applyInPandas(first, blocks)
    turned = bands.groupBy(*keys, "_band").applyInPandas(second, blocks)
    return turned.groupBy(*keys, "_band").applyInPandas(third, ", ".join([*named, "steps bigint", "bin bigint", "power double"]))


def peaks(power: DataFrame, keys, top: int, range_bins: int | None = None) -> DataFrame:
    """The ``top`` local peaks of each spectrum by power, or its strongest bins if it has no peak, with ``rank``.

    Bins are searched range by range, each with one bin of its neighbours; only the best of a
    range, at most twice ``top``, meet in the ranking of the series.
    """
    bins = range_bins or RANGE_BINS
    keys = list(keys)

    def of(offset: int):
        return F.floor((F.col("bin") + offset - 1) / bins)

    copies = power.withColumn("_own", of(0)).withColumn("_range", F.explode(F.array_distinct(F.array(of(-1), of(0), of(1)))))
    w = Window.partitionBy(*keys, "_range").orderBy("bin")
    is_peak = (F.col("power") > F.lag("power").over(w)) & (F.col("power") > F.lead("power").over(w))
    marked = copies.withColumn("_peak", F.coalesce(is_peak, F.lit(False))).filter(F.col("_own") == F.col("_range"))
    best = Window.partitionBy(*keys, "_range", "_peak").orderBy(F.desc("power"), "bin")
    few = marked.withColumn("_n", F.row_number().over(best)).filter(F.col("_n") <= top)
    few = few.withColumn("_any", F.max("_peak").over(Window.partitionBy(*keys))).filter(F.col("_peak") | ~F.col("_any"))
    last = Window.partitionBy(*keys).orderBy(F.desc("power"), "bin")
    ranked = few.withColumn("rank", F.row_number().over(last).cast("bigint")).filter(F.col("rank") <= top)
    return ranked.drop("_own", "_range", "_peak", "_n", "_any")


def dominant_periods(
    df: DataFrame, spec: SeriesSpec, step_seconds: float | DataFrame, top: int = 5, cells: int | None = None, rows_per_chunk: int | None = None
) -> DataFrame:
    """The ``top`` periods at local peaks of the spectrum (or of all of it, if it has no peak).

    ``step_seconds`` is one number for all series, or a table of keys and ``step_seconds``; a series
    without a step there has null periods.
    """
    keys = [*spec.keys, "signal"]
    ranked = peaks(spectrum(df, spec, cells, rows_per_chunk), keys, top)
    if isinstance(step_seconds, DataFrame):
        steps = freeze(step_seconds.select(*spec.keys, F.col("step_seconds").cast("double").alias("_step")))
        ranked = same_keys(ranked, broadcast_if_small(steps), list(spec.keys))
    else:
        ranked = ranked.withColumn("_step", F.lit(float(step_seconds)))
    step = F.when(F.col("_step") > 0, F.col("_step"))
    seconds = F.rint(F.col("steps") * step / F.col("bin")).cast("bigint")
    return ranked.select(
        *keys, "rank", seconds.alias("period_seconds"), (seconds / 3600).alias("period_hours"),
        F.rint(seconds / step).cast("bigint").alias("period_steps"), "power",
    )
