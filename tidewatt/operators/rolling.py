"""Moments of the last ``w`` rows by doubling, without subtracting running sums.

The moments (count, mean, sum of squared deviations) of the last 1, 2, 4, 8, ... rows come from one another:
those of 2n rows are those of n rows merged with those of n rows, n rows earlier. A window of ``w`` rows is put
together from the powers of two in ``w``. So a row costs log2(w) merges for any window, a value outside a window never
touches it, and the same merges are done whatever chunk the row lies in. ``w`` may differ from series to series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatt.functions.values import quoted
from tidewatt.plans.order import Chunked

HELPER = "_rolling_"


def single(v: Column) -> Column:
    """Moments of one known value; null for a missing one, which stands for no values at all."""
    return F.when(v.isNotNull(), F.struct(F.lit(1.0).alias("n"), v.alias("m"), F.lit(0.0).alias("q")))


def pair(x: Column, y: Column) -> Column:
    """Moments and joint moment of one complete pair."""
    zero = F.lit(0.0)
    values = F.struct(F.lit(1.0).alias("n"), x.alias("mx"), y.alias("my"), zero.alias("xx"), zero.alias("yy"), zero.alias("xy"))
    return F.when(x.isNotNull() & y.isNotNull(), values)


def _either(a: Column, b: Column, merged: Column) -> Column:
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(merged)


def merge_single(a: Column, b: Column) -> Column:
    n, d = a["n"] + b["n"], b["m"] - a["m"]
    share = b["n"] / n
    merged = F.struct(n.alias("n"), (a["m"] + d * share).alias("m"), (a["q"] + b["q"] + d * d * (a["n"] * share)).alias("q"))
    return _either(a, b, merged)


def merge_pair(a: Column, b: Column) -> Column:
    n, dx, dy = a["n"] + b["n"], b["mx"] - a["mx"], b["my"] - a["my"]
    share = b["n"] / n
    weight = a["n"] * share
    merged = F.struct(
        n.alias("n"), (a["mx"] + dx * share).alias("mx"), (a["my"] + dy * share).alias("my"),
        (a["xx"] + b["xx"] + dx * dx * weight).alias("xx"), (a["yy"] + b["yy"] + dy * dy * weight).alias("yy"), (a["xy"] + b["xy"] + dx * dy * weight).alias("xy"),
    )
    return _either(a, b, merged)


def with_moments(parts: Chunked, entries: dict[str, Column], windows: dict[str, int | Column], longest: int, merge=merge_single) -> DataFrame:
    """Add ``_rolling_<window>_<entry>``: the merged moments of the last rows, null where none is known.

    ``windows`` names lengths, as numbers or as columns that are constant in a series; none exceeds ``longest``. The
    frame needs ``longest - 1`` rows before each of its own rows. Takes one window pass per power of two, all over one
    sorting.
    """
    frame, at = parts.frame, parts.window
    spans = {e: f"{HELPER}span_{e}" for e in entries}
    frame = frame.withColumns({spans[e]: value for e, value in entries.items()})
    done: dict[tuple[str, str], bool] = {}
    levels = range(max(1, longest).bit_length())
    for level in levels:
        back, more = 1 << level, level < levels[-1]
        used = [w for w, size in windows.items() if not isinstance(size, int) or size >> level & 1]
        olds = [(w, e) for w in used for e in entries if (w, e) in done]
        lagged = {f"{HELPER}old_{w}_{e}": F.lag(quoted(f"{HELPER}{w}_{e}"), back).over(at) for w, e in olds}
        if more:
            lagged |= {f"{HELPER}far_{e}": F.lag(quoted(spans[e]), back).over(at) for e in entries}
        frame = frame.withColumns(lagged)
        out = {}
        for w in used:
            for e in entries:
                name, span = f"{HELPER}{w}_{e}", quoted(spans[e])
                grown = merge(quoted(f"{HELPER}old_{w}_{e}"), span) if (w, e) in done else span
                if not isinstance(windows[w], int):
                    has = F.shiftright(windows[w].cast("bigint"), level) % 2 == 1
                    grown = F.when(has, grown).otherwise(quoted(name) if (w, e) in done else F.lit(None))
                out[name] = grown
                done[w, e] = True
        if more:
            out |= {spans[e]: merge(quoted(f"{HELPER}far_{e}"), quoted(spans[e])) for e in entries}
        frame = frame.withColumns(out).drop(*lagged)
    return frame.drop(*spans.values())


def moments(window: str, entry: str) -> Column:
    return quoted(f"{HELPER}{window}_{entry}")


def drop_moments(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(HELPER)])
