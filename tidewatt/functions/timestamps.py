"""Lenient timestamp parsing and timestamp arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The two layouts telemetry files use.
SLASH = "yyyy/MM/dd HH:mm:ss"
DASH = "yyyy-MM-dd HH:mm:ss"


def parse_timestamp(column, formats=(SLASH, DASH)) -> Column:
    """Text to a zone-free timestamp; text in none of the formats becomes null."""
    column = F.col(column) if isinstance(column, str) else column
    tried = [F.try_to_timestamp(column, F.lit(f)).cast("timestamp_ntz") for f in formats]
    return F.coalesce(*tried)


# Layouts that are tried on texts of unknown layout; of equally good ones the first counts.
LAYOUTS = (
    DASH, SLASH, "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy/MM/dd HH:mm", "yyyy-MM-dd'T'HH:mm", "MM/dd/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss",
    "MM/dd/yyyy HH:mm", "dd/MM/yyyy HH:mm", "dd.MM.yyyy HH:mm:ss", "dd.MM.yyyy HH:mm", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy",
)


def _swapped(layout: str) -> str:
    """The layout with day and month changed over."""
    return layout.replace("dd", "#").replace("MM", "dd").replace("#", "MM")


def infer_layouts(df: DataFrame, columns, layouts=LAYOUTS) -> dict[str, list[str]]:
    """Which layouts the texts of each column are written in, best first: a vote over the whole table.

    One aggregate counts the texts by the set of layouts that read them. The layout that reads the most is taken, then
    the one that reads the most of the rest, until no layout reads any more. Whether day or month comes first is settled
    once for a column: the layout with the two changed over is out when one is taken. Texts that no layout reads
    count for nothing; a column without readable texts has no layouts.
    """
    found = {}
    for name in [columns] if isinstance(columns, str) else columns:
        text = F.col(f"`{name}`")
        reads = F.array(*[F.try_to_timestamp(text, F.lit(form)).isNotNull() for form in layouts])
        counts = df.where(text.isNotNull()).groupBy(reads.alias("reads")).count().collect()
        left = [({form for form, hit in zip(layouts, r["reads"]) if hit}, r["count"]) for r in counts]
        open_, taken = list(layouts), []
        while open_:
            votes = {form: sum(n for reading, n in left if form in reading) for form in open_}
            best = max(open_, key=votes.__getitem__)
            if votes[best] == 0:
                break
            taken.append(best)
            left = [(reading, n) for reading, n in left if best not in reading]
            open_ = [form for form in open_ if form not in (best, _swapped(best))]
        found[name] = taken
    return found


def parse_inferred(df: DataFrame, column: str, name: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """Add ``name`` (or replace the column): the texts read in the layouts that the column is written in."""
    taken = infer_layouts(df, column, layouts)[column]
    parsed = parse_timestamp(f"`{column}`", tuple(taken)) if taken else F.lit(None).cast("timestamp_ntz")
    return df.withColumn(name or column, parsed)


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp or date column."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(value: Column) -> Column:
    return F.timestamp_micros(value).cast("timestamp_ntz")


def tumbling(ts, width_us: int, origin_us: int = 0) -> Column:
    """Start of the fixed window [start, start + width) that holds the timestamp."""
    at = micros(ts) - F.lit(origin_us)
    width = F.lit(width_us).cast("bigint")
    return from_micros(at - F.pmod(at, width) + F.lit(origin_us))


UNITS_US = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000, "week": 604_800_000_000}
# 1970-01-05 was a Monday; weekly windows start there.
MONDAY_US = 4 * 86_400_000_000


def width_of(every: str) -> int:
    """Microseconds of an interval such as '15 minutes' or '1 day'."""
    count, unit = every.split()
    return int(count) * UNITS_US[unit.rstrip("s")]
