"""How a table maps onto one or many time series."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SeriesSpec:
    """Names of the time column, the series keys, the measured columns and the tie-break.

    ``keys`` may be empty (the whole table is one series). ``tie`` lists columns that make
    ``ts`` a total order inside a series; without it, rows with equal timestamps have no
    defined order.
    """

    ts: str = "timestamp"
    keys: tuple[str, ...] = ()
    signals: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()

    def __post_init__(self):
        for field in ("keys", "signals", "tie"):
            value = getattr(self, field)
            object.__setattr__(self, field, (value,) if isinstance(value, str) else tuple(value))

    @property
    def order(self) -> tuple[str, ...]:
        return (self.ts, *self.tie)

    def with_keys(self, *extra: str) -> "SeriesSpec":
        return replace(self, keys=(*self.keys, *extra))

    def with_signals(self, *signals: str) -> "SeriesSpec":
        return replace(self, signals=tuple(signals))
