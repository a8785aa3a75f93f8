"""Registered queries over the given tables, with SQL text for checking them."""

from tidewatt.catalog import cleaning, energy, features, ingest, lags, quality, timing  # noqa: F401
from tidewatt.catalog.common import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
