"""Column expressions: timestamps, calendar parts, missing values, error metrics."""
