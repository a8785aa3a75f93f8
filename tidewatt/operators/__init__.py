"""DataFrame operators on time series and tables."""
