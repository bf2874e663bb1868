"""DataFrame operators on pose time series."""
