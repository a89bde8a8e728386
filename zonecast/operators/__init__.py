"""DataFrame operators: cleaning, quantiles, ranking, encoding, analytics, metrics."""
