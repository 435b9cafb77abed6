"""DataFrame operators: sequences, lookups, linking, sampling, metrics."""
