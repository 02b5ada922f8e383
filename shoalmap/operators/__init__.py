"""DataFrame in, DataFrame out: joins, aggregates, ranking, sampling, features and models."""
