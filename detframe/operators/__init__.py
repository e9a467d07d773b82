"""Detection operators: DataFrame in, DataFrame out, keyed by sample_id."""
