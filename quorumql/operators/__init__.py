"""Table operators: DataFrames and plain parameters in, DataFrame out."""
