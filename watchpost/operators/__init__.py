"""Table operators: plain functions from DataFrames to DataFrames."""
