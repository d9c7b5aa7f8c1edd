"""Pure functions from DataFrames to DataFrames: reads, mutations, constraints, differences and merges."""
