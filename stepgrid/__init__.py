"""stepgrid: array analytics on Spark (steps, blocks and cells of N-dimensional variables as DataFrames)."""
