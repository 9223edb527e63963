"""Station observations as time series, on PySpark DataFrames and Structured Streaming."""
