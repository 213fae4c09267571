"""Analytics for quantitative research on Spark DataFrames: long panels keyed by symbol and time."""
