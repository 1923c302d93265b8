"""Bar-series analytics on Spark: sources, features, labels, levels, patterns, backtests."""
