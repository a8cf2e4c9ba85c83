"""tickloom: order-book factors, datasets, evaluation and backtests as lazy Spark plans."""
