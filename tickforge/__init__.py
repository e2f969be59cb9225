"""tickforge: price-bar and event time-series analytics as Spark DataFrame functions."""
