"""Spark-native analytics over device logs: ingestion, quality, windows, joins, statistics, resampling."""
