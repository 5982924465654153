"""Spark-native analytics for financial time series: indicators, portfolios and
strategy certification over ordinary DataFrames."""
