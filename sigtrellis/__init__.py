"""Spark-native analytics for multichannel time series, events and point sets."""
