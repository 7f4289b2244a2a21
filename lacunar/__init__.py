"""Absence and anomaly analytics for time series on Spark."""
