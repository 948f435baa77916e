"""Hourly KPI cubes and anomaly analysis over web-shop events, as Spark DataFrames."""
