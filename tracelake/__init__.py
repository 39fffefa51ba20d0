"""Packet analytics on Spark: captures, detection rules, alerts and reports as DataFrames."""
