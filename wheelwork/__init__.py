"""Mobility analytics on Spark: snapshots, rides, statistics, street graphs and gaps."""
