"""Barloom: market time-series analytics and corpus operators as Spark jobs."""
