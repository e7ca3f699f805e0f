"""Attesta: name screening, evidence checks and reporting as plain Spark jobs."""
