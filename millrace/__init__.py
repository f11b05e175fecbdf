"""Trustworthy tables from files, as Spark jobs."""
