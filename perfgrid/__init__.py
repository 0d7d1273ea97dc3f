"""Choosing, measuring and combining models over many datasets, as Spark jobs."""
