"""Retail demand analytics as lazy Spark DataFrame jobs."""
