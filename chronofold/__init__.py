"""Interval and transcript analytics on Spark."""
