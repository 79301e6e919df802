"""Shoal: community detection on edge tables with Spark."""

__version__ = "0.1.0"
