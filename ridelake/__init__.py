"""Ride-hailing analytics as PySpark DataFrame operators and streaming jobs."""

__version__ = "0.1.0"
