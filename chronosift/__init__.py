"""Point-in-time time-series analytics on Apache Spark."""

__version__ = "0.1.0"
