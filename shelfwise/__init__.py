"""shelfwise: retail inventory and margin analytics as Spark DataFrame jobs."""

__version__ = "0.1.0"
