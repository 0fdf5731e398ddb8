"""spanloom: analytics over traces of multi-agent systems, as Spark DataFrame jobs."""

__version__ = "0.1.0"
