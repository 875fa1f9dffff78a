"""pithy: text-context compression as DataFrame operators on Apache Spark."""

__version__ = "0.1.0"
