"""memspark: a Spark-native engine for scoped, time-valid knowledge tables."""

__version__ = "0.1.0"
