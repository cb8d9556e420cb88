"""memspark: a PySpark-native memory analytics engine. Operators take and return DataFrames."""

__version__ = "0.1.0"
