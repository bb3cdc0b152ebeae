"""Round analytics on Spark: DataFrame-first operators over ordered event streams."""

__version__ = "0.1.0"
