"""Document-extraction analytics on Spark: DataFrame operators, sources, sinks and streams."""

__version__ = "0.1.0"
