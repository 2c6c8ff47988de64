"""Session analytics on Spark: DataFrame -> DataFrame operators over agent session logs."""

__version__ = "0.1.0"
