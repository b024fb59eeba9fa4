"""textweft: Spark-native text-reuse analytics and corpus preparation."""

__version__ = "0.1.0"
