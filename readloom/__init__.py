"""readloom: a Spark-native engine for cleaning and analysing short sequencing reads."""

__version__ = "0.1.0"
