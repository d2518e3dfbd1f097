"""loglathe: a Spark-native log normalisation and classification engine."""

__version__ = "0.1.0"
