"""Spark-native analytics over ordered step logs and the texts they carry."""

__version__ = "0.1.0"
