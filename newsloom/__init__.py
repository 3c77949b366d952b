"""Newsloom: a PySpark-native analytics engine for multilingual news corpora."""

__version__ = "0.1.0"
