"""oreweave: a PySpark-native engine for collections of binary, media and text files."""

__version__ = "0.1.0"
