"""hemaspark: a PySpark-native engine for laboratory-instrument tables, histograms and event clouds."""

__version__ = "0.1.0"
