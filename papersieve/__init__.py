"""papersieve: Spark-native document screening and decision-tree analytics."""

__version__ = "0.1.0"
