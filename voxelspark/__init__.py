"""A PySpark-native analytics engine for labelled tissue volumes and nucleus tables."""
