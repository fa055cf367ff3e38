"""Spark-native analytics for multiclass imbalanced learning."""
