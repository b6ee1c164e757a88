"""Spark-native engine for longitudinal cohort data and training-data preparation."""
