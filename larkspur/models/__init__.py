"""Estimators: closed forms as aggregates, the rest on pyspark.ml."""
