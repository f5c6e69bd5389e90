"""Causerie: dialogue corpora and training-data preparation on Spark."""
