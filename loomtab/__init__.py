"""Tabular feature engineering and analytics on Spark DataFrames."""
