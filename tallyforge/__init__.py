"""Ledger analytics and training-data preparation as Spark DataFrame jobs."""
