"""Finding and redacting personal data and secrets in text at scale, on Spark DataFrames."""
