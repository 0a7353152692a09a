"""Versioned key/value change logs and their analytics, as Spark DataFrames."""
