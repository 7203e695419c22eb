"""Tributary: input-flow analytics and corpus preparation on Spark DataFrames."""
