"""Larkspur: an analytics engine expressed in PySpark DataFrames and Spark SQL."""
