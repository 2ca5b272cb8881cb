"""The SELECT dialect, restated as Spark SQL."""
