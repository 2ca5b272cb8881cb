"""Folders that keep receiving parquet files, registered like any table.

A SELECT over such a table is a streaming DataFrame: filters, projections and joins with plain tables
append rows as they come; aggregates need an output mode that restates them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from larkspur.sources.catalog import Catalog


def load_stream(catalog: Catalog, name: str, folder: str) -> DataFrame:
    """Register a folder as an unbounded table; its schema is that of the files it holds already."""
    schema = catalog.spark.read.parquet(folder).schema
    return catalog.add(name, catalog.spark.readStream.schema(schema).parquet(folder))


def run_available(df: DataFrame, into: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process all that has arrived since the checkpoint into an in-memory table, then stop."""
    query = df.writeStream.format("memory").queryName(into).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
