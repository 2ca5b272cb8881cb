"""Tables: parquet paths registered as views, with lazily read footers.

``Catalog.load_table`` registers one parquet file or folder. Column and table statistics are not kept
here: Spark reads them from the footers when it prunes row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


class Catalog:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: dict[str, DataFrame] = {}

    def load_table(self, name: str, path: str) -> DataFrame:
        """Register a parquet table under a name; its schema comes from the footer."""
        return self.add(name, self.spark.read.parquet(path))

    def add(self, name: str, df: DataFrame) -> DataFrame:
        """Register a DataFrame, such as an in-memory table made by ``createDataFrame``."""
        self.tables[name] = df
        df.createOrReplaceTempView(name)
        return df

    def load_folder(self, folder: str, names: tuple[str, ...] = TABLES) -> "Catalog":
        for name in names:
            self.load_table(name, f"{folder}/{name}.parquet")
        return self

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def column_types(self) -> dict[str, set[str]]:
        """Every type a column name has among the registered tables."""
        out: dict[str, set[str]] = {}
        for df in self.tables.values():
            for name, kind in df.dtypes:
                out.setdefault(name.lower(), set()).add(kind)
        return out


class Tables:
    """Attribute access to the tables of a folder: only those that are named are opened."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
