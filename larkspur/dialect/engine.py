"""One SELECT at a time over a catalog, with EXPLAIN."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.catalog import Catalog

from .translate import translate


class Engine:
    def __init__(self, spark: SparkSession, catalog: Catalog | None = None, loose_like: bool = False):
        self.spark, self.catalog, self.loose_like = spark, catalog or Catalog(spark), loose_like

    def load_table(self, name: str, path: str) -> DataFrame:
        return self.catalog.load_table(name, path)

    def sql(self, text: str) -> DataFrame:
        """The statement's rows; for EXPLAIN a row for each line of the plans."""
        restated, explain = translate(text, self.catalog.column_types(), self.loose_like)
        df = self.spark.sql(restated)
        if not explain:
            return df
        return self.spark.createDataFrame([(line,) for line in self.explain(df).splitlines()] or [("",)], "plan string")

    @staticmethod
    def explain(df: DataFrame, mode: str = "extended") -> str:
        """Parsed, analysed, optimised and physical plan; mode ``cost`` adds sizes and rows."""
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain(mode)
        return out.getvalue()
