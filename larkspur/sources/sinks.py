"""Sinks: what a console shows of a result, and rows or Arrow data for a program."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def console(df: DataFrame, rows: int = 10) -> str:
    """Header, the first rows, the number of all rows and the milliseconds, as text."""
    began = time.perf_counter()
    first = df.limit(rows).collect()
    total = df.count()
    lines = [" | ".join(df.columns), *(" | ".join(str(v) for v in r) for r in first), f"{total} rows, {1000 * (time.perf_counter() - began):.0f} ms"]
    return "\n".join(lines)
