"""``python -m larkspur FOLDER [STATEMENT]``: run one statement over a folder's tables, or read them line by line."""

from __future__ import annotations

import os
import sys

from larkspur.dialect.engine import Engine
from larkspur.dialect.lexer import DialectError
from larkspur.session import session
from larkspur.sources.catalog import TABLES, Catalog
from larkspur.sources.sinks import console


def answer(engine: Engine, text: str) -> str:
    """What the console shows for a statement: rows, a plan, or why it was refused."""
    try:
        df = engine.sql(text)
    except DialectError as e:
        return f"error: {e}"
    if df.columns == ["plan"]:
        return "\n".join(r[0] for r in df.collect())
    return console(df)


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    spark = session("local[*]", **{"spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    found = tuple(n for n in TABLES if os.path.exists(f"{args[0]}/{n}.parquet"))
    engine = Engine(spark, Catalog(spark).load_folder(args[0], found))
    for text in args[1:] or iter(lambda: input("> "), "exit"):
        print(answer(engine, text))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
