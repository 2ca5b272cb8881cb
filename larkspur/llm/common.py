"""What the corpus operators share: checkpoints, word rules, null-safe text, sizes of partitions."""

from __future__ import annotations

import ctypes
import tempfile
import threading
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words: space and U+0009 to U+000D.
WHITESPACE = " \t\n\x0b\f\r"
#: Java regular expression of one run of it.
WHITESPACE_RUN = r"[ \t\n\x0B\f\r]+"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The folder is the session's ``spark.checkpoint.dir``; only where that is unset and the
    master is local (tests on one machine) a temporary folder is set. Spark's cleaner removes the files once the
    returned DataFrame and its descendants are garbage.
    """
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="larkspur-"))
    return df.checkpoint(eager=True)


def trim() -> None:
    """Give the memory that this worker has freed back to the system: workers wait, idle, beside later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_RESTING = threading.Lock()
#: Seconds after which a task's last tables are gone.
REST = 0.5


def rest() -> None:
    """``trim`` now, and once more when the task has let go of its last tables, which outlive its function.

    Arrow takes memory from the C library from here on: its own pool gives back only what the calling thread has freed."""
    pa.set_memory_pool(pa.system_memory_pool())
    trim()
    if _RESTING.acquire(blocking=False):

        def again() -> None:
            _RESTING.release()
            trim()

        timer = threading.Timer(REST, again)
        timer.daemon = True
        timer.start()


_KEPT: list[dict] = []


def kept() -> dict:
    """A dictionary of a module's own that lives as long as the worker, or until another operator's task calls ``release``."""
    _KEPT.append({})
    return _KEPT[-1]


def release(own: dict | None = None) -> None:
    """Drop what operators before this one keep in the worker (it is made again when asked for), all but ``own``, and give the memory back."""
    for other in _KEPT:
        if other is not own:
            other.clear()
    trim()


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` over batches, which releases what others keep before it starts and lets its worker rest when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        yield from work(batches)
        rest()

    return run


def fresh(df: DataFrame, base: str) -> str:
    """A column name like ``base`` that ``df`` does not have."""
    have, name = {c.lower() for c in df.columns}, f"_{base}"
    while name in have:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """Array of the maximal runs without white space; empty for an empty text."""
    trimmed = F.btrim(text, F.lit(WHITESPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WHITESPACE_RUN, -1))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, whatever the number of its uses."""
    return F.element_at(F.transform(F.array(value), body), 1)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_parts(docs: DataFrame, each: int = 32 << 20) -> int:
    """Partitions in which a task holds about ``each`` bytes of text: one scan sums them, no fewer than Spark's setting."""
    total = docs.agg(F.sum(F.octet_length(text_or_empty()))).first()[0] or 0
    return max(parts(docs.sparkSession), -(-total // each))
