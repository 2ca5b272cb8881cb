"""Best-fit packing of token sequences by minimum bin slack.

A packing depends on the lengths alone, and there are at most ``capacity`` of them, however
many documents there are. So the lengths are counted by Spark, the bins are filled on that
bounded histogram (bitset subset sums find the fullest feasible combination for a bin, which
is removed as often as the counts allow), and each piece finds its place by its rank among the
pieces of its length. Ranks are dealt out by (length, hash bucket), with as many buckets as a
length's count asks for, so a length that holds a third of all pieces is ranked by many tasks.

Defined results
* null text is an empty document: its only token is the terminator.
* a piece of full length has a sequence of its own; equal rows each get a place.
* empty table: no rows. Null ids are kept. Other columns of the input are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, release, text_or_empty, trim
from .tokens import _CODERS, coder

CAPACITY = 2048
TERMINATOR = 0
#: Pieces of one length that one task ranks, about; the first ranks of all tasks are broadcast up to so many rows.
ROWS_A_TASK = 100_000
MOST_STARTS = 200_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, terminator: int = TERMINATOR) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = np.array([terminator], dtype="<u4").tobytes()
    width = capacity * 4

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(_CODERS)
        encoder = coder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            rows: list[tuple] = []
            for at in range(0, len(ids), 256):
                if at % 2048 == 0:
                    trim()
                for doc, data in zip(ids[at : at + 256], encoder.ids(texts.slice(at, 256).to_pylist())):
                    data += end
                    rows += [(doc, i, p // 4, min(width, len(data) - p) // 4, zlib.crc32(data[p : p + width])) for i, p in enumerate(range(0, len(data), width))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)
        trim()

    chosen = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return chosen.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def minimum_bin_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins as (times, {length: copies}); all copies of every length are used.

    Each bin starts from the longest length left. Lengths are then added to the bitset of
    reachable fills in descending order until the bin can be full; else the fullest fill wins.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    order = sorted(left, reverse=True)
    bins: list[tuple[int, dict[int, int]]] = []
    while left:
        order = [n for n in order if n in left]
        first, room = order[0], capacity - order[0]
        reach, full, steps = 1, 1 << room, []
        mask = (1 << (room + 1)) - 1
        for n in order:
            if n > room:
                continue
            spare, copies = min(left[n] - (n == first), room // n), 1
            while spare > 0 and not reach & full:
                copies = min(copies, spare)
                steps.append((n, copies, reach))
                reach = (reach | reach << (n * copies)) & mask
                spare, copies = spare - copies, copies * 2
            if reach & full:
                break
        fill, chosen = reach.bit_length() - 1, {first: 1}
        for n, copies, before in reversed(steps):
            if not before >> fill & 1:
                fill -= n * copies
                chosen[n] = chosen.get(n, 0) + copies
        times = min(left[n] // c for n, c in chosen.items())
        bins.append((times, chosen))
        for n, c in chosen.items():
            left[n] -= times * c
            if not left[n]:
                del left[n]
    return bins


def _places(bins: list[tuple[int, dict[int, int]]]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: first rank, copies in a bin, first sequence and offset of each run of bins that uses it."""
    runs: dict[int, list[tuple]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for times, chosen in bins:
        offset = 0
        for n, copies in chosen.items():
            runs.setdefault(n, []).append((used.get(n, 0), copies, sequence, offset))
            used[n] = used.get(n, 0) + times * copies
            offset += n * copies
        sequence += times
    return {n: tuple(np.array(c, dtype=np.int64) for c in zip(*r)) for n, r in runs.items()}


def ranked(df: DataFrame, by: str, counts: dict[int, int], ties: list[str], rows: int) -> DataFrame:
    """``rank``: 0.. within each value of ``by``, whose ``counts`` are known; a value is dealt over tasks of about ``rows`` each."""
    spark = df.sparkSession
    cuts = pa.table({by: pa.array(counts.keys(), pa.int64()), "__of": pa.array((-(-n // rows) for n in counts.values()), pa.int32())})  # as Arrow: a list would start Python workers of another kind on every executor
    few = F.broadcast if sum(cuts["__of"].to_pylist()) <= MOST_STARTS else (lambda side: side)
    dealt = df.join(F.broadcast(spark.createDataFrame(cuts)), by) if counts else df.withColumn("__of", F.lit(1))
    dealt = dealt.withColumn("__b", F.pmod(F.xxhash64(*ties), F.col("__of")).cast("int")).drop("__of")
    sizes = dealt.groupBy(by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select(F.col(by), F.col("__b"), (F.sum("__n").over(W.partitionBy(by).orderBy("__b")) - F.col("__n")).alias("__s"))
    inner = F.row_number().over(W.partitionBy(by, "__b").orderBy(*ties))
    return dealt.withColumn("__r", inner).join(few(starts), [by, "__b"]).withColumn("rank", F.col("__s") + F.col("__r") - 1).drop("__b", "__s", "__r")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, rows_a_task: int = ROWS_A_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    cut = checkpointed(pieces(docs, tokenizer, capacity))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = _places(minimum_bin_slack(counts, capacity))
    kinds = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    types = [pa.int64(), pa.int32(), *[pa.int64()] * 5]
    schema = pa.schema(list(zip(kinds, types)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "rank"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                first, copies, start, base = places[int(n)]
                run = np.searchsorted(first, rank[at], "right") - 1
                within = rank[at] - first[run]
                sequence[at] = start[run] + within // copies[run]
                offset[at] = base[run] + within % copies[run] * n
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kinds[:5]), pa.array(sequence), pa.array(offset)], schema=schema)

    order = ranked(cut, "length", counts, ["doc_id", "piece", "start", "ids_crc32"], rows_a_task)
    return order.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
