"""Token counts by a separator scan of flat token files.

``token_stream`` writes documents as flat streams of uint16 ids cut into blocks of a fixed
number of tokens; an end-of-document id closes each document and nothing else marks where
documents begin. ``count_tokens`` finds the separators of each block with one vectorised
comparison and reports the block's own documents; documents that cross blocks are stitched by
a prefix scan over one row a block (positions of the last separator so far), never over tokens.

Defined results
* null text is an empty document of 0 tokens; the separator itself is never counted.
* the tokenizer reads its special tokens as ordinary text, so no document can hold the separator.
* equal rows and null ids are counted one by one; empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, text_or_empty
from .tokens import coder

SEPARATOR = 49407
BLOCK_TOKENS = 1 << 16


def id_type(tokenizer: str, separator: int = SEPARATOR) -> str:
    """The type that ids of the vocabulary and the separator are stored as: two bytes where they suffice, else four."""
    return "<u2" if max(separator, coder(tokenizer, True).most) < 1 << 16 else "<u4"


def token_stream(docs: DataFrame, tokenizer: str, separator: int = SEPARATOR, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Rows of two kinds: blocks (stream, block, ids) and the order of documents (stream, ordinal, doc_id)."""
    schema = pa.schema([("stream", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("ordinal", pa.int64()), ("doc_id", pa.int64())])
    kind = id_type(tokenizer, separator)
    end = np.array([separator], dtype=kind).tobytes()
    width = np.dtype(kind).itemsize * block_tokens

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, block, ordinal, rest = coder(tokenizer, True), TaskContext.get().partitionId(), 0, 0, b""

        def rows(blocks: list[bytes], docs: list) -> pa.RecordBatch:
            nonlocal block, ordinal
            n, m = len(blocks), len(docs)
            columns = [[stream] * (n + m), [*range(block, block + n), *[None] * m], [*blocks, *[None] * m], [*[None] * n, *range(ordinal, ordinal + m)], [*[None] * n, *docs]]
            block, ordinal = block + n, ordinal + m
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                coded = encoder.ids(part.column(1).to_pylist())
                rest += b"".join(np.frombuffer(x, dtype="<u4").astype(kind).tobytes() + end for x in coded)
                whole = len(rest) // width * width
                blocks, rest = [rest[i : i + width] for i in range(0, whole, width)], rest[whole:]
                yield rows(blocks, part.column(0).to_pylist())
        if rest:
            yield rows([rest], [])

    chosen = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return chosen.mapInArrow(write, "stream int, block long, ids binary, ordinal long, doc_id long")


def scan_blocks(blocks: DataFrame, separator: int = SEPARATOR, kind: str = "<u2") -> DataFrame:
    """Per block: its tokens, the places of its first and last separator, and the lengths between separators."""
    fields = [("stream", pa.int32()), ("block", pa.int64()), ("n", pa.int64()), ("separators", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("between", pa.list_(pa.int64()))]
    schema = pa.schema(fields)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stream, block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                ids = np.frombuffer(data.as_buffer(), dtype=kind)
                at = np.flatnonzero(ids == separator)
                out.append((stream, block, len(ids), len(at), int(at[0]) if len(at) else None, int(at[-1]) if len(at) else None, np.diff(at) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    return blocks.select("stream", "block", "ids").mapInArrow(scan, "stream int, block long, n long, separators long, first long, last long, between array<long>")


def count_tokens(blocks: DataFrame, separator: int = SEPARATOR, kind: str = "<u2") -> DataFrame:
    """stream, ordinal (of the document in its stream), n_tokens."""
    before = W.partitionBy("stream").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    placed = scan_blocks(blocks, separator, kind).withColumn("at", zero(F.sum("n").over(before)))
    stitched = placed.select(
        "stream",
        zero(F.sum("separators").over(before)).alias("base"),
        (F.col("at") + F.col("first") - 1 - F.coalesce(F.max(F.col("at") + F.col("last")).over(before), F.lit(-1))).alias("head"),
        "between",
        "separators",
    ).filter("separators > 0")
    lengths = F.concat(F.array("head"), "between")
    return stitched.select("stream", "base", F.posexplode(lengths).alias("i", "n_tokens")).select("stream", (F.col("base") + F.col("i")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, stream, ordinal of every document, counted from the flat streams."""
    written = checkpointed(token_stream(docs, tokenizer, block_tokens=block_tokens))
    order = written.filter("block is null").select("stream", "ordinal", "doc_id")
    counted = count_tokens(written.filter("block is not null"), kind=id_type(tokenizer))
    return order.join(counted, ["stream", "ordinal"]).select("doc_id", "n_tokens", "stream", "ordinal")
