"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows stand in blocks (a hash of their identity). How many rows of each block go to each shard is
drawn exactly: a multivariate hypergeometric, drawn down a binary tree over the blocks, so every
level is one projection over the nodes of the level before. Rows are then permuted within their
block, dealt to the shards by the block's row of the matrix, and permuted again within the shard.
Counts decide the sizes, so shards differ by one row at most however keys or copies cluster.

Everything is built-in expressions. Blocks grow in number with the rows (``block_rows`` each) up to
``most_blocks``, so the matrix has at most most_blocks x shards cells and may be broadcast; the
second permutation ranks rows by (shard, hash range), never a shard in one task.

Defined results
* law ``rows``; null text has 8 bytes and the checksum of the empty text; ``grown_shard`` is null.
* the identity of a row is (doc_id, checksum, size); rows equal in all three are interchangeable.
* reruns agree, whatever the partitioning. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, let, text_or_empty

SHARDS = 24


def _hypergeometric(u: Column, taken: Column, good: Column, total: Column) -> Column:
    """Of ``taken`` draws without replacement from ``total`` of which ``good`` are good, the good ones: by inversion.

    Weights are relative to the mode and follow from the ratio of neighbours. They are summed outward from the
    mode over the range that holds all but 1e-16 of the mass, a dozen standard deviations.
    """
    n, k, m = taken.cast("double"), good.cast("double"), total.cast("double")
    low, high = F.greatest(F.lit(0.0), n + k - m), F.least(n, k)
    mode = F.greatest(low, F.least(high, F.floor((n + 1) * (k + 1) / (m + 2)).cast("double")))
    spread = F.ceil(12 * F.sqrt(F.greatest(n * (k / F.greatest(m, F.lit(1.0))) * (1 - k / F.greatest(m, F.lit(1.0))), F.lit(1.0)))) + 12
    up = lambda x: (k - x) * (n - x) / ((x + 1) * (m - k - n + x + 1))  # noqa: E731  weight of x + 1 over that of x
    down = lambda x: x * (m - k - n + x) / ((k - x + 1) * (n - x + 1))  # noqa: E731  weight of x - 1 over that of x

    def draw(v: Column) -> Column:
        first, last, top = v["first"], v["last"], v["mode"]
        steps = lambda a, b: F.when(b > a, F.sequence(F.lit(1), (b - a).cast("int"))).otherwise(F.array().cast("array<int>"))
        state = lambda x, w, s: F.struct(x.alias("x"), w.alias("w"), s.alias("s"))

        def walk(count: Column, ratio, step: int) -> Column:
            return F.aggregate(count, state(top, F.lit(1.0), F.lit(0.0)), lambda a, _: let(a["w"] * ratio(a["x"]), lambda w: state(a["x"] + step, w, a["s"] + w)))

        def invert(b: Column) -> Column:
            # From the lowest value upward: the first whose running sum exceeds u * total.
            goal = u * (1.0 + b["below"]["s"] + b["above"]["s"])
            start = F.struct(b["below"]["x"].alias("x"), b["below"]["w"].alias("w"), b["below"]["w"].alias("s"))
            found = F.aggregate(
                steps(first, last), start,
                lambda a, _: F.when(a["s"] > goal, a).otherwise(let(a["w"] * up(a["x"]), lambda w: state(a["x"] + 1, w, a["s"] + w))),
            )
            return found["x"]

        both = F.struct(walk(steps(first, top), down, -1).alias("below"), walk(steps(top, last), up, 1).alias("above"))
        return let(both, invert)

    bounds = F.struct(F.greatest(low, mode - spread).alias("first"), F.least(high, mode + spread).alias("last"), mode.alias("mode"))
    return F.when(high <= low, low).otherwise(let(bounds, draw)).cast("long")


def _uniform(*of: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*of), 12).cast("double") + 0.5) / F.lit(float(1 << 52))


def communication_matrix(blocks: DataFrame, n_blocks: int, shards: int, seed: int = 1) -> DataFrame:
    """``blocks`` has (block, n) for the blocks that have rows; gives (block, counts array of ``shards``).

    A node of the tree holds the row counts of its blocks and how many of its rows go to each shard.
    Its left half draws its own counts shard by shard; the right half gets the rest.
    """
    filled = F.array_sort(F.collect_list(F.struct("block", "n")))
    root = blocks.agg(filled.alias("p")).select(
        F.transform(F.sequence(F.lit(0), F.lit(n_blocks - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries(F.col("p")), i.cast("int")), F.lit(0)).cast("long")).alias("sizes")
    )
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    share = lambda t: F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.floor((t + shards - 1 - s) / shards).cast("long"))
    nodes = root.select(F.lit(0).alias("first"), "sizes", let(total, share).alias("counts"))
    width = n_blocks
    while width > 1:
        half = width // 2
        sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda x, y: x + y)

        def left(v: Column) -> Column:
            start = F.struct(v["n"].alias("n"), sum_of(v["counts"]).alias("m"), F.array().cast("array<long>").alias("out"))

            def one(a: Column, s: Column) -> Column:
                good = F.get(v["counts"], s)
                drawn = _hypergeometric(_uniform(F.lit(seed), v["first"], F.lit(half), s), a["n"], good, a["m"])
                return let(drawn, lambda x: F.struct((a["n"] - x).alias("n"), (a["m"] - good).alias("m"), F.concat(a["out"], F.array(x)).alias("out")))

            return F.aggregate(F.sequence(F.lit(0), F.lit(shards - 1)), start, one)["out"]

        inputs = F.struct(sum_of(F.slice("sizes", 1, half)).alias("n"), F.col("counts").alias("counts"), F.col("first").alias("first"))
        drawn = nodes.select("first", "sizes", "counts", let(inputs, left).alias("left"))
        halves = F.array(
            F.struct(F.col("first").alias("first"), F.slice("sizes", 1, half).alias("sizes"), F.col("left").alias("counts")),
            F.struct((F.col("first") + half).alias("first"), F.slice("sizes", half + 1, half).alias("sizes"), F.zip_with("counts", "left", lambda a, b: a - b).alias("counts")),
        )
        nodes = drawn.select(F.inline(halves))
        width = half
        if width == max(1, n_blocks // 32):
            nodes = nodes.repartition(32)  # the lower levels have the most draws
    return nodes.select(F.col("first").alias("block"), "counts")


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = 1, block_rows: int = 1_000_000, least_blocks: int = 32, most_blocks: int = 4096) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    slim = checkpointed(docs.select("doc_id", (F.octet_length(text_or_empty()) + 8).cast("long").alias("size"), F.crc32(text_or_empty()).alias("text_crc32")))
    rows = slim.count()
    n_blocks = 1 << max(int(math.log2(least_blocks)), min(int(math.log2(most_blocks)), math.ceil(math.log2(max(1, rows / block_rows)))))
    identity = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *identity)
    blocked = slim.withColumn("block", F.pmod(key(0), F.lit(n_blocks)).cast("int"))
    matrix = communication_matrix(blocked.groupBy("block").agg(F.count(F.lit(1)).alias("n")), n_blocks, shards, seed)
    ends = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda i: F.aggregate(F.slice("counts", 1, i), F.lit(0).cast("long"), lambda a, x: a + x))
    matrix = matrix.select("block", ends.alias("ends"))
    place = F.row_number().over(W.partitionBy("block").orderBy(key(1), *identity))
    dealt = blocked.withColumn("place", place).join(F.broadcast(matrix), "block")
    shard = F.size(F.filter("ends", lambda e: e < F.col("place")))
    # The second permutation: rows of a shard in the order of another hash, ranked range by range.
    ranges = F.shiftrightunsigned(key(2), 64 - int(math.log2(n_blocks))).cast("int")
    dealt = checkpointed(dealt.select("doc_id", "size", "text_crc32", shard.alias("shard"), ranges.alias("range")))
    sizes = dealt.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("shard", "range", (F.sum("n").over(W.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    within = F.row_number().over(W.partitionBy("shard", "range").orderBy(key(2), *identity))
    slot = (F.col("before") + F.col("within") - 1).alias("slot")
    ranked = dealt.withColumn("within", within).join(F.broadcast(starts), ["shard", "range"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", slot, F.lit(None).cast("int").alias("grown_shard"))
