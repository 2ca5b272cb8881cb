"""Mixing sources to target weights by Pareto order sampling, in built-in expressions only.

Sources get shares of the budget by weight; a source's share stops at ``most_copies`` times its
size and the excess is dealt again, which has a closed form over the sources sorted by
size / weight. A source's target is met by whole copies of every document (all certain) plus a
sample: document i is included with a probability p_i that grows with its size up to 1, ranked by
the random odds u/(1-u) divided by its inclusion odds p/(1-p), and taken from the smallest on while the
target holds; one further document, of the size nearest to what is missing then, may close the gap.

No task sees a source as a whole. Sizes are counted by (source, size) for the probabilities, and
words by (source, rank bucket) for the cut; only the one bucket that holds the cut is sorted.

Defined results
* null text has size 0: no words to take, ``taken`` is 0. Null source is a source, listed last.
* random numbers come from a hash of doc_id, seed and, for rows that share an id, the text:
  reruns agree whatever the partitioning. Rows equal in all of these are taken alike in rank order.
* a source without words has target 0. Empty table: no rows. Other columns are not read unless kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, fresh, text_or_empty, words_of

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST_COPIES = 2
RANK_BUCKETS = 4096
#: The rows that a source has in a plan go to every executor for at most so many sources, as counted; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most_copies: int = MOST_COPIES) -> DataFrame:
    """``sizes`` has a row for each source (source, source_size); adds ``target``.

    With the sources sorted by cap / weight, those before some place stop at their caps and the
    rest share what is left by weight: the first place whose level is not above its own cap / weight.
    One row a source: the windows over all sources see that small table only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.select(
        "source",
        "source_size",
        F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("weight"),
        (F.col("source_size") * most_copies).cast("double").alias("cap"),
    )
    full = W.partitionBy()
    by_ratio = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(full) * budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    levelled = weighted.withColumn("level", level)
    # The first source that its level leaves under its cap fixes the level of all after it.
    fixed = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), F.col("level")).alias("x"))).over(full)
    return levelled.withColumn("__f", fixed).select(
        "source", "source_size", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("__f")["level"], F.col("cap")))).alias("target")
    )


def _uniform(seed: int) -> Column:
    """A double in (0, 1) from 52 bits of a hash of the row's identity."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("__crc")), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most_copies: int = MOST_COPIES, seed: int = 7, buckets: int = RANK_BUCKETS) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies (whole copies of the document in the mix), source."""
    sized = checkpointed(docs.select(F.col("doc_id"), F.col("source"), F.size(words_of(text_or_empty())).cast("long").alias("size"), F.crc32(text_or_empty()).alias("__crc")))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))

    by_size = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goals = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, budget, most_copies)
    goals = goals.select(
        F.col("source").alias("__source"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("whole"),
    ).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    goals = checkpointed(goals)
    each = F.broadcast if goals.count() <= BROADCAST_SOURCES else (lambda df: df)  # of sides with a row a source

    # p = min(1, c * size) with sum(p * size) = rest: the sizes above some size are certain (p = 1), and c follows
    # from the rest. The largest size that need not be certain, with its own c, fixes c. One row a (source, size).
    larger = W.partitionBy("source").orderBy(F.col("size").desc())
    above = larger.rowsBetween(W.unboundedPreceding, -1)
    here = larger.rowsBetween(0, W.unboundedFollowing)
    square = (F.col("size") * F.col("size") * F.col("n")).cast("double")
    rates = (
        by_size.filter("size > 0")
        .join(each(goals.select("__source", "rest")), same("source", "__source"))
        .select("source", "size", ((F.col("rest") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(above), F.lit(0))) / F.sum(square).over(here)).alias("c"))
        .groupBy("source")
        .agg(F.max(F.when(F.col("c") * F.col("size") <= 1, F.struct("size", "c"))).alias("x"))
        .select(F.col("source").alias("__of"), F.greatest(F.col("x.c"), F.lit(0.0)).alias("c"))
    )
    plan = goals.join(rates, F.col("__source").eqNullSafe(F.col("__of")), "left").drop("__of")

    # Pareto rank z = (u/(1-u)) / (p/(1-p)); z/(1+z) keeps its order within [0, 1]: 0 for the certain, 1 for p = 0.
    u = _uniform(seed)
    p = F.least(F.coalesce(F.col("c"), F.lit(0.0)) * F.col("size"), F.lit(1.0))
    rank = u * (1 - p) / (u * (1 - p) + (1 - u) * p)
    ranked = sized.join(each(plan), same("source", "__source")).withColumn("rank", F.when(F.col("size") > 0, rank))
    bucket = F.least(F.floor(F.col("rank") * buckets), F.lit(buckets - 1)).cast("int")
    ranked = checkpointed(ranked.select("doc_id", "source", "size", "__crc", "source_size", "target", "whole", "rest", "rank", bucket.alias("bucket")))

    # Words by (source, bucket): the bucket in which the running sum reaches the rest is the only one to be ordered.
    filled = ranked.filter("bucket is not null").groupBy("source", "bucket", "rest").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    cut = filled.withColumn("upto", running).filter("upto >= rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("words")).alias("before"))).alias("x"))
    cut = cut.select(F.col("source").alias("__source"), F.col("x.bucket").alias("cut"), F.col("x.before").alias("before"))
    ranked = ranked.join(each(cut), same("source", "__source"), "left")

    inside = F.col("bucket") == F.col("cut")
    order = W.partitionBy("source").orderBy("rank", "doc_id", "__crc")
    running = F.col("before") + F.sum("size").over(order)
    split = ranked.filter(inside).withColumn("sampled", F.coalesce(running <= F.col("rest"), F.lit(False)))
    outside = ranked.filter(~F.coalesce(inside, F.lit(False))).withColumn("sampled", F.coalesce((F.col("bucket") < F.col("cut")) | (F.col("cut").isNull() & (F.col("rest") > 0) & F.col("bucket").isNotNull()), F.lit(False)))
    decided = checkpointed(outside.unionByName(split).select("doc_id", "source", "size", "__crc", "source_size", "target", "whole", "rest", "rank", "sampled"))

    # The sample ends below the rest; the one document left whose size is nearest to what is missing closes the gap, if it does.
    gaps = decided.groupBy("source").agg((F.max("rest") - F.sum(F.when(F.col("sampled"), F.col("size")).otherwise(0))).alias("gap")).filter("gap > 0")
    gaps = gaps.select(F.col("source").alias("__source"), "gap")
    identity = F.struct("rank", "doc_id", "__crc", "size")
    miss = F.abs(F.col("size") - F.col("gap"))
    spare = decided.filter("not sampled and size > 0 and rest > 0").join(each(gaps), same("source", "__source")).filter(miss < F.col("gap"))
    last = spare.groupBy("source").agg(F.min(F.struct(miss.alias("miss"), identity.alias("row"))).alias("x")).select(F.col("source").alias("__source"), F.col("x.row").alias("last"))
    closing = F.coalesce(~F.col("sampled") & identity.eqNullSafe(F.col("last")), F.lit(False))
    copies = F.col("whole") + (F.col("sampled") | closing).cast("long")
    out = decided.join(each(last), same("source", "__source"), "left")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source")


def repeat(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every column of ``docs``, each document as often as ``mix`` takes it.

    Rows that share an id, size and source share their copies: as evenly as they divide, and no more than they are."""
    id_, words, source, copies, rows, place = (fresh(docs, c) for c in ("id", "words", "from", "copies", "rows", "place"))
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias(id_), F.col("size").alias(words), F.col("source").alias(source))
    taken = checkpointed(taken.agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).filter(F.col(copies) > 0))
    size = F.size(words_of(text_or_empty())).cast("long")
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (size == F.col(words)) & F.col("source").eqNullSafe(F.col(source))
    joined = docs.join(taken, same)
    uneven = F.col(copies) % F.col(rows) != 0
    out = joined.filter(~uneven).withColumn(copies, F.col(copies) / F.col(rows))
    if taken.filter(uneven).count():
        # The first rows of a group take one copy more. A group is counted by partition, so none is gathered in one task.
        part, before, key = fresh(docs, "part"), fresh(docs, "before"), [F.coalesce(F.col(id_).cast("string"), F.lit("")), F.col(id_).isNull(), F.col(words), F.coalesce(F.col(source), F.lit("")), F.col(source).isNull()]
        names = [fresh(docs, f"key{i}") for i in range(len(key))]
        odd = joined.filter(uneven)
        for name, k in zip(names, key):
            odd = odd.withColumn(name, k)
        odd = checkpointed(odd.withColumn(part, F.spark_partition_id()))
        starts = odd.groupBy(*names, part).agg(F.count(F.lit(1)).alias(before))
        starts = starts.withColumn(before, F.sum(before).over(W.partitionBy(*names).orderBy(part)) - F.col(before))
        odd = odd.withColumn(place, F.row_number().over(W.partitionBy(*names, part).orderBy(*names))).join(starts, [*names, part])
        more = (F.col(before) + F.col(place) <= F.col(copies) % F.col(rows)).cast("long")
        odd = odd.withColumn(copies, F.floor(F.col(copies) / F.col(rows)) + more).filter(F.col(copies) > 0)
        out = out.unionByName(odd.select(*out.columns))
    return out.withColumn(place, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*[F.col(c) for c in docs.columns])
