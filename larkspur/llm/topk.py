"""Exact top-k inner-product search by a Voronoi join.

Vectors fall into cells by their nearest pivot. Each cell is summarised by its pivot, radius and
the distances of its nearest members. For a query q and a member x of the cell of pivot p,
q.p - |q||x - p| <= q.x <= q.p + |q||x - p|. The summaries give every query a score that k others
certainly reach, and its k-th score in the cell of its best pivot raises that; a query is sent only to
cells whose upper bound reaches it, and solved there by one matrix product. Cells are cut into blocks of bounded
size. Queries are counted by block: one that more than ``query_rows`` of them need is repeated for as many turns.

Of equal vectors, only k rows of an id, and of these only the 2 k of smallest ids, can be among anyone's
k best (ties go to the smaller id, and up to k of them may bear the query's own id), so longer runs of
copies are cut to these before the join, on the map side; all rows still query.

Defined results
* vectors that are null or hold null or non-finite components take no part, nor do rows of a null id or
  with a floor(64 x) beyond 64-bit integers; shorter vectors count as padded with zeros; scores are exact integers.
* fewer than k candidates: all of them. Empty table: no rows. Rows that share an id are one row
  each as candidates; a query excludes every row of its own id; query rows that share an id are answered together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed

K = 20
SCALE = 64
#: Blocks that many queries need are told to every executor up to so many, as counted.
BROADCAST_ROWS = 500_000


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the components as little-endian 64-bit integers; invalid vectors are left out."""
    schema = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if x.is_valid and x.values.null_count == 0:
                    values = np.floor(np.asarray(x.values, dtype=np.float64) * scale)
                    if (np.abs(values) < 2.0**63).all():  # neither true of what is not finite
                        ids.append(i)
                        out.append(values.astype("<i8").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], schema=schema)

    return vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(convert, "vec_id long, v binary")


def _matrix(column, width: int) -> np.ndarray:
    rows = column.to_pylist() if not isinstance(column, list) else column
    out = np.zeros((len(rows), width), dtype=np.int64)
    if rows and all(len(r) == 8 * width for r in rows):
        return np.frombuffer(b"".join(rows), dtype="<i8").reshape(len(rows), width).astype(np.int64)
    for i, r in enumerate(rows):
        x = np.frombuffer(r, dtype="<i8")
        out[i, : len(x)] = x
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T: in doubles where every partial sum is below 2**53, else in integers."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64) if most < 2**53 else a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray, k: int):
    """Row by row, the k best (score, then smaller id) that reach ``least`` and are not the query's own."""
    for q in range(len(scores)):
        row = scores[q]
        at = np.flatnonzero((row >= least[q]) & (ids != own[q]))
        if len(at) > 4 * k:
            at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
        at = at[np.lexsort((ids[at], -row[at]))[:k]]
        yield q, ids[at], row[at]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, cell_rows: int = 2048, most_pivots: int = 1024, block_rows: int = 8192, query_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of ``queries`` its k best rows of ``vectors``, itself left out.

    Both have vec_id and embedding. Pivots are at most ``most_pivots`` vectors, chosen by hash; with
    their summaries they are the only data that reach the driver.
    """
    same, copies = W.partitionBy("v", "vec_id").orderBy("vec_id"), W.partitionBy("v").orderBy("vec_id")
    data = quantised(vectors)
    for rows_of, most in ((same, k), (copies, 2 * k)):
        data = data.withColumn("copy", F.row_number().over(rows_of)).filter(F.col("copy") <= most).drop("copy")
    data = checkpointed(data)
    asked = quantised(queries)
    rows, width = data.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("v")), F.lit(0))).first()
    width = max(1, width // 8, (asked.agg(F.max(F.octet_length("v"))).first()[0] or 0) // 8)
    wanted = max(1, min(most_pivots, rows // cell_rows))
    pivots = _matrix([bytes(r["v"]) for r in data.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(wanted).collect()], width).astype(np.float64)
    if not len(pivots):
        return asked.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score"))

    celled_schema = pa.schema([("cell", pa.int32()), ("far", pa.float64()), ("vec_id", pa.int64()), ("v", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        norms = (pivots**2).sum(1)
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float64)
            cell = (norms - 2 * (x @ pivots.T)).argmin(1)
            far = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(far), batch.column(0), batch.column(1)], schema=celled_schema)

    celled = checkpointed(data.mapInArrow(assign, "cell int, far double, vec_id long, v binary"))
    nearest = W.partitionBy("cell").orderBy("far")
    sizes = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius")).collect()}  # a row a pivot
    # One member an id counts, over all cells: no more than one of those that a bound counts bears the query's own id.
    single = celled.groupBy("vec_id").agg(F.min(F.struct("far", "cell")).alias("m")).select("m.cell", "m.far")
    inner = single.withColumn("i", F.row_number().over(nearest)).filter(F.col("i") <= k + 1).groupBy("cell").agg(F.sort_array(F.collect_list("far")).alias("near"))
    near = {r["cell"]: r["near"] for r in inner.collect()}  # k + 1 numbers a pivot
    cells = sorted(sizes)
    centre, radius = pivots[cells], np.array([sizes[c]["radius"] for c in cells])
    close = np.full((len(cells), k + 1), np.inf)
    for i, c in enumerate(cells):
        close[i, : len(near.get(c, ()))] = near.get(c, ())
    blocks = np.array([-(-sizes[c]["n"] // block_rows) for c in cells])

    sent_schema = pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("query_id", pa.int64()), ("least", pa.int64()), ("q", pa.binary())])
    n_queries = asked.count()

    def replicate(own: pa.RecordBatch, q_at: np.ndarray, c_at: np.ndarray, bound: np.ndarray) -> pa.RecordBatch:
        """A row for each pair of a query and a block of a cell."""
        times = blocks[c_at]
        q_at, c_at = np.repeat(q_at, times), np.repeat(c_at, times)
        block = np.arange(len(q_at)) - np.repeat(np.cumsum(times) - times, times)
        ids = np.asarray(own.column(0))[q_at]
        least = np.maximum(np.floor(bound), -(2.0**62)).astype(np.int64)[q_at]
        columns = [pa.array(np.array(cells, dtype=np.int32)[c_at]), pa.array(block.astype(np.int32)), pa.array(ids), pa.array(least), own.column(1).take(pa.array(q_at))]
        return pa.RecordBatch.from_arrays(columns, schema=sent_schema)

    def bounds(own: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Upper bound of each query in each cell, and a score that k others certainly reach."""
        q = _matrix(own.column(1), width).astype(np.float64)
        length, middle = np.sqrt((q**2).sum(1)), q @ centre.T
        slack = 1e-9 * (np.abs(middle) + length[:, None] * (radius + 1)[None, :]) + 1e-3
        low = (middle[:, :, None] - length[:, None, None] * close[None, :, :]).reshape(len(q), -1)
        low[np.isnan(low)] = -np.inf
        sure = np.partition(low, low.shape[1] - k - 1, axis=1)[:, low.shape[1] - k - 1] if low.shape[1] >= k + 1 else np.full(len(q), -np.inf)
        return middle + length[:, None] * radius[None, :] + slack, sure - slack.max(1)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to the cell whose pivot it scores highest with."""
        for batch in batches:
            for at in range(0, len(batch), 512):
                own = batch.slice(at, 512)
                _, sure = bounds(own)
                best = (_matrix(own.column(1), width).astype(np.float64) @ centre.T).argmax(1)
                yield replicate(own, np.arange(len(own)), best, sure)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query to every cell that may hold one of its k best."""
        for batch in batches:
            for at in range(0, len(batch), 512):
                own = batch.slice(at, 512)
                high, sure = bounds(own)
                known = own.column(2).to_numpy(zero_copy_only=False).astype(np.float64)
                least = np.where(np.isnan(known), sure, np.maximum(sure, known))
                yield replicate(own, *np.nonzero(high >= least[:, None]), least)

    found_schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def solve(members: pa.Table, sent: pa.Table) -> pa.Table:
        out = [[], [], []]
        if len(members) and len(sent):
            ids, x = members["vec_id"].to_numpy(), _matrix(members["v"], width)
            for at in range(0, len(sent), 256):
                own = sent.slice(at, 256)
                names = own["query_id"].to_numpy()
                for q, found, scores in _best(products(_matrix(own["q"], width), x), ids, names, own["least"].to_numpy(), k):
                    for to, values in zip(out, (np.full(len(found), names[q]), found, scores)):
                        to.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else np.array([], np.int64)) for c in out], schema=found_schema)

    n_blocks = F.element_at(F.create_map(*(F.lit(int(v)) for pair in zip(cells, blocks) for v in pair)), F.col("cell"))
    members = celled.select("cell", F.pmod(F.xxhash64("vec_id", "v"), n_blocks).cast("int").alias("block"), "vec_id", "v")
    asked = checkpointed(asked.repartition(max(1, min(4 * data.sparkSession.sparkContext.defaultParallelism, n_queries // 256 + 1))))
    key, sent_ddl, found_ddl = ["cell", "block", "part"], "cell int, block int, query_id long, least long, q binary", "query_id long, vec_id long, score long"
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def turned(sent: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members and queries with ``part``: a block that too many queries need stands in several turns, each with its share of them."""
        sent = checkpointed(sent)
        load = sent.groupBy("cell", "block").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("turns")).filter("turns > 1")
        load = checkpointed(load)
        n = load.count()
        if not n:
            return members.withColumn("part", F.lit(0)), sent.withColumn("part", F.lit(0))
        load = F.broadcast(load) if n <= BROADCAST_ROWS else load
        turns = F.coalesce("turns", F.lit(1))
        own = members.join(load, ["cell", "block"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), turns - 1))).drop("turns")
        return own, sent.join(load, ["cell", "block"], "left").withColumn("part", F.pmod(F.xxhash64("query_id", "q"), turns).cast("int")).drop("turns")

    def best(sent: DataFrame) -> DataFrame:
        own, sent = turned(sent)
        found = own.groupBy(*key).cogroup(sent.groupBy(*key)).applyInArrow(solve, found_ddl)
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    # The k-th score at home is one that k others reach: it bounds what is sent elsewhere and what comes back.
    kth = best(asked.mapInArrow(home, sent_ddl)).filter(F.col("rank") == k).select(F.col("query_id").alias("__id"), F.col("score").alias("known"))
    known = asked.join(kth, F.col("vec_id") == F.col("__id"), "left").select("vec_id", "v", "known")
    return best(known.mapInArrow(send, sent_ddl)).select("query_id", "rank", "vec_id", "score")
