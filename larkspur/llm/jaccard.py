"""Exact n-gram Jaccard self-join by a token-group matrix, reported as components of links.

Two documents that link share at least k tokens of their prefixes (the first n - a + k tokens in one
global order that puts frequent tokens last, a = least overlap, k = ``MATCHES`` and one more for every
``SIZE_A_MATCH`` shingles of the smaller). Documents of equal sets are one representative; then

1. similar documents are gathered: a document that has k prefix tokens which others have, too, joins the
   group of the one that most documents have, and a group of more than ``BLOCK_SHINGLES`` shingles is cut
   into several that have one pivot in common. A group's members are compared with each other where they
   meet, and the group's token union is stored, packed;
2. the rows of the token-group matrix for prefix tokens tell which other groups a document shares
   k of them with: those it asks. Of two groups the smaller one's documents ask, and of two
   that have their largest component in common, the documents outside it, each group's the other's;
3. an asking document's packed shingles meet the group's stored union: that bounds the overlap with every
   member. No member is read for it;
4. only the groups that qualify are opened: their members are compared exactly with those who ask.

A question is one of a document against a whole group, so a cluster makes rows in proportion to its
documents times the few groups it was cut into, never pairs. A group of any size is many tasks: its blocks,
and for each block turns of at most ``QUERIES`` documents that ask. The frequencies (of at most
``most_frequent`` tokens, counted over all documents) guide the order only, and so the cost: any order
gives the same links.

Defined results
* null or empty text, or white space alone: no shingles, linked with nothing, its own component.
* rows that share an id are one document with several texts; a null id links with nothing (component null).
* equal rows and ties are links like any other; empty table: no rows. Other columns are not read.
* shingles are 64-bit hashes, sets 128-bit ones; different ones coincide with probability about 2**-64 a pair.
* components are reported, not the number of links: inside a group most pairs of one component are never compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, let, parts, text_or_empty, trimmed
from .graph import components
from .shingles import shingle_sets

MATCHES = 3
#: So many shingles of a document ask for one more shared token, which documents that have a passage in common do not reach.
SIZE_A_MATCH = 16
PIVOTS = 6
BLOCK_SHINGLES = 500_000
QUERIES = 2_000
#: A side of at most so many bytes, counted, is broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 16 << 20
_WIDTHS = {"bigint": 8, "int": 8, "boolean": 8, "binary": 24}


def _small(df: DataFrame) -> DataFrame:
    """``df`` (already materialised, of narrow columns), marked for broadcast if it was counted to be small."""
    width = 16 + sum(_WIDTHS[kind] for _, kind in df.dtypes)
    return F.broadcast(df) if df.count() * width <= BROADCAST_BYTES else df


def _texts(batch: pa.RecordBatch, name: str, at: int, step: int) -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).slice(at, step).to_pylist()]


def _raw(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"))


def frequent_tokens(docs: DataFrame, n: int, most: int, local: int = 4, flush: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of most documents, by value, with their document counts: at most ``most``, over all documents."""
    schema = pa.schema([("token", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            tokens = np.concatenate(held) if held else np.array([], np.uint64)
            tokens.sort()
            start = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1]))) if len(tokens) else np.array([], np.int64)
            times = np.diff(np.append(start, len(tokens)))
            often = times >= local
            return pa.RecordBatch.from_arrays([pa.array(tokens[start[often]].view(np.int64)), pa.array(times[often])], schema=schema)

        for batch in batches:
            for at in range(0, len(batch), 500):
                for s in shingle_sets(_texts(batch, "text", at, 500), n):
                    held.append(s)
                    size += len(s)
                if size > flush:
                    yield counted()
                    held, size = [], 0
        yield counted()

    rows = _raw(docs).mapInArrow(trimmed(count), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.col("n").desc(), "token").limit(most).toArrow()
    tokens, times = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(tokens)
    return tokens[order], times[order]


def least_overlap(n: int, num: int, den: int) -> int:
    return -(-num * n // den)


def smallest_linkable(num: int, den: int) -> int:
    """The fewest shingles with which a document can link with a different set."""
    return -(-num // (den - num)) if den > num else 1 << 62


def _fingerprint(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def shared_least(n: int, num: int, den: int, matches: int) -> int:
    """The tokens that the prefixes of a document of ``n`` shingles and a linked one of as many or more surely share."""
    return min(least_overlap(n, num, den), matches + n // SIZE_A_MATCH)


def _shared_least(n: Column, num: int, den: int, matches: int) -> Column:
    """The least of ``shared_least`` over all sizes that a partner of ``n`` shingles may have."""
    overlap = lambda x: F.call_function("div", x * num + (den - 1), F.lit(den))
    return let(overlap(n), lambda m: F.least(overlap(m), F.lit(matches) + F.call_function("div", m, F.lit(SIZE_A_MATCH))))


def sketches(docs: DataFrame, n: int, num: int, den: int, frequent: tuple[np.ndarray, np.ndarray], matches: int) -> DataFrame:
    """doc_id, n, fp (128 bits of the set), and the prefix: rare tokens, frequent ones and their counts (empty if no different set can link)."""
    tokens, times = frequent
    least = smallest_linkable(num, den)
    none, zero = np.array([], np.uint64), np.array([], np.int64)

    def prefix(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = len(s)
        if size < least:
            return none, none, zero
        rank = np.zeros(size, dtype=np.int64)
        if len(tokens):
            at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
            rank = np.where(tokens[at] == s, times[at], 0)
        order = np.argsort(rank, kind="stable")[: size - least_overlap(size, num, den) + shared_least(size, num, den, matches)]
        rare = np.count_nonzero(rank[order] == 0)
        return s[order[:rare]], s[order[rare:]], rank[order[rare:]]

    def listed(arrays: list[np.ndarray], of: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]).astype(np.int32)), pa.array(np.concatenate([of, *arrays]).view(np.int64)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                sizes, prints, prefixes = [], [], []
                for s in shingle_sets(_texts(batch, "text", at, 1000), n):
                    sizes.append(len(s))
                    prints.append(_fingerprint(s))
                    prefixes.append(prefix(s))
                lists = [listed(list(x), of) for x, of in zip(zip(*prefixes), (none, none, zero))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1000), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), *lists], names=["doc_id", "n", "fp", "rare", "hot", "times"])

    return _raw(docs).mapInArrow(trimmed(sketch), "doc_id long, n long, fp binary, rare array<long>, hot array<long>, times array<long>")


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key each, from batches sorted by key."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        columns = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
        change = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1 if len(batch) > 1 else np.array([], dtype=np.int64)
        bounds = [0, *change.tolist(), len(batch)]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


class _Block:
    """Sets of a block of documents, laid out for counting overlaps with one set at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        flat = np.concatenate(sets) if sets else np.array([], np.uint64)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], np.repeat(np.arange(len(sets)), self.sizes)[order]

    def overlaps(self, s: np.ndarray) -> np.ndarray:
        """Overlap of every member with ``s``; by postings, in time of the matches."""
        low, high = np.searchsorted(self.flat, s, "left"), np.searchsorted(self.flat, s, "right")
        hit = high > low
        low, count = low[hit], (high - low)[hit]
        if not len(low):
            return np.zeros(len(self.sizes), dtype=np.int64)
        at = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        return np.bincount(self.owner[at], minlength=len(self.sizes))

    def linked(self, s: np.ndarray, num: int, den: int) -> np.ndarray:
        both = self.overlaps(s)
        return np.flatnonzero(den * both >= num * (self.sizes + len(s) - both))

    def union(self) -> np.ndarray:
        return self.flat[np.concatenate(([True], self.flat[1:] != self.flat[:-1]))] if len(self.flat) else self.flat


def _sets(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint64) for x in column.to_pylist()]


def block_components(block: _Block, sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """The component of every member, as the place of its first one.

    A few pivots gather most members; then all outside the largest component are compared with the whole
    block. A link that stays unseen has both its ends in that component."""
    root = np.arange(len(sets))

    def ask(i: int) -> None:
        touched = np.unique(root[np.append(block.linked(sets[i], num, den), i)])
        if len(touched) > 1:
            root[np.isin(root, touched)] = touched[0]

    asked = np.zeros(len(sets), dtype=bool)
    for _ in range(min(PIVOTS, len(sets))):
        sizes = np.bincount(root, minlength=len(sets))
        pivot = int(np.argmin(sizes[root] + np.where(asked, len(sets) + 1, 0)))
        ask(pivot)
        asked[pivot] = True
    largest = np.argmax(np.bincount(root, minlength=len(sets)))
    for i in np.flatnonzero((root != largest) & ~asked):
        ask(int(i))
    return root


_INSIDE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("grp", pa.int64()), ("tokens", pa.binary())])


def _inside_groups(members: DataFrame, num: int, den: int) -> DataFrame:
    """Of every group: a star (a < b) of each component of its members, and a row with its token union."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for group in _runs(batches, ["grp"]):
            ids, sets = group["doc_id"].to_numpy(), _sets(group["tokens"])
            block = _Block(sets)
            root = block_components(block, sets, num, den)
            order = np.lexsort((ids, root))
            least = ids[order][np.searchsorted(root[order], root)]
            rows += [(int(a), int(b), None, None) for a, b in zip(least[least != ids], ids[least != ids])]
            rows.append((None, None, int(group["grp"][0].as_py()), block.union().tobytes()))
            if len(rows) > 2_000 or len(rows[-1][3]) > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INSIDE.types)], schema=_INSIDE)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _INSIDE.types)], schema=_INSIDE)

    placed = members.select("grp", "doc_id", "tokens").repartition(parts(members.sparkSession), "grp").sortWithinPartitions("grp")
    return placed.mapInArrow(trimmed(compare), "a long, b long, grp long, tokens binary")


def _turns(load: DataFrame) -> DataFrame:
    """grp and every turn of the documents that ask it; ``load``: fp, grp."""
    return load.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("turns"))


def _asking(load: DataFrame, turns: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of the documents that ask: grp, turn, own (false), fp, class, tokens."""
    load = load.join(turns, "grp").select("fp", "grp", F.pmod(F.xxhash64("fp"), F.col("turns")).cast("int").alias("turn"))
    return sets.select("fp", "class", "tokens").join(_small(checkpointed(load)), "fp").select("grp", "turn", F.lit(False).alias("own"), "fp", "class", "tokens")


def _met(own: DataFrame, turns: DataFrame, asking: DataFrame) -> DataFrame:
    """Each turn of a group: the group's own rows, then those who ask."""
    own = own.join(turns, "grp").select("grp", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(True).alias("own"), "fp", "class", "tokens")
    return own.unionByName(asking).repartition(parts(own.sparkSession), "grp", "turn").sortWithinPartitions("grp", "turn", F.col("own").desc())


def _qualifying(asked: DataFrame, unions: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``asked`` (fp, grp) whose overlap with the group's union may suffice."""
    schema = pa.schema([("fp", pa.binary()), ("grp", pa.int64())])

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn in _runs(batches, ["grp", "turn"]):
            union, *asking = _sets(turn["tokens"])
            kept = []
            for i, s in enumerate(asking, 1):
                at = np.minimum(np.searchsorted(union, s), len(union) - 1)
                if np.count_nonzero(union[at] == s) >= least_overlap(len(s), num, den):
                    kept.append(i)
            yield turn.select(["fp", "grp"]).take(kept).combine_chunks().cast(schema).to_batches()[0] if kept else pa.RecordBatch.from_pylist([], schema=schema)

    turns = checkpointed(_turns(asked))
    own = unions.withColumn("fp", F.lit(None).cast("binary")).withColumn("class", F.lit(None).cast("long"))
    return _met(own, _small(turns), _asking(asked, turns, sets)).mapInArrow(trimmed(bound), "fp binary, grp long")


def _opened(passed: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between components, from the exact comparison of documents (fp) with members of other groups (grp)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn in _runs(batches, ["grp", "turn"]):
            own, classes, sets = turn["own"].to_numpy(zero_copy_only=False), turn["class"].to_numpy(), _sets(turn["tokens"])
            inner = np.flatnonzero(own)
            block = _Block([sets[i] for i in inner])
            pairs = {(int(classes[i]), int(c)) for i in np.flatnonzero(~own) for c in np.unique(classes[inner[block.linked(sets[i], num, den)]])}
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

    turns = checkpointed(_turns(passed))
    return _met(sets, _small(turns), _asking(passed, turns, sets)).mapInArrow(trimmed(solve), "a long, b long").filter("a <> b").distinct()


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, most_frequent: int = 100_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row; documents link when den * overlap >= num * union."""
    matches = MATCHES if least_overlap(smallest_linkable(num, den), num, den) >= MATCHES else 1
    all_docs = checkpointed(sketches(docs, n, num, den, frequent_tokens(docs, n, most_frequent), matches))
    known = all_docs.filter("n > 0 and doc_id is not null")
    reps = checkpointed(known.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")))

    # Prefix tokens that others share, of the documents that have enough of them. Frequent ones are taken to be shared.
    copied = _small(checkpointed(reps.filter("rows > 1").select("fp", "rep")))
    lists = known.filter(F.size("rare") + F.size("hot") > 0).join(copied, "fp", "left")
    lists = lists.filter("rep is null").unionByName(lists.filter("rep = doc_id").dropDuplicates(["fp"])).select("doc_id", "rare", "hot", "times")
    rare = lists.select("doc_id", F.explode("rare").alias("token")).withColumn("times", F.count(F.lit(1)).over(Window.partitionBy("token"))).filter("times > 1")
    hot = lists.select("doc_id", F.explode(F.arrays_zip("hot", "times")).alias("x")).select("doc_id", F.col("x.hot").alias("token"), F.col("x.times").alias("times"))
    sizes = known.groupBy("doc_id").agg(F.min("n").alias("n"))
    need = _shared_least(F.col("n"), num, den, matches)
    own = Window.partitionBy("doc_id")
    held = rare.unionByName(hot).join(sizes, "doc_id").withColumn("held", F.count(F.lit(1)).over(own)).withColumn("family", F.max(F.struct("times", "token")).over(own)["token"])
    held = checkpointed(held.filter(F.col("held") >= need).select("token", "doc_id", "family"))

    # Groups: by the most shared token of a document, cut into blocks.
    family = held.select("doc_id", "family").distinct()
    of = checkpointed(family.join(reps.withColumnRenamed("rep", "doc_id"), "doc_id").select("fp", "doc_id", "n", "rows", "family"))
    cut = of.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"), F.min(F.struct("doc_id", "fp"))["fp"].alias("pivot"))
    group = lambda block: F.when(F.col("blocks") == 1, F.col("family")).otherwise(F.xxhash64("family", block)).alias("grp")
    own_block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    placed = of.join(cut, "family").select("fp", "doc_id", "n", "rows", group(own_block), (F.col("fp") == F.col("pivot")).alias("first"), "family", "blocks")
    placed = checkpointed(placed)

    # The sets of those documents, and their comparison inside the groups.
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                prints = batch.column(1).slice(at, 500).to_pylist()
                found = list(shingle_sets(_texts(batch, "text", at, 500), n))
                mine = [i for i, s in enumerate(found) if _fingerprint(s) == prints[i]]  # an id may have several texts
                yield pa.RecordBatch.from_arrays([pa.array([prints[i] for i in mine], pa.binary()), batch.column(0).slice(at, 500).take(pa.array(mine, pa.int64())), pa.array([found[i].tobytes() for i in mine], pa.binary())], names=["fp", "grp", "tokens"])

    def texts_of(where: DataFrame) -> DataFrame:
        return _raw(docs).join(_small(checkpointed(where.select("doc_id", "fp", "grp"))), "doc_id").select("grp", "fp", "text").mapInArrow(trimmed(packed), "fp binary, grp long, tokens binary")

    repeated = texts_of(placed.filter("rows > 1")).groupBy("fp").agg(F.first("grp").alias("grp"), F.first("tokens").alias("tokens"))
    sets = checkpointed(texts_of(placed.filter("rows = 1")).unionByName(repeated))
    home = sets.join(_small(placed.select("fp", "doc_id")), "fp")
    guests = placed.filter("first and blocks > 1").select("fp", "doc_id", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: group(b))).alias("to"), "grp").filter("to <> grp")
    guests = home.select("fp", "doc_id", "tokens").join(_small(checkpointed(guests.select("fp", F.col("to").alias("grp")))), "fp")
    inside = checkpointed(_inside_groups(home.select("grp", "doc_id", "tokens").unionByName(guests.select("grp", "doc_id", "tokens")), num, den))
    near = components(inside.filter("a is not null").select("a", "b"))

    # The matrix: who asks which other group.
    classed = placed.select("fp", "doc_id", "n", "grp").join(near.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("fp", "doc_id", need.alias("need"), "grp", F.coalesce("component", "doc_id").alias("class"))
    classed = checkpointed(classed)
    counts = classed.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("size"))
    mains = counts.groupBy("grp").agg(F.max(F.struct("size", "class"))["class"].alias("main"), F.sum("size").alias("size"))
    seat = checkpointed(classed.join(mains, "grp").select("fp", "doc_id", "need", "grp", "class", "main", "size"))
    rows = held.select("token", "doc_id").join(_small(seat), "doc_id")
    contested = rows.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).filter("lo < hi").select("token")
    rows = checkpointed(rows.join(_small(checkpointed(contested)), "token"))
    columns = rows.groupBy("token", "grp").agg(F.first("main").alias("other_main"), F.first("size").alias("other_size")).withColumnRenamed("grp", "other")
    same = F.col("main") == F.col("other_main")
    asks = F.when(same, F.col("class") != F.col("main")).otherwise(F.struct("other_size", "other") > F.struct("size", "grp"))
    joined = rows.alias("r").join(columns.alias("c"), (F.col("r.token") == F.col("c.token")) & (F.col("other") != F.col("grp")) & asks)
    asked = checkpointed(joined.groupBy("fp", F.col("other").alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.first("need").alias("need")).filter("n >= need").select("fp", "grp"))

    classy = sets.join(_small(classed.select("fp", "class")), "fp")
    passed = checkpointed(_qualifying(asked, inside.filter("grp is not null").select("grp", "tokens"), classy, num, den))
    far = checkpointed(_opened(passed, classy, num, den))

    # An id with several texts ties them together.
    several = known.groupBy("doc_id").agg(F.min(F.xxhash64("fp")).alias("lo"), F.max(F.xxhash64("fp")).alias("hi")).filter("lo < hi").select("doc_id")
    tied = known.select("doc_id", "fp").join(_small(checkpointed(several)), "doc_id").join(reps, "fp").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    every = components(far.unionByName(near.select(F.col("node").alias("a"), F.col("component").alias("b"))).unionByName(tied))
    classes = reps.join(_small(checkpointed(every.withColumnRenamed("node", "rep"))), "rep", "left").filter("rows > 1 or component is not null")
    classes = checkpointed(classes.select("fp", F.coalesce("component", "rep").alias("class")))
    out = all_docs.select("doc_id", "n", "fp").join(_small(classes), "fp", "left")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.coalesce("class", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One row of each component, that of the smallest id (null last); every column of ``docs``. Texts without words all stay.

    Rows are told apart by a 64-bit hash of id and text, so rows that share an id are decided one by one."""
    row, name = F.xxhash64("doc_id", text_or_empty()), fresh(docs, "row")
    found = jaccard_components(docs.select(row.alias("doc_id"), "text"), **options).filter("n_shingles > 0")
    found = checkpointed(found.groupBy(F.col("doc_id").alias("row"), "component_id").agg(F.count(F.lit(1)).alias("rows")))
    single = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("size")).filter("size > 1").select("component_id")
    several = checkpointed(found.join(_small(checkpointed(single)), "component_id").select("row", "component_id"))
    ids = docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id")).join(_small(several), "row").groupBy("row", "component_id").agg(F.first("doc_id").alias("doc_id"))
    ids = checkpointed(ids)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = ids.groupBy("component_id").agg(F.min(order)["row"].alias("kept"))
    gone = checkpointed(ids.join(kept, "component_id").filter("row <> kept").select(F.col("row").alias(name)))
    left = docs.withColumn(name, row).join(_small(gone), name, "left_anti")
    repeated = _small(checkpointed(found.filter("rows > 1").select(F.col("row").alias(name))))
    place, columns = fresh(docs, "place"), [F.col(c) for c in docs.columns]
    many = left.join(repeated, name, "left_semi").withColumn(place, F.row_number().over(Window.partitionBy(name).orderBy(F.xxhash64(*columns)))).filter(F.col(place) == 1).drop(place)
    return left.join(repeated, name, "left_anti").unionByName(many).select(*columns)
