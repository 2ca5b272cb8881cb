"""Suffix-array removal of long passages that an earlier document has.

A position is removed if a ``length``-byte string that covers it also starts in a document of smaller
id. All such strings are the ``length``-byte prefixes of suffixes, so the index holds suffixes in the
order of that prefix, as a logarithmic family of arrays: a batch of documents in id order gets its own
suffix array, is merge-scanned against every existing level for matches, and joins the family as a
level; levels of equal rank merge into one of the next, as a binary counter carries.

The family is partitioned by content so that equal strings meet in one partition. A string belongs to
the smallest hash among its ``gram``-byte substrings; a run of neighbouring strings with the same one
is a segment and travels together. Before any bytes travel, every part of the corpus states the
distinct hashes of its segments (32 bits each within a bucket), learns which of them occur in two
documents, and sends only those segments; of equal segments in a part only the first, as the others
repeat it whatever else matches. So a passage in a third of all documents is one segment a part.

One exchange of the texts serves all three passes over them. Parts grow in number with the bytes of
text (and are no fewer than ``spark.sql.shuffle.partitions``), buckets with the parts; a task holds one
part's texts or one bucket's segments.

Defined results
* null text is empty. Shorter texts than ``length`` keep all. Offsets and counts are bytes of UTF-8.
* rows that share an id never match one another (neither id is smaller); equal rows get equal results.
* a null id is neither earlier nor later than another: its text is kept and removes nothing.
* empty table: no rows. Extra columns are dropped, or carried if asked for.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, rest, text_or_empty, text_parts
from .shingles import BASE, VALUES, mixed, powers

LENGTH = 50
GRAM = 24
BATCH_STRINGS = 250_000
#: Bytes hashed at once; the arrays over them are many times as large.
CHUNK = 1 << 16
#: Suffixes compared at once.
PIECE = 1 << 15


class SuffixLevels:
    """The logarithmic family over ``data``: arrays of suffix positions in the order of their ``length``-byte
    prefixes, one position a distinct prefix, with its first owner. Prefixes are read from ``data`` when they are
    compared, so a level takes 16 bytes a prefix whatever its length."""

    def __init__(self, data: np.ndarray, length: int) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.windows = np.lib.stride_tricks.sliding_window_view(data, length) if len(data) >= length else data[:0].reshape(0, length)

    def _strings(self, at: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(self.windows[at]).view(f"S{self.windows.shape[1]}").ravel()

    def _heads(self, at: np.ndarray) -> np.ndarray:
        """The first eight bytes of each prefix as integers of the same order."""
        out = np.zeros((len(at), 8), dtype=np.uint8)
        out[:, : self.windows.shape[1]] = self.windows[at, :8]
        return out.view(">u8").ravel().astype(np.uint64)

    def _search(self, known: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of ``at``: the first of ``known`` (in order) that is not below it, and whether their prefixes are equal."""
        place, equal = np.empty(len(at), dtype=np.int64), np.zeros(len(at), dtype=bool)
        heads = self._heads(known)
        for a in range(0, len(at), PIECE):
            own = at[a : a + PIECE]
            head = self._heads(own)
            low, high = np.searchsorted(heads, head), np.searchsorted(heads, head, "right")
            end = high.copy()
            open_ = np.flatnonzero(low < high)
            while len(open_):
                middle = (low[open_] + high[open_]) >> 1
                less = self._strings(known[middle]) < self._strings(own[open_])
                low[open_[less]], high[open_[~less]] = middle[less] + 1, middle[~less]
                open_ = open_[low[open_] < high[open_]]
            met = np.flatnonzero(low < end)
            place[a : a + PIECE] = low
            equal[a + met] = self._strings(known[low[met]]) == self._strings(own[met])
        return place, equal

    def add(self, starts: np.ndarray, owners: np.ndarray) -> np.ndarray:
        """Index a batch of suffixes whose owners are not below any earlier batch's; gives each one's least owner so far."""
        strings = self._strings(starts)
        order = np.argsort(strings)
        ranked = strings[order]
        first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
        size = len(ranked)
        del strings, ranked
        distinct, owner = starts[order[first]], np.minimum.reduceat(owners[order], first)
        least = owner.copy()
        for _, known, known_owner in self.levels:
            at, hit = self._search(known, distinct)
            least[hit] = np.minimum(least[hit], known_owner[at[hit]])
        out = np.empty(size, dtype=np.int64)
        out[order] = np.repeat(least, np.diff(np.append(first, size)))
        self._push(0, distinct, owner)
        return out

    def _push(self, rank: int, starts: np.ndarray, owner: np.ndarray) -> None:
        while self.levels and self.levels[-1][0] == rank:
            _, older, older_owner = self.levels.pop()
            at, known = self._search(older, starts)
            same = at[known]
            older_owner = older_owner.copy()
            older_owner[same] = np.minimum(older_owner[same], owner[known])
            starts, owner = np.insert(older, at[~known], starts[~known]), np.insert(older_owner, at[~known], owner[~known])
            rank += 1
        self.levels.append((rank, starts, owner))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[: len(x) - (width - span)], x[width - span :]) if span < width else x


def _segments(texts: list[bytes], length: int, gram: int):
    """Runs of neighbouring strings with one smallest gram: (data, hash, first byte, end byte, text, offset in it)."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) < CHUNK:
            size += len(texts[stop])
            stop += 1
        part = texts[at:stop]
        data = b"\0".join(part) + b"\0"
        if len(data) > length:
            raw = np.frombuffer(data, dtype=np.uint8)
            sums = np.empty(len(raw) + 1, dtype=np.uint64)
            sums[0] = 0
            np.cumsum(VALUES[raw] * powers(BASE, len(raw)), out=sums[1:])
            grams = mixed((sums[gram:] - sums[:-gram]) * powers(pow(BASE, -1, 2**64), len(raw))[: len(raw) + 1 - gram])
            least = _sliding_min(grams, length - gram + 1)
            sizes = np.array([len(t) + 1 for t in part])
            ends = np.cumsum(sizes)
            text = np.repeat(np.arange(len(part)), sizes)[: len(least)]
            whole = np.arange(len(least)) + length < ends[text]
            change = np.concatenate(([True], (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1])))
            first = np.flatnonzero(change)
            last = np.append(first[1:], len(least))
            keep = whole[first]
            first, last = first[keep], last[keep]
            yield data, least[first], first, last + length - 1, text[first] + at, first - (ends - sizes)[text[first]]
        at = stop


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 further bits of a hash, in one integer."""
    return ((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))


def _part(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Order of a part's rows by (id, text), null ids last; ids and texts in that order."""
    release()
    texts = [t or b"" for t in table["text"].to_pylist()]
    ids = table["doc_id"].to_pylist()
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, texts[i]))
    return np.array(order, dtype=np.int64), [ids[i] for i in order], [texts[i] for i in order]


_SENT = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("part", pa.int32()), ("row", pa.binary()), ("owner", pa.binary()), ("start", pa.binary()), ("size", pa.binary()), ("bytes", pa.binary())])
_SENT_DDL = "kind int, bucket int, part int, row binary, owner binary, start binary, size binary, bytes binary"


def _ints(x) -> bytes:
    return np.asarray(x, dtype="<i8").tobytes()


def _joined(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<i8")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, carry: tuple[str, ...] = (), batch_strings: int = BATCH_STRINGS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``carry``, also those columns
    and ``kept_text`` (what is left; a character that was cut apart is dropped)."""
    n_parts = text_parts(docs)
    n_buckets = 4 * n_parts
    carried = F.struct(*carry) if carry else F.lit(None).cast("struct<x:int>")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), carried.alias("carried"))
    texts = texts.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int")).repartition(n_parts, "part")

    def state(table: pa.Table) -> pa.Table:
        """The distinct codes of a part by bucket, and which of them two of its own documents share."""
        _, ids, own = _part(table)
        codes, rows = [], []
        for _, hashes, _, _, text, _ in _segments(own[: sum(i is not None for i in ids)], length, gram):
            codes.append(_codes(hashes, n_buckets))
            rows.append(text.astype(np.int32))
        out = []
        if codes:
            codes, rows = np.concatenate(codes), np.concatenate(rows)
            order = np.argsort(codes, kind="stable")
            codes, rows = codes[order], rows[order]
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            again = rows[first] != rows[np.append(first[1:], len(codes)) - 1]  # rows are ascending within a code
            codes = codes[first]
            bounds = np.searchsorted(codes >> np.uint64(32), np.arange(n_buckets + 1, dtype=np.uint64))
            short = codes.astype(np.uint32)
            out = [(b, table["part"][0].as_py(), short[i:j].tobytes(), short[i:j][again[i:j]].tobytes()) for b, (i, j) in enumerate(zip(bounds, bounds[1:])) if j > i]
        rest()
        kinds = pa.schema([("bucket", pa.int32()), ("part", pa.int32()), ("codes", pa.binary()), ("again", pa.binary())])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds.types)] if out else [pa.array([], t) for t in kinds.types], schema=kinds)

    def meet(table: pa.Table) -> pa.Table:
        """For each part, the codes of a bucket that occur in two documents of the corpus."""
        lists = [np.frombuffer(x, dtype=np.uint32) for x in table["codes"].to_pylist()]
        codes, times = np.unique(np.concatenate(lists), return_counts=True)
        again = np.unique(np.frombuffer(b"".join(table["again"].to_pylist()), dtype=np.uint32))
        shared = np.union1d(codes[times > 1], again)
        out = [np.intersect1d(x, shared, assume_unique=True).tobytes() for x in lists]
        return pa.Table.from_arrays([table["part"].combine_chunks(), table["bucket"].combine_chunks(), pa.array(out, pa.binary())], schema=pa.schema([("part", pa.int32()), ("bucket", pa.int32()), ("codes", pa.binary())]))

    def send(table: pa.Table, shared: pa.Table) -> pa.Table:
        """Shared segments by bucket; of equal segments of a part the first document's, the others are matches already."""
        out: list[tuple] = []
        if len(table) and len(shared):
            part = table["part"][0].as_py()
            _, ids, own = _part(table)
            known = np.sort(np.concatenate([(np.uint64(b) << np.uint64(32)) | np.frombuffer(x, dtype=np.uint32).astype(np.uint64) for b, x in zip(shared["bucket"].to_pylist(), shared["codes"].to_pylist())]))
            seen: dict[bytes, int] = {}
            kept, segments = array("q"), []  # bucket, row, owner and start of each segment, flat: a part has many
            matched = array("q")  # row, start and size of each segment that an earlier document of the part has
            for data, hashes, first, end, text, offset in _segments(own[: sum(i is not None for i in ids)], length, gram):
                codes = _codes(hashes, n_buckets)
                hit = known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes if len(known) else np.zeros(len(codes), dtype=bool)
                buckets = (codes[hit] >> np.uint64(32)).tolist()
                for bucket, a, b, row, at in zip(buckets, first[hit].tolist(), end[hit].tolist(), text[hit].tolist(), offset[hit].tolist()):
                    segment = data[a:b]
                    owner = ids[row]
                    if seen.setdefault(segment, owner) < owner:
                        matched.extend((row, at, b - a))
                    else:
                        kept.extend((bucket, row, owner, at))
                        segments.append(segment)
            del seen
            flat = np.frombuffer(kept, dtype=np.int64).reshape(-1, 4)
            order = np.argsort(flat[:, 0], kind="stable")
            bounds = np.searchsorted(flat[order, 0], np.arange(n_buckets + 1))
            for bucket, (i, j) in enumerate(zip(bounds, bounds[1:])):
                if j > i:
                    mine = order[i:j]
                    pieces = [segments[x] for x in mine]
                    out.append((0, bucket, part, *(_ints(flat[mine, c]) for c in (1, 2, 3)), _ints([len(x) for x in pieces]), b"".join(pieces)))
            if matched:
                rows, starts, sizes = np.frombuffer(matched, dtype=np.int64).reshape(-1, 3).T
                out.append((1, part % n_buckets, part, _ints(rows), b"", _ints(starts), _ints(sizes), b""))
            rest()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SENT.types)] if out else [pa.array([], t) for t in _SENT.types], schema=_SENT)

    found_schema = pa.schema([("part", pa.int32()), ("row", pa.binary()), ("start", pa.binary()), ("size", pa.binary())])

    def match(table: pa.Table) -> pa.Table:
        """A bucket's segments through the index in the order of their owners; gives the matched runs of strings."""
        release()
        kind = table["kind"].to_numpy()
        passed = table.filter(pa.array(kind == 1))
        table = table.filter(pa.array(kind == 0))
        results = [passed.select(["part", "row", "start", "size"])]
        if len(table):
            size, owner, row, start = (_joined(table[c]) for c in ("size", "owner", "row", "start"))
            part = np.repeat(table["part"].to_numpy(), [len(x) // 8 for x in table["size"].to_pylist()])
            data = np.frombuffer(b"".join(table["bytes"].to_pylist()), dtype=np.uint8)
            begin = np.cumsum(size) - size
            order = np.argsort(owner, kind="stable")
            strings = size - (length - 1)
            index = SuffixLevels(data, length)
            batch = np.cumsum(strings[order]) // batch_strings
            hits: list[tuple] = []
            for own in np.split(order, np.flatnonzero(np.diff(batch)) + 1):
                count = strings[own]
                segment = np.repeat(np.arange(len(own)), count)
                within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                at = begin[own][segment] + within
                least = index.add(at, owner[own][segment])
                hit = least < owner[own][segment]
                edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
                cut = (within == 0) & hit  # a run ends with its segment
                first = np.flatnonzero((edge[:-1] == 1) | cut)
                last = np.flatnonzero((edge[1:] == -1) | np.append(cut[1:] & hit[:-1], False))
                s = own[segment[first]]
                hits.append((part[s], row[s], start[s] + within[first], last - first + length))
            part, row, start, size = (np.concatenate(c) for c in zip(*hits))
            order = np.argsort(part, kind="stable")
            part, row, start, size = part[order], row[order], start[order], size[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.array([], dtype=np.int64)
            spans = list(zip(edges, np.append(edges[1:], len(part))))
            columns = [[int(part[i]) for i, _ in spans], *([_ints(x[i:j]) for i, j in spans] for x in (row, start, size))]
            results.append(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, found_schema.types)], schema=found_schema))
        rest()
        return pa.concat_tables([r.cast(found_schema) for r in results])

    result = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + ([("kept_text", pa.string())] if carry else [])

    def remove(table: pa.Table, found: pa.Table) -> pa.Table:
        order, ids, own = _part(table)
        row, start, size = (_joined(found[c]) for c in ("row", "start", "size")) if len(found) else (np.array([], dtype=np.int64),) * 3
        by = np.lexsort((start, row))
        row, start, stop = row[by], start[by], (start + size)[by]
        bounds = np.searchsorted(row, np.arange(len(own) + 1))
        out = []
        for i, text in enumerate(own):
            a, b = int(bounds[i]), int(bounds[i + 1])
            removed = spans = 0
            left = text
            if b > a:
                reach = np.maximum.accumulate(stop[a:b])
                fresh = np.concatenate(([True], start[a + 1 : b] > reach[:-1]))
                begins = start[a:b][fresh]
                ends = reach[np.append(np.flatnonzero(fresh)[1:] - 1, b - a - 1)]
                spans, removed = len(begins), int((ends - begins).sum())
                left = b"".join(text[x:y] for x, y in zip([0, *ends.tolist()], [*begins.tolist(), len(text)]))
            out.append((ids[i], len(text), removed, spans, hashlib.sha256(left).hexdigest(), *([left.decode("utf-8", "ignore").encode()] if carry else [])))
        columns = [pa.array(c, t) for c, (_, t) in zip(zip(*out), result)] if out else [pa.array([], t) for _, t in result]
        rest()
        names = [n for n, _ in result]
        if carry:
            held = table["carried"].combine_chunks().take(pa.array(order))
            columns.append(pa.StructArray.from_arrays(held.flatten(), fields=[f.with_nullable(True) for f in held.type]))
            names.append("carried")
        return pa.table(columns, names=names)

    lists = texts.groupBy("part").applyInArrow(state, "bucket int, part int, codes binary, again binary")
    shared = lists.groupBy("bucket").applyInArrow(meet, "part int, bucket int, codes binary")
    sent = texts.groupBy("part").cogroup(shared.groupBy("part")).applyInArrow(send, _SENT_DDL)
    found = sent.groupBy("bucket").applyInArrow(match, "part int, row binary, start binary, size binary")
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if not carry:
        return texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(remove, ddl)
    full = texts.groupBy("part").cogroup(found.groupBy("part")).applyInArrow(remove, f"{ddl}, kept_text string, carried {texts.schema['carried'].dataType.simpleString()}")
    return full.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text", *[F.col("carried")[c].alias(c) for c in carry if c != "doc_id"])


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """Every document with its repeated passages removed; the columns of ``docs``, n_chars counted again."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    taken = {"n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"}
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(f"{c}__own") if c in taken else F.col(c) for c in others])
    names = tuple(f"{c}__own" if c in taken else c for c in others) or ("doc_id",)
    out = suffix_dedup(renamed, carry=names, **options)
    value = {c: F.col(f"{c}__own" if c in taken else c) for c in others} | {"text": F.col("kept_text"), "doc_id": F.col("doc_id")}
    if "n_chars" in others:
        value["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[value[c].alias(c) for c in docs.columns])
