"""Language-model scores from an Elias-Fano n-gram trie.

The model interpolates words after a word with words alone: for a pair (v, w) seen c times,
p(w|v) = max(c - D, 0) / c(v) + D t(v) / c(v) p(w), where c(v) counts v as a context, t(v) its
distinct followers, and p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)). The discounted shares (c - D) / c(v)
are kept as 16-bit codes of their logarithms.

Longer contexts, up to ``order`` - 1 words, are interpolated with the next shorter one in the same way:
p(w|h) = max(c(hw) - D, 0) / c(h) + D t(h) / c(h) p(w|h without its first word). A context never reaches
before the start of its text; one that was not seen in training leaves the word to the shorter context.

The trie is cut into shards, each a compact block: an Elias-Fano list of its words, contexts as ids in
it with Elias-Fano pointers to their followers, and followers as ids within the context's range of
one monotone sequence (id + rank of the context x words). A pair is found by the context's rank and a
successor search inside its range. A level above pairs holds its contexts (each the next shorter one and
a word before it), and each follower as its place among the words that follow the context's last word
in the shard; shares and back-offs are 16-bit codes. A shard's blocks are written to files and mapped.

Pairs go to shards by their context; a context with more than a share of all tokens is spread over
many shards by follower. Longer n-grams go by the last two words of their context, so that a context's
followers, and the shorter contexts that it extends, stand together. Each part of the corpus sends every
distinct word and n-gram once, with its count in the training documents, and gets back what it needs, in
the same order: no lookup table is ever larger than a part or a shard, and all that travels grows with the
corpus, not with repeats. Words travel as hashes once; then as the ids that their shards gave them.

Defined results
* null text is empty: its one token is the end. Text is lower-cased A-Z; words end at white space.
* the first word's context is the start of the text, seen once for each training document.
* empty table: no rows; without training documents N = 0 and every probability is 1. Equal rows score equally.
* words are 64-bit hashes; different ones coincide with probability about 2**-64 a pair.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, text_parts, trim
from .shingles import mixed, word_hashes
from .toxicity import fold

END = np.uint64(0xE7037ED1A0B428DB)
START = np.uint64(0x8EBC6AF09C88C6E3)
DISCOUNT = 0.75
CODE_STEP = 4096.0
UNSEEN = 65535
#: Lookups at once.
PIECE = 1 << 14


# --- Elias-Fano sequences -------------------------------------------------------------------


def _pack(values: np.ndarray, bits: int) -> np.ndarray:
    """Fixed-width fields, least significant bit first, in 64-bit words with one word of padding."""
    out = np.zeros(len(values) * bits // 64 + 2, dtype=np.uint64)
    if bits:
        at = np.arange(len(values), dtype=np.int64) * bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        np.bitwise_or.at(out, word, values << shift)
        over = (at & 63) + bits > 64
        np.bitwise_or.at(out, word[over] + 1, values[over] >> (np.uint64(64) - shift[over]))
    return out


def _unpack(words: np.ndarray, bits: int, index: np.ndarray) -> np.ndarray:
    if not bits:
        return np.zeros(len(index), dtype=np.uint64)
    at = index.astype(np.int64) * bits
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    value = words[word] >> shift
    over = (at & 63) + bits > 64
    value[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return value & np.uint64((1 << bits) - 1)


def _select(rest: np.ndarray, bits: np.ndarray, place: np.ndarray) -> None:
    """Set ``place`` to the ``rest``-th one of each 64 bits, by the half that holds it; the arguments are used up."""
    for width in (32, 16, 8, 4, 2, 1):
        count = np.bitwise_count(bits & np.uint64((1 << width) - 1)).astype(np.int64)
        go = rest >= count
        rest -= count * go
        step = go * np.int64(width)
        place += step
        bits >>= step.view(np.uint64)


class EliasFano:
    """A non-decreasing sequence: low bits packed, high bits in unary with a count of zeros before every word."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, zeros: np.ndarray):
        self.n, self.bits, self.top = (int(x) for x in head[:3])
        self.head, self.low, self.high, self.zeros = head, low, high, zeros

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        most = int(values[-1]) if n else 0
        bits = min(63, max(0, (most // max(1, n)).bit_length() - 1))
        top = (values >> np.uint64(bits)).astype(np.int64)
        flags = np.zeros((n + (most >> bits) + 2 + 63) // 64 * 64, dtype=np.uint8)
        flags[top + np.arange(n)] = 1
        high = np.packbits(flags, bitorder="little").view("<u8")
        zeros = np.concatenate(([0], np.cumsum(64 - np.bitwise_count(high).astype(np.int64))))
        return cls(np.array([n, bits, most >> bits], dtype=np.int64), _pack(values & np.uint64((1 << bits) - 1), bits), high, zeros)

    def arrays(self) -> list[np.ndarray]:
        return [self.head, self.low, self.high, self.zeros]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros, k, "right") - 1
        rest, bits = k - self.zeros[word], ~self.high[word]
        place = np.zeros(len(k), dtype=np.int64)
        _select(rest, bits, place)
        return word * 64 + place

    def _ones(self, at: np.ndarray) -> np.ndarray:
        """Length of the run of ones that starts at each position of the high bits; 64 or more counts as 64."""
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        bits = self.high[word] >> shift
        over = np.flatnonzero(shift)
        after = np.minimum(word[over] + 1, len(self.high) - 1)
        bits[over] |= self.high[after] << (np.uint64(64) - shift[over])
        bits = ~bits
        bits = (bits & (~bits + np.uint64(1))) - np.uint64(1)  # the ones below the first zero
        return np.bitwise_count(bits).astype(np.int64)

    def values(self, index: np.ndarray) -> np.ndarray:
        """The elements at ``index``: the index-th one of the high bits by search over the counts of words."""
        ones = np.arange(len(self.zeros)) * 64 - self.zeros
        word = np.searchsorted(ones, index, "right") - 1
        rest, bits = index - ones[word], self.high[word].copy()
        place = np.zeros(len(index), dtype=np.int64)
        _select(rest, bits, place)
        top = word * 64 + place - index
        return (top.astype(np.uint64) << np.uint64(self.bits)) | _unpack(self.low, self.bits, index)

    def find(self, x: np.ndarray) -> np.ndarray:
        """Index of each x, or -1: the run of equal high bits by a select, then a successor search in it."""
        x = np.asarray(x, dtype=np.uint64)
        out = np.full(len(x), -1, dtype=np.int64)
        for a in range(0, len(x) if self.n else 0, PIECE):
            out[a : a + PIECE] = self._find(x[a : a + PIECE])
        return out

    def _find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), -1, dtype=np.int64)
        top = (x >> np.uint64(self.bits)).astype(np.int64)
        inside = np.flatnonzero((x >> np.uint64(self.bits)) <= np.uint64(self.top))
        top, want = top[inside], x[inside] & np.uint64((1 << self.bits) - 1)
        start = np.where(top > 0, self._zero(np.maximum(top - 1, 0)) + 1, 0)
        run = self._ones(start)
        low = start - top
        long = np.flatnonzero(run == 64)
        run[long] = self._zero(top[long]) - start[long]
        some = np.flatnonzero(run)
        first = _unpack(self.low, self.bits, low[some])  # most runs are of one or two
        hit = some[first == want[some]]
        out[inside[hit]] = low[hit]
        open_ = some[(first < want[some]) & (run[some] > 1)]
        low, end, want, inside = low[open_] + 1, (low + run)[open_], want[open_], inside[open_]
        high, open_ = end.copy(), np.arange(len(low))
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            less = _unpack(self.low, self.bits, middle) < want[open_]
            low[open_[less]] = middle[less] + 1
            high[open_[~less]] = middle[~less]
            open_ = open_[low[open_] < high[open_]]
        hit = low < end
        hit[hit] = _unpack(self.low, self.bits, low[hit]) == want[hit]
        out[inside[hit]] = low[hit]
        return out


def pack_sorted(values: np.ndarray) -> bytes:
    """A non-decreasing sequence as Elias-Fano bytes without the directory."""
    e = EliasFano.of(values)
    return np.concatenate((np.array([e.n, e.bits, len(e.low)], dtype="<u8"), e.low, e.high)).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    words = np.frombuffer(data, dtype="<u8")
    n, bits, low = (int(x) for x in words[:3])
    top = np.flatnonzero(np.unpackbits(words[3 + low :].view(np.uint8), bitorder="little"))[:n] - np.arange(n)
    return ((top.astype(np.uint64) << np.uint64(bits)) | _unpack(words[3 : 3 + low], bits, np.arange(n))).astype(np.int64)


def _distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])[: len(x)]]


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values in order, and the rank of each value among them, by a hash table."""
    found = pa.array(x).dictionary_encode()
    values, of = found.dictionary.to_numpy(), found.indices.to_numpy()
    order = np.argsort(values)
    rank = np.empty(len(values), dtype=np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    return values[order], rank[of]


def _runs_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The value and the length of each run of equal neighbours."""
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    return x[first], np.diff(np.append(first, len(x)))


def _dense(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones."""
    return np.searchsorted(_distinct(x), x)


def narrow(x: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes that hold them all, after a byte that tells how many."""
    size = next(b for b in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * b)
    return bytes([size]) + x.astype(f"<u{size}").tobytes()


def widened(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<u{data[0]}", offset=1).astype(np.int64)


def squeezed(data: bytes) -> bytes:
    """A piece of a message, entropy-coded: its length, then the compressed bytes."""
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def opened(column: pa.ChunkedArray) -> list[bytes | None]:
    """The pieces of a column that were ``squeezed``."""
    return [None if x is None else pa.decompress(memoryview(x)[8:], int.from_bytes(x[:8], "little"), "zstd", asbytes=True) for x in column.to_pylist()]


# --- The trie -------------------------------------------------------------------------------


def share_codes(shares: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-np.log10(shares) * CODE_STEP), 0, UNSEEN - 1).astype("<u2")


def _block(sequences: list[np.ndarray], codes: list[np.ndarray]) -> bytes:
    pieces = [a for s in sequences for a in EliasFano.of(s).arrays()]
    pieces += [np.frombuffer(c.tobytes() + b"\0" * (-c.nbytes % 8), dtype="<i8") for c in codes]
    sizes = np.array([len(p) for p in pieces], dtype="<i8")
    lengths = np.array([len(c) for c in codes], dtype="<i8")
    return np.concatenate([np.array([len(pieces), len(codes)], dtype="<i8"), lengths, sizes, *(p.view("<i8") for p in pieces)]).tobytes()


def _parts_of(block: np.ndarray) -> tuple[list[EliasFano], list[np.ndarray]]:
    """The sequences and codes of a block."""
    data = block.view("<i8")
    n, m = int(data[0]), int(data[1])
    lengths, sizes = data[2 : 2 + m], data[2 + m : 2 + m + n]
    ends = 2 + m + n + np.cumsum(sizes)
    pieces = [data[e - s : e] for s, e in zip(sizes, ends)]
    sequences = [EliasFano(pieces[i], pieces[i + 1].view("<u8"), pieces[i + 2].view("<u8"), pieces[i + 3]) for i in range(0, n - m, 4)]
    return sequences, [p.view("<u2")[:k] for p, k in zip(pieces[n - m :], lengths)]


class _Mapped:
    @classmethod
    def mapped(cls, block: bytes):
        """The block in a mapped temporary file that is gone once it is closed."""
        with tempfile.TemporaryFile() as f:
            f.write(block)
            f.flush()
            return cls(np.memmap(f, dtype=np.uint8, mode="r"))


def build_trie(context: np.ndarray, follower: np.ndarray, count: np.ndarray, total: np.ndarray) -> bytes:
    """A shard's block from distinct pairs of hashes with their counts (all above 0) and their context's count."""
    words = np.unique(np.concatenate((context, follower)))
    of, to = np.searchsorted(words, context), np.searchsorted(words, follower)
    order = np.argsort(of * len(words) + to, kind="stable")
    of, to = of[order], to[order]
    contexts, first = np.unique(of, return_index=True)
    rank = np.repeat(np.arange(len(contexts)), np.diff(np.append(first, len(of))))
    shares = np.maximum(count[order] - DISCOUNT, 1e-9) / np.maximum(total[order], 1)
    return _block([words, contexts, np.append(first, len(of)), to.astype(np.uint64) + rank.astype(np.uint64) * np.uint64(len(words))], [share_codes(shares)])


class Trie(_Mapped):
    """A mapped block: ``find`` gives the code of each pair, ``followers`` a context's distinct followers."""

    def __init__(self, block: np.ndarray):
        (self.words, self.contexts, self.pointers, self.children), (self.codes,) = _parts_of(block)

    def followers(self, context: np.ndarray) -> np.ndarray:
        return self.reach(self.rank(self.words.find(context)))

    def reach(self, rank: np.ndarray) -> np.ndarray:
        """Distinct followers of the contexts of these ranks; none for a rank below 0."""
        seen = rank >= 0
        out = np.zeros(len(rank), dtype=np.int64)
        out[seen] = (self.pointers.values(rank[seen] + 1) - self.pointers.values(rank[seen])).astype(np.int64)
        return out

    def rank(self, word: np.ndarray) -> np.ndarray:
        """Rank among the contexts of each place in ``words``, or -1."""
        rank = self.contexts.find(np.maximum(word, 0).astype(np.uint64))
        return np.where(word >= 0, rank, -1)

    def find(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """The code of each pair's discounted share, or UNSEEN."""
        return self.shares(self.rank(self.words.find(context)), self.words.find(follower))

    def shares(self, rank: np.ndarray, word: np.ndarray) -> np.ndarray:
        """``find`` by the contexts' ranks and the followers' places in ``words``; below 0 is none."""
        at = self.children.find(np.maximum(word, 0).astype(np.uint64) + np.maximum(rank, 0).astype(np.uint64) * np.uint64(max(1, self.words.n)))
        hit = (rank >= 0) & (word >= 0) & (at >= 0)
        out = np.full(len(rank), UNSEEN, dtype="<u2")
        out[hit] = self.codes[at[hit]]
        return out


class Level(_Mapped):
    """A mapped level above pairs: contexts, where each context's followers start, followers, their shares, back-offs."""

    def __init__(self, block: np.ndarray):
        (self.contexts, self.starts, self.children), (self.codes, self.backs) = _parts_of(block)

    @classmethod
    def of(cls, context: np.ndarray, reach: np.ndarray, place: np.ndarray, count: np.ndarray) -> "Level":
        """From n-grams (equal ones are summed): context, its last word's number of followers, the follower's place among them."""
        contexts, of = np.unique(context, return_inverse=True)
        wide = np.zeros(len(contexts), dtype=np.int64)
        wide[of] = reach
        starts = np.concatenate(([0], np.cumsum(wide)))
        children, at = np.unique(starts[of] + place, return_inverse=True)
        sums = np.bincount(at, count, len(children))
        rank = np.searchsorted(starts, children, "right") - 1
        total, distinct = np.bincount(rank, sums, len(contexts)), np.bincount(rank, minlength=len(contexts))
        return cls.mapped(_block([contexts, starts, children], [share_codes((sums - DISCOUNT) / total[rank]), share_codes(DISCOUNT * distinct / total)]))

    def context(self, key: np.ndarray) -> np.ndarray:
        """Rank of each context, or -1; a key below 0 is none."""
        return np.where(key >= 0, _find(self.contexts, np.maximum(key, 0)), -1)

    def find(self, rank: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The code of each follower's share, or UNSEEN; a rank or place below 0 is none."""
        out = np.full(len(rank), UNSEEN, dtype="<u2")
        for a in range(0, len(rank), PIECE):
            known = a + np.flatnonzero((rank[a : a + PIECE] >= 0) & (place[a : a + PIECE] >= 0))
            ranks, times = _runs_of(rank[known])
            at = self.children.find(np.repeat(self.starts.values(ranks), times) + place[known].astype(np.uint64))
            out[known[at >= 0]] = self.codes[at[at >= 0]]
        return out

    def back(self, rank: np.ndarray) -> np.ndarray:
        out = np.full(len(rank), UNSEEN, dtype="<u2")
        out[rank >= 0] = self.backs[rank[rank >= 0]]
        return out


def _find(sequence: EliasFano, x: np.ndarray) -> np.ndarray:
    """Index of each x in the sequence, or -1, with one search for equal ones."""
    distinct, of = np.unique(x, return_inverse=True)
    return np.concatenate([sequence.find(distinct[a : a + PIECE]).astype(np.int32) for a in range(0, len(distinct), PIECE)] or [np.zeros(0, np.int32)])[of]


class Places:
    """The place of each follower among the words that follow a word, from distinct sorted keys (word x bound + follower)."""

    def __init__(self, keys: np.ndarray, bound: int):
        last, first = np.unique(keys // bound, return_index=True)
        self.keys, self.last, self.first, self.bound = (*map(EliasFano.of, (keys, last, np.append(first, len(keys)))), bound)

    def of(self, word: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the word's followers, and the follower's place, or -1."""
        keys, of = np.unique(word * self.bound + follower, return_inverse=True)
        reach, place = np.zeros(len(keys), dtype=np.int32), np.full(len(keys), -1, dtype=np.int32)
        for a in range(0, len(keys) if self.last.n else 0, PIECE):
            some = slice(a, a + PIECE)
            words, times = _runs_of(keys[some] // self.bound)
            rank, at = self.last.find(words), self.keys.find(keys[some])
            start, end = (self.first.values(np.maximum(rank, 0) + i).astype(np.int64) for i in (0, 1))
            reach[some] = np.repeat(np.where(rank >= 0, end - start, 0), times)
            place[some] = np.where(at >= 0, at - np.repeat(start, times), -1)
        return reach[of], place[of]


def answer_levels(asked: list[list[bytes]], names: list[np.ndarray], bound: int) -> list[bytes]:
    """Build a shard's levels above pairs from all parts' n-grams; then each part's codes, back-offs by context, level by level.

    ``names`` are the ids of the words that a part numbers from 0 in its message. ``asked`` holds three pieces a level and part:
    contexts (level 3: last word x names + the one before it; above: index of the shorter context in the part's list x names + the
    word before it), n-grams (index of the context x names + follower), counts.
    """
    out: list[list[bytes]] = [[] for _ in asked]
    shorter, places = None, None
    for at in range(0, len(asked[0]) if asked else 0, 3):
        keys, grams = [], []
        for a, ids in zip(asked, names):
            old, new = np.divmod(unpack_sorted(a[at]), max(1, len(ids)))
            keys.append((ids[old] if shorter is None else old) * bound + ids[new])
            of, follower = np.divmod(unpack_sorted(a[at + 1]), max(1, len(ids)))
            grams.append((of.astype(np.int32), ids[follower].astype(np.int32)))
        of, follower = (np.concatenate(x) for x in zip(*grams))
        del grams
        count = np.concatenate([widened(a[at + 2]) for a in asked])
        n, m = np.array([len(k) for k in keys]), np.array([len(a[at + 2]) - 1 for a in asked]) // [a[at + 2][0] for a in asked]
        offset = np.cumsum(n) - n
        key, of = np.concatenate(keys), of + np.repeat(offset, m)
        del keys
        if shorter is None:
            last = key // bound
        else:
            parent, word = np.divmod(key, bound)
            parent += np.repeat(shorter[2], n)
            last, rank = shorter[1][parent], shorter[0][parent]
            key = np.where(rank >= 0, rank.astype(np.int64) * bound + word, -1)
        trained = count > 0
        if places is None:
            places = Places(_distinct(last[of[trained]] * bound + follower[trained]), bound)
        reach, place = places.of(last[of], follower)
        level = Level.of(key[of[trained]], reach[trained], place[trained], count[trained])
        rank = level.context(key)
        codes, backs = level.find(rank[of], place), level.back(rank)
        for o, c, b in zip(out, np.split(codes, np.cumsum(m)[:-1]), np.split(backs, np.cumsum(n)[:-1])):
            o += [c.tobytes(), b.tobytes()]
        shorter = rank, last, offset
    return [_joined(o) for o in out]


def _joined(pieces: list[bytes]) -> bytes:
    return np.array([len(pieces), *map(len, pieces)], dtype="<i8").tobytes() + b"".join(pieces)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    ends = 8 * (n + 1) + np.cumsum(np.frombuffer(data, "<i8", n, 8))
    return [data[a:b] for a, b in zip([8 * (n + 1), *ends.tolist()], ends.tolist())]


def share(codes: np.ndarray) -> np.ndarray:
    """The discounted shares that codes stand for; 0 for an unseen pair."""
    return np.where(codes == UNSEEN, 0.0, 10.0 ** (codes.astype(np.float64) / -CODE_STEP))


# --- The corpus -----------------------------------------------------------------------------


def _tokens(texts: list[bytes], chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the texts in order, each text closed by END, and the tokens of each text."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) < chunk:
            size += len(texts[stop])
            stop += 1
        words, of = word_hashes(texts[at:stop])
        count = np.bincount(of, minlength=stop - at)
        out = np.empty(len(words) + stop - at, dtype=np.uint64)
        out[np.arange(len(words)) + of] = words
        out[np.cumsum(count + 1) - 1] = END
        hashes.append(out)
        counts.append(count + 1)
        at = stop
    return (np.concatenate(hashes), np.concatenate(counts)) if hashes else (np.array([], np.uint64), np.array([], np.int64))


_TEXTS_DDL = "part int, doc_id array<long>, held_out array<boolean>, size array<long>, text binary"


def packed_texts(batches):
    """Rows of (doc_id, text, held_out, part), many to a row by part, their texts as one compressed piece."""
    for batch in batches:
        part = np.asarray(batch.column(3))
        order = np.argsort(part, kind="stable")
        bounds = [*np.flatnonzero(np.concatenate(([True], part[order][1:] != part[order][:-1]))), len(order)] if len(order) else [0]
        rows = []
        for a, b in zip(bounds, bounds[1:]):
            own = batch.take(pa.array(order[a:b]))
            texts = own.column(1).to_pylist()
            rows.append((int(part[order[a]]), own.column(0).to_pylist(), own.column(2).to_pylist(), [len(t) for t in texts], pa.compress(b"".join(texts), "zstd", asbytes=True)))
        types = [pa.int32(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=["part", "doc_id", "held_out", "size", "text"])


def unpacked_texts(table: pa.Table) -> tuple[list, np.ndarray, list[bytes]]:
    """Ids, held-out marks and texts of a part's rows."""
    texts: list[bytes] = []
    for sizes, data in zip(table["size"].to_pylist(), table["text"].to_pylist()):
        ends = np.cumsum([0, *sizes]).tolist()
        whole = pa.decompress(data, ends[-1], "zstd", asbytes=True) if ends[-1] else b""
        texts += [whole[a:b] for a, b in zip(ends, ends[1:])]
    return [i for ids in table["doc_id"].to_pylist() for i in ids], np.array([h for held in table["held_out"].to_pylist() for h in held], dtype=bool), texts


class _Part:
    """A part's tokens as ids of its distinct words, and its distinct pairs; the same for the same rows in any order."""

    def __init__(self, table: pa.Table, shards: int):
        trim()
        self.doc_ids, held, texts = unpacked_texts(table)
        self.held_out = held
        tokens, self.counts = _tokens(texts)
        del texts
        self.ends = np.cumsum(self.counts)
        self.words, self.token = _numbered(np.append(tokens, START))
        self.token, start = self.token[:-1].astype(np.int32), int(self.token[-1])
        self.train = np.repeat(~held, self.counts)
        self.word_counts = np.bincount(self.token[self.train], minlength=len(self.words))
        self.start = start
        self.n_train = int((~held).sum())
        self.shards = shards
        word_shard = (self.words % np.uint64(shards)).astype(np.int64)
        self.of_shard = self._cut(np.argsort(word_shard, kind="stable"), word_shard)

    def receive(self, counted: pa.Table, order: int) -> None:
        """Corpus counts and ids of the part's words, and the corpus totals, from every shard; then the n-grams."""
        self.corpus, self.ids = np.zeros(len(self.words), dtype=np.int64), np.zeros(len(self.words), dtype=np.int32)
        for shard, counts, ranks in zip(counted["shard"].to_pylist(), opened(counted["counts"]), opened(counted["ranks"])):
            own = self.of_shard[shard]
            self.corpus[own], self.ids[own] = widened(counts), unpack_sorted(ranks) * self.shards + shard
        self.n, self.v = (int(sum(counted[c].to_pylist())) for c in ("n", "v"))
        self.bound = self.shards * max([1, *counted["size"].to_pylist()])  # above every id
        assert self.bound < 1 << 31
        end = np.flatnonzero(self.words == END)
        self.totals = self.corpus.copy()
        self.totals[self.start] = self.corpus[end[0]] if len(end) else 0  # a text starts as often as one ends
        first = self.ends - self.counts
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[first] = self.start
        self.context, self.follower, self.pair, self.pair_counts = self._grams(before, self.token, np.arange(len(self.token)))
        # A context of more than a share of all tokens is spread by follower, by counts that all parts know alike.
        spread = np.maximum(1, 8 * self.shards * self.totals[self.context] // max(1, self.n)).astype(np.uint64)
        salt = mixed(self.words[self.follower]) % spread
        pair_shard = (mixed(self.words[self.context] + salt * END) % np.uint64(self.shards)).astype(np.int32)
        place_of = np.empty(len(self.ids), dtype=np.int64)  # of each word in the order of ids
        place_of[np.argsort(self.ids)] = np.arange(len(self.ids))
        # Within a shard by context, then follower; contexts are numbered first, so that one integer orders all three.
        group = _dense(pair_shard.astype(np.int64) * len(self.words) + place_of[self.context])
        by = np.argsort(group * len(self.words) + place_of[self.follower]).astype(np.int32)
        self.sent = self._cut(by, pair_shard)
        # A context is asked for on every shard it is spread over: each counts the followers that it has.
        context, first_pair = np.unique(self.context, return_index=True)
        times = spread[first_pair].astype(np.int64)
        context, salt = np.repeat(context, times), (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)).astype(np.uint64)
        shard = (mixed(self.words[context] + salt * END) % np.uint64(self.shards)).astype(np.int64)
        _, at = np.unique(shard * self.bound + self.ids[context], return_index=True)
        self.asked = [context[at][i] for i in self._cut(np.arange(len(at)), shard[at])]
        del spread, salt, pair_shard, group, by, before, first_pair, times, context, shard, at
        # Levels above: n-grams from the position where their whole context stands in the text.
        self.levels, place = [], (np.arange(len(self.token)) - np.repeat(first, self.counts)).astype(np.int32)
        lower, shorter = self.pair, None  # of each position: its n-gram one level down; of each such n-gram: its context's index
        for k in range(3, order + 1):
            at = np.flatnonzero(place >= k - 2).astype(np.int32)
            prefix, follower, gram, counts = self._grams(lower[at - 1], self.token[at], at)
            if k == 3:
                early, late, oldest = self.context[prefix], self.follower[prefix], self.context
                context = late, early
                shard = (mixed(mixed(self.words[early]) + self.words[late]) % np.uint64(self.shards)).astype(np.int32)
                key = self.ids[late].astype(np.int64) * self.bound + self.ids[early]
            else:
                suffix = np.empty(len(prefix), dtype=np.int32)
                suffix[gram] = lower[at]
                oldest = oldest[self.levels[-1]["prefix"]]
                context = (oldest[prefix],)
                shard, key = shorter["shard"][suffix], shorter["index"][suffix].astype(np.int64) * self.bound + self.ids[context[0]]
            # N-grams come by prefix, which is the context: contexts are numbered by shard and key, then followers ordered in each.
            first_gram = np.flatnonzero(np.append(True, prefix[1:] != prefix[:-1])[: len(prefix)])
            number = np.empty(len(first_gram), dtype=np.int32)
            number[np.lexsort((key[first_gram], shard[first_gram]))] = np.arange(len(first_gram), dtype=np.int32)
            of = np.repeat(number, np.diff(np.append(first_gram, len(prefix))))
            by = np.argsort(of.astype(np.int64) * len(self.words) + place_of[follower]).astype(np.int32)
            cuts = self._cut(by, shard)
            starts = np.array([of[c[0]] if len(c) else 0 for c in cuts], dtype=np.int32)
            shorter = {"shard": shard, "index": of - starts[shard]}
            self.levels.append({"at": at, "gram": gram, "prefix": prefix, "follower": follower, "counts": counts, "key": key, "context": context, "index": shorter["index"], "sent": cuts})
            full = np.full(len(self.token), -1, dtype=np.int32)
            full[at] = gram
            lower = full

    def _grams(self, prefix: np.ndarray, follower: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct n-grams as prefix and follower; the n-gram at each position; counts in training documents."""
        keys, gram = np.unique(prefix.astype(np.int64) * len(self.words) + follower, return_inverse=True)  # most are distinct: a sort is faster
        gram = gram.astype(np.int32)  # a part has fewer tokens than that
        counts = np.bincount(gram[self.train[at]], minlength=len(keys)).astype(np.int32)
        return *(x.astype(np.int32) for x in np.divmod(keys, max(1, len(self.words)))), gram, counts

    def _cut(self, order: np.ndarray, shard: np.ndarray) -> list[np.ndarray]:
        bounds = np.searchsorted(shard[order], np.arange(self.shards + 1))
        return [order[a:b] for a, b in zip(bounds, bounds[1:])]

    def contexts_of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct contexts that a shard is sent, by id, and the index among them of each pair's context."""
        contexts = self.asked[shard]
        place = np.empty(len(self.words), dtype=np.int32)
        place[contexts] = np.arange(len(contexts), dtype=np.int32)
        return contexts, place[self.context[self.sent[shard]]]

    def names_of(self, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in what a shard is sent, in order, and the place among them of each of the part's words that is."""
        seen = np.zeros(len(self.words), dtype=bool)
        seen[self.asked[shard]] = True
        seen[self.follower[self.sent[shard]]] = True
        for level in self.levels:
            for words in (level["follower"], *level["context"]):
                seen[words[level["sent"][shard]]] = True
        words = np.flatnonzero(seen)
        words = words[np.argsort(self.ids[words])]
        place = np.zeros(len(self.words), dtype=np.int32)
        place[words] = np.arange(len(words), dtype=np.int32)
        return self.ids[words], place

    def levels_of(self, shard: int, names: np.ndarray, place: np.ndarray) -> list[bytes]:
        """What a shard is sent of the levels above pairs, as ``answer_levels`` reads it."""
        out = []
        for i, level in enumerate(self.levels):
            at = level["sent"][shard]
            index = level["index"][at].astype(np.int64)
            fresh = np.ones(len(at), dtype=bool)
            fresh[1:] = index[1:] != index[:-1]
            first = at[fresh]
            old = level["key"][first] // self.bound if i else place[level["context"][0][first]].astype(np.int64)
            keys = old * len(names) + place[level["context"][-1][first]]
            out += [pack_sorted(keys), pack_sorted(index * len(names) + place[level["follower"][at]]), narrow(level["counts"][at])]
        return out


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    """The rows as a table, all binary values squeezed."""
    rows = [tuple(squeezed(x) if isinstance(x, bytes) else x for x in row) for row in rows] if pa.binary() in schema.types else rows
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)] if rows else [pa.array([], t) for t in schema.types], schema=schema)


def score_documents(docs: DataFrame, folds: int = 10, extra_shards: int = 1, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row.

    Rows of fold 0 are held out: they are scored, and teach nothing. ``order`` (2 or more) is the words of the longest n-grams.
    """
    if order < 2:
        raise ValueError("the order is 2 or more")
    n_parts = text_parts(docs)
    shards = n_parts * extra_shards
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text"), (fold(folds) == 0).alias("held_out"))
    texts = texts.select("doc_id", "text", "held_out", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_parts)).cast("int").alias("part"))
    texts = texts.mapInArrow(packed_texts, _TEXTS_DDL).repartition(n_parts, "part")

    words_schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("words", pa.binary()), ("counts", pa.binary())])

    def send_words(table: pa.Table) -> pa.Table:
        own, part = _Part(table, shards), table["part"][0].as_py()
        return _rows([(s, part, own.words[at].tobytes(), narrow(own.word_counts[at])) for s, at in enumerate(own.of_shard)], words_schema)

    counted_schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("counts", pa.binary()), ("ranks", pa.binary()), ("size", pa.int64()), ("n", pa.int64()), ("v", pa.int64()), ("shares", pa.binary()), ("followers", pa.binary()), ("levels", pa.binary())])
    counted_ddl = "part int, shard int, counts binary, ranks binary, size long, n long, v long, shares binary, followers binary, levels binary"

    def count_words(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, dtype=np.uint64) for x in opened(table["words"])]
        counts = np.concatenate([widened(x) for x in opened(table["counts"])])
        words, of = np.unique(np.concatenate(lists), return_inverse=True)
        total = np.zeros(len(words), dtype=np.int64)
        np.add.at(total, of, counts)
        shard = table["shard"][0].as_py()
        n, v = int(total.sum()), int((total > 0).sum())
        ranks = [np.searchsorted(words, x) for x in lists]
        return _rows([(p, shard, narrow(total[r]), pack_sorted(r), len(words), n, v, None, None, None) for p, r in zip(table["part"].to_pylist(), ranks)], counted_schema)

    pairs_schema = pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("bound", pa.int64()), ("names", pa.binary()), ("contexts", pa.binary()), ("totals", pa.binary()), ("pairs", pa.binary()), ("counts", pa.binary()), ("levels", pa.binary())])
    pairs_ddl = "shard int, part int, bound long, names binary, contexts binary, totals binary, pairs binary, counts binary, levels binary"

    def send_pairs(table: pa.Table, counted: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([], pairs_schema)
        own, part, out = _Part(table, shards), table["part"][0].as_py(), []
        own.receive(counted, order)
        for s, at in enumerate(own.sent):
            contexts, of = own.contexts_of(s)
            names, place = own.names_of(s)
            pairs = pack_sorted(of.astype(np.int64) * len(names) + place[own.follower[at]])
            out.append((s, part, own.bound, pack_sorted(names), pack_sorted(place[contexts]), narrow(own.totals[contexts]), pairs, narrow(own.pair_counts[at]), _joined(own.levels_of(s, names, place))))
        return _rows(out, pairs_schema)

    def answer(table: pa.Table) -> pa.Table:
        """Build the shard's trie from the training counts of all parts, then look up each part's n-grams in it."""
        bound = table["bound"][0].as_py()
        names = [unpack_sorted(x) for x in opened(table["names"])]
        contexts = [unpack_sorted(x) for x in opened(table["contexts"])]
        pairs = [np.divmod(unpack_sorted(x), max(1, len(ids))) for x, ids in zip(opened(table["pairs"]), names)]
        key = np.concatenate([ids[c][of] * bound + ids[to] for ids, c, (of, to) in zip(names, contexts, pairs)])
        count = np.concatenate([widened(x) for x in opened(table["counts"])])
        total = np.concatenate([widened(x)[of] for x, (of, _) in zip(opened(table["totals"]), pairs)])
        cuts = np.cumsum([len(of) for of, _ in pairs])[:-1]
        del pairs
        key, at = np.unique(key, return_inverse=True)  # a pair that many parts have is looked up once
        sums = np.bincount(at, count, len(key)).astype(np.int64)
        of_key = np.zeros(len(key), dtype=np.int64)
        of_key[at] = total
        trained = sums > 0
        context, follower = np.divmod(key.astype(np.uint64), np.uint64(max(1, bound)))
        trie = Trie.mapped(build_trie(context[trained], follower[trained], sums[trained], of_key[trained]))
        del count, total, sums, of_key, trained, key
        runs, times = _runs_of(context)
        shares = np.split(trie.shares(np.repeat(trie.rank(trie.words.find(runs)), times), trie.words.find(follower))[at], cuts)
        del context, follower, at
        found = [(x.tobytes(), narrow(trie.reach(trie.rank(trie.words.find(ids[c]))))) for x, ids, c in zip(shares, names, contexts)]
        shard = table["shard"][0].as_py()
        del contexts, shares, trie
        trim()
        levels = answer_levels([_split(x) for x in opened(table["levels"])], names, bound)
        out = [(p, shard, None, None, None, None, None, *pairs, above) for p, pairs, above in zip(table["part"].to_pylist(), found, levels)]
        return _rows(out, counted_schema)

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(table: pa.Table, sent: pa.Table) -> pa.Table:
        if not len(table):
            return _rows([], result)
        own = _Part(table, shards)
        kind = sent["counts"].is_valid()
        own.receive(sent.filter(kind), order)
        codes, distinct = np.full(len(own.context), UNSEEN, dtype="<u2"), np.zeros(len(own.words))
        answers = sent.filter(pa.array(~kind.to_numpy(zero_copy_only=False)))
        above = [(np.full(len(x["key"]), UNSEEN, dtype="<u2"), np.full(len(x["key"]), UNSEEN, dtype="<u2")) for x in own.levels]
        for s, found, after, deep in zip(answers["shard"].to_pylist(), *(opened(answers[c]) for c in ("shares", "followers", "levels"))):
            codes[own.sent[s]] = np.frombuffer(found, dtype="<u2")
            contexts, _ = own.contexts_of(s)
            distinct[contexts] += widened(after)
            deep = _split(deep)
            for i, (level, (shares, backs)) in enumerate(zip(own.levels, above)):
                at = level["sent"][s]
                shares[at] = np.frombuffer(deep[2 * i], dtype="<u2")
                backs[at] = np.frombuffer(deep[2 * i + 1], dtype="<u2")[level["index"][at]]
        base = (own.corpus + 0.1) / (own.n + 0.1 * (own.v + 1))
        total = own.totals.astype(np.float64)
        back = np.where(total > 0, DISCOUNT * distinct / np.maximum(total, 1), 1.0)
        p = (share(codes) + back[own.context] * base[own.follower])[own.pair]
        for level, (shares, backs) in zip(own.levels, above):
            p[level["at"]] = share(shares)[level["gram"]] + np.where(backs == UNSEEN, 1.0, share(backs))[level["gram"]] * p[level["at"]]
        sums = lambda x: np.add.reduceat(x, own.ends - own.counts)  # noqa: E731  every text has its end
        rows = zip(
            own.doc_ids, own.held_out.tolist(), own.counts.tolist(), sums((own.corpus > 0)[own.token].astype(np.int64)).tolist(),
            [own.n] * len(own.counts), sums(np.log10(base)[own.token]).tolist(), sums(np.log10(p)).tolist(),
        )
        return _rows(list(rows), result)

    words = texts.groupBy("part").applyInArrow(send_words, "shard int, part int, words binary, counts binary")
    counted = words.groupBy("shard").applyInArrow(count_words, counted_ddl)
    pairs = texts.groupBy("part").cogroup(counted.groupBy("part")).applyInArrow(send_pairs, pairs_ddl)
    answers = pairs.groupBy("shard").applyInArrow(answer, counted_ddl)
    sent = counted.unionByName(answers)
    return texts.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
