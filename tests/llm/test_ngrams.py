import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.ngrams import CODE_STEP, DISCOUNT, EliasFano, Places, Trie, build_trie, narrow, opened, pack_sorted, score_documents, share, squeezed, unpack_sorted, widened


@given(st.lists(st.integers(0, 2**64 - 1), max_size=60), st.integers(0, 60), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=300, deadline=None)
def test_elias_fano(values, shift, others):
    values = sorted(v >> shift for v in values)
    sequence = EliasFano.of(np.array(values, dtype=np.uint64))
    assert sequence.values(np.arange(len(values))).tolist() == values
    asked = values + [x >> shift for x in others] + [0, 2**64 - 1]
    got = sequence.find(np.array(asked, dtype=np.uint64)).tolist()
    assert got == [values.index(x) if x in values else -1 for x in asked]


def test_elias_fano_is_compact():
    values = np.sort(np.random.default_rng(1).integers(0, 2**40, 100_000)).astype(np.uint64)
    assert sum(a.nbytes for a in EliasFano.of(values).arrays()) * 8 / len(values) < 40 - np.log2(len(values)) + 5  # two bits above the low ones, and the directory


@given(st.dictionaries(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 9)), st.integers(1, 50), max_size=40))
@settings(max_examples=100, deadline=None)
def test_trie(pairs):
    total = Counter()
    for (a, _), c in pairs.items():
        total[a] += c
    keys = sorted(pairs)
    columns = np.array(keys, dtype=np.uint64).reshape(-1, 2)
    trie = Trie.mapped(build_trie(columns[:, 0], columns[:, 1], np.array([pairs[k] for k in keys], dtype=np.int64), np.array([total[a] for a, _ in keys], dtype=np.int64)))
    asked = keys + [(a, b + 1) for a, b in keys] + [(3, 3)]
    got = share(trie.find(*np.array(asked, dtype=np.uint64).T))
    for k, p in zip(asked, got):
        assert p == (pytest.approx((pairs[k] - DISCOUNT) / total[k[0]], rel=math.log(10) / CODE_STEP) if k in pairs else 0)
    names = sorted(total)
    assert trie.followers(np.array([*names, 5], dtype=np.uint64)).tolist() == [sum(a == x for x, _ in keys) for a in names] + [sum(x == 5 for x, _ in keys)]


def brute(rows):
    tokens = [[*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 for d, _ in rows]
    count, pair, after = Counter(), Counter(), defaultdict(set)
    for t, h in zip(tokens, held):
        if not h:
            count.update(t)
            for a, b in zip(["", *t], t):
                pair[a, b] += 1
                after[a].add(b)
    n, v = count.total(), len(count)
    context = count | {"": count[None]}
    base = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    out = []
    for (d, _), t, h in zip(rows, tokens, held):
        score = 0.0
        for a, b in zip(["", *t], t):
            c = context.get(a, 0)
            score += math.log10(max(pair[a, b] - DISCOUNT, 0) / c + DISCOUNT * len(after[a]) / c * base(b)) if c else math.log10(base(b))
        out.append((d, h, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10(base(w)) for w in t), score))
    return sorted(out, key=str)


def compare(got, want):
    got = sorted(map(tuple, got), key=str)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], abs=2e-4 * g[2] + 1e-9)


def test_against_brute_force(documents, sample):
    rows = [(r["doc_id"], r["text"]) for r in sample.collect()] + [(9001, None), (9002, ""), (9003, "the THE the"), (9003, "the THE the"), (None, "a b"), (9004, "\xa0 \x1c É")]
    compare(score_documents(documents(rows)).collect(), brute(rows))


def test_small_tables(documents):
    assert score_documents(documents([])).collect() == []
    held = [(d, "a b a") for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0]
    compare(score_documents(documents(held)).collect(), brute(held))


def test_probabilities_sum_to_one(documents):
    train = [(d, t) for d, t in enumerate(["a b a c", "b a b", "c c", ""] * 5) if zlib.crc32(str(d).encode()) % 10]
    probe = next(d for d in range(1000, 2000) if zlib.crc32(str(d).encode()) % 10 == 0)
    held = [d for d in range(probe, probe + 400) if zlib.crc32(str(d).encode()) % 10 == 0][:5]
    texts = ["a", "a a", "a b", "a c", "a unseen"]
    rows = {r["doc_id"]: r["score"] for r in score_documents(documents(train + list(zip(held, texts)))).collect() if r["doc_id"] in held}
    want = {r[0]: r[6] for r in brute(train + list(zip(held, texts)))}
    assert rows == pytest.approx({d: want[d] for d in held}, abs=2e-3)


def test_model_beats_the_base_on_held_out_repeats(spark):
    rows = [r for r in score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def brute_of_order(rows, order):
    """As ``brute``, with contexts of up to order - 1 words."""
    two = {}
    for r in brute(rows):
        two.setdefault(r[0], []).append(r)
    tokens = [["", *re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None] for _, t in rows]
    held = [zlib.crc32(str("" if d is None else d).encode()) % 10 == 0 for d, _ in rows]
    seen, context, after = Counter(), Counter(), defaultdict(set)
    for t, h in zip(tokens, held):
        for i in range(1, len(t)) if not h else ():
            for a in range(max(0, i - order + 1), i + 1):
                seen[tuple(t[a : i + 1])] += 1
                context[tuple(t[a:i])] += 1
                after[tuple(t[a:i])].add(t[i])
    n, v = context[()], len(after[()])
    out = []
    for (d, _), t, h in zip(rows, tokens, held):
        score = 0.0
        for i in range(1, len(t)):
            p = (seen[t[i],] + 0.1) / (n + 0.1 * (v + 1))
            for a in range(i - 1, max(0, i - order + 1) - 1, -1):
                c = tuple(t[a:i])
                if context[c]:
                    p = max(seen[*c, t[i]] - DISCOUNT, 0) / context[c] + DISCOUNT * len(after[c]) / context[c] * p
            score += math.log10(p)
        out.append((*next(r for r in two[d] if r[2] == len(t) - 1)[:5], 0.0, score))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [2, 3, 4])
def test_longer_contexts_against_brute_force(documents, sample, order):
    rows = [(r["doc_id"], r["text"]) for r in sample.limit(60).collect()] + [(9001, None), (9002, "the"), (9003, "the the the the the"), (9004, "a b c d a b c e a b c d")]
    got = {r["doc_id"]: r["score"] for r in score_documents(documents(rows), order=order).collect()}
    want = {r[0]: (r[6], r[2]) for r in brute_of_order(rows, order)}
    assert set(got) == set(want)
    for d, (score, n) in want.items():
        assert got[d] == pytest.approx(score, abs=2e-4 * n + 1e-9)


def test_many_contexts_of_three_words(documents, monkeypatch):
    """In one shard, contexts x words exceed 32 bits."""
    monkeypatch.setattr("larkspur.llm.ngrams.text_parts", lambda docs: 1)
    words = np.random.default_rng(5).integers(0, 70_000, 70_000)
    rows = [(d, " ".join(f"w{w}" for w in words)) for d in (1, 2)]
    got = {r["doc_id"]: r["score"] for r in score_documents(documents(rows), order=4).collect()}
    want = {r[0]: (r[6], r[2]) for r in brute_of_order(rows, 4)}
    for d, (score, n) in want.items():
        assert got[d] == pytest.approx(score, abs=2e-4 * n + 1e-9)


def test_the_query_sees_two_words_back(spark, tmp_path, documents):
    """Words alone and pairs are alike in both probes; only a context of two words tells them apart."""
    from larkspur.llm.queries import queries

    names = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10 == 0][:2]
    train = [d for d in range(400) if zlib.crc32(str(d).encode()) % 10][:40]
    rows = [(d, ["a x b", "c x d"][i % 2]) for i, d in enumerate(train)] + list(zip(names, ["a x b", "a x d"]))
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["score"] for r in queries()["op10_lm_scoring"](spark, str(tmp_path)).collect()}
    assert got[names[0]] > got[names[1]] + 0.5


@given(st.lists(st.integers(0, 2**62), max_size=60), st.integers(0, 62))
@settings(max_examples=200, deadline=None)
def test_sequences_that_travel(values, shift):
    values = sorted(v >> shift for v in values)
    assert unpack_sorted(pack_sorted(np.array(values, dtype=np.int64))).tolist() == values == widened(narrow(np.array(values, dtype=np.int64))).tolist()


def test_followers_of_a_spread_context_are_counted_on_all_its_shards(documents):
    rows = [(d, f"a w{d}") for d in range(9)]
    compare(score_documents(documents(rows)).collect(), brute(rows))


def test_a_word_is_looked_up_once_for_all_its_followers(monkeypatch):
    places, asked = Places(np.array([31, 32, 35, 42]), 10), []
    find = places.last.find
    monkeypatch.setattr(places.last, "find", lambda x: (asked.extend(x.tolist()), find(x))[1])
    reach, place = places.of(np.array([3, 3, 3, 4, 5]), np.array([1, 5, 7, 2, 1]))
    assert reach.tolist() == [3, 3, 3, 1, 0] and place.tolist() == [0, 2, -1, 0, -1]
    assert asked == [3, 4, 5]


def test_pieces_of_messages_are_entropy_coded():
    codes = np.where(np.random.default_rng(5).random(10_000) < 0.9, 512, 4096).astype("<u2").tobytes()
    pieces = [codes, b"", None, b"x"]
    column = pa.chunked_array([pa.array([None if p is None else squeezed(p) for p in pieces], pa.binary())])
    assert opened(column) == pieces
    assert len(squeezed(codes)) < len(codes) / 8  # 0.47 bits of entropy in each 16
